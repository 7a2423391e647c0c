"""Scoring of recipes by owned ingredients: match rates, rarity weights, substitutes, composite and urgency scores."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the parts of the composite score, and of the risk levels of stock.
SCORE_PARTS = {"weighted": 0.45, "core": 0.25, "feasible": 0.20, "few_missing": 0.10}
URGENCY = {"safe": 0.0, "consume_soon": 0.75, "urgent": 1.5, "share_now": 0.0}
STAPLE_WEIGHT, DEFAULT_WEIGHT = 0.3, 1.5


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def match_rates(bridge: DataFrame, ingredients: DataFrame, owned: DataFrame, min_rate: float = 0.0) -> DataFrame:
    """recipe_id, total, matched, match_rate over distinct ingredients that exist; recipes without a match are left out."""
    known = bridge.distinct().join(ingredients.select("ingredient_id"), "ingredient_id")
    flagged = known.join(owned.select("ingredient_id").distinct().withColumn("own", F.lit(1)), "ingredient_id", "left")
    got = flagged.groupBy("recipe_id").agg(F.count("*").alias("total"), F.count("own").alias("matched"))
    rate = F.col("matched") / F.col("total")
    return got.where((F.col("matched") > 0) & (rate >= min_rate)).withColumn("match_rate", F.round(rate, 4))


def frequencies(bridge: DataFrame) -> DataFrame:
    """How often each ingredient is taken; a recipe that names it twice counts twice."""
    return bridge.groupBy("ingredient_id").agg(F.count("*").alias("frequency"))


def weights(ingredients: DataFrame, frequency: DataFrame, recipes: int, by_category: dict[str, float], core: set[str]) -> DataFrame:
    """ingredient_id, staple, core, weight: the category's weight times a bounded rarity; staples have a fixed one.

    Rarity is ln(N/f)/ln N between 0.5 and 1.5, 1 for an ingredient never taken, and 1 where N is 1.
    """
    total = F.lit(float(recipes))
    rarity = F.when(F.coalesce("frequency", F.lit(0)) == 0, 1.0).otherwise(F.greatest(F.least(F.coalesce(F.try_divide(F.log(total / F.col("frequency")), F.log(total)), F.lit(1.0)), F.lit(1.5)), F.lit(0.5)))
    weight = F.when(F.col("staple"), STAPLE_WEIGHT).otherwise(lookup(by_category, F.col("category"), DEFAULT_WEIGHT) * rarity)
    is_core = F.col("category").isin(*sorted(core)) & ~F.col("staple")
    return ingredients.join(frequency, "ingredient_id", "left").select("ingredient_id", "staple", is_core.alias("core"), weight.alias("weight"))


def composite(bridge: DataFrame, weighted: DataFrame, owned: DataFrame, substitutes: DataFrame | None = None) -> DataFrame:
    """Per recipe over distinct ingredients: matched, substituted, match_rate, weighted_rate, core_coverage, feasibility, score (four decimals).

    substitutes: ingredient_id and credit of what a missing ingredient's substitute is worth; it counts by its credit.
    Recipes without any owned or substituted ingredient are left out.
    """
    rows = bridge.distinct().join(weighted, "ingredient_id").join(owned.select("ingredient_id").distinct().withColumn("own", F.lit(1)), "ingredient_id", "left")
    rows = rows.join(substitutes.select("ingredient_id", "credit"), "ingredient_id", "left") if substitutes is not None else rows.withColumn("credit", F.lit(None).cast("double"))
    have, sub = F.col("own").isNotNull(), F.col("own").isNull() & F.col("credit").isNotNull()
    got = rows.groupBy("recipe_id").agg(
        F.count("own").alias("matched"),
        F.count_if(sub).alias("substituted"),
        F.count_if(~have & ~sub).alias("missing"),
        F.sum("weight").alias("tw"),
        F.sum(F.when(have, F.col("weight")).when(sub, F.col("weight") * F.col("credit")).otherwise(0.0)).alias("mw"),
        F.count_if("core").alias("ct"),
        F.count_if(F.col("core") & (have | sub)).alias("cm"),
        F.count_if(F.col("core") & ~have & ~sub).alias("cx"),
    ).where("matched + substituted > 0 and tw > 0")
    core = F.coalesce(F.try_divide(F.col("cm"), F.col("ct")), F.lit(1.0))
    feasible = 1 - F.col("cx") / F.greatest(F.col("ct"), F.lit(1))
    wm = F.try_divide(F.col("mw"), F.col("tw"))
    p = SCORE_PARTS
    score = p["weighted"] * wm + p["core"] * core + p["feasible"] * feasible + p["few_missing"] / (1 + F.log1p(F.col("missing")))
    rate = F.col("matched") / (F.col("matched") + F.col("substituted") + F.col("missing"))
    return got.select("recipe_id", "matched", "substituted", F.round(rate, 4).alias("match_rate"), F.round(score, 4).alias("score"), F.round(wm, 4).alias("weighted_rate"), F.round(core, 4).alias("core_coverage"), F.round(feasible, 4).alias("feasibility"))


def group_edges(members: DataFrame, group: str, name: str, priority: int, credit: float) -> DataFrame:
    """Edges between all members of each group of interchangeable names; groups are short rule lists."""
    a, b = members.select(F.col(group), F.col(name).alias("missing")), members.select(F.col(group), F.col(name).alias("candidate"))
    return a.join(b, group).where("missing <> candidate").select("missing", "candidate", F.lit(priority).alias("priority"), F.lit(credit).alias("credit"))


def derived_edges(left: DataFrame, right: DataFrame, key: str, name: str, priority: int, credit: float) -> DataFrame:
    """Edges from names to those that share a derived key: a preparation to the plain name, a whole to its parts."""
    a, b = left.select(F.col(key), F.col(name).alias("missing")), right.select(F.col(key), F.col(name).alias("candidate"))
    return a.join(b, key).where("missing <> candidate").select("missing", "candidate", F.lit(priority).alias("priority"), F.lit(credit).alias("credit"))


def substitutes(edges: DataFrame, names: DataFrame, owned: DataFrame) -> DataFrame:
    """missing, candidate, credit: for each name not owned the owned candidate of the first priority, least name first."""
    open_ = edges.join(owned.select(F.col("name").alias("missing")), "missing", "left_anti").join(names.select(F.col("name").alias("missing")), "missing", "left_semi")
    usable = open_.join(owned.select(F.col("name").alias("candidate")), "candidate", "left_semi")
    best = usable.groupBy("missing").agg(F.min(F.struct("priority", "candidate", "credit")).alias("b"))
    return best.select("missing", "b.candidate", "b.credit")


def urgency_scores(bridge: DataFrame, stock: DataFrame) -> DataFrame:
    """Two for each line in stock, plus its urgency, less three quarters for each missing one; expired stock doesn't count."""
    live = stock.where(~F.col("is_expired")).select("ingredient_id", lookup(URGENCY, F.col("risk_level"), 0.0).alias("urgency"))
    met = bridge.join(live, "ingredient_id", "left").groupBy("recipe_id").agg(F.count("urgency").alias("used"), F.count_if(F.col("urgency").isNull()).alias("missing"), F.coalesce(F.sum("urgency"), F.lit(0.0)).alias("u"))
    return met.where("used > 0").select("recipe_id", "used", "missing", (2.0 * F.col("used") + F.col("u") - 0.75 * F.col("missing")).alias("score"))


def matched_and_missing(bridge: DataFrame, owned: DataFrame) -> DataFrame:
    """The sorted distinct ingredients of each recipe that are owned, and those that are not. A recipe's list is short."""
    flagged = bridge.distinct().join(owned.select("ingredient_id").distinct().withColumn("own", F.lit(True)), "ingredient_id", "left")
    got = flagged.groupBy("recipe_id").agg(F.sort_array(F.collect_list(F.when(F.col("own"), F.col("ingredient_id")))).alias("matched"), F.sort_array(F.collect_list(F.when(F.col("own").isNull(), F.col("ingredient_id")))).alias("missing"))
    return got


def with_sorted_children(parent: DataFrame, child: DataFrame, key: str, name: str, fields: list[str]) -> DataFrame:
    """parent rows that have children, with the children as a list sorted by their fields."""
    lists = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parent.join(lists, key)
