"""Recipe recommendation over orders as recipes and parts as ingredients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking, recommendation
from .projections import checked
from .registry import query, table

RECIPE_SQL = """
recipe AS (SELECT o_orderkey AS recipe_id, o_orderpriority AS category, o_orderstatus AS method FROM orders),
ingr AS (SELECT p_partkey AS ingredient_id, p_name AS name, p_type AS category FROM part),
raw_bridge AS (SELECT l_orderkey AS recipe_id, l_partkey AS ingredient_id FROM lineitem),
bridge AS (SELECT DISTINCT recipe_id, ingredient_id FROM raw_bridge),
owned AS (SELECT p_partkey AS ingredient_id FROM part WHERE p_partkey % 7 = 0)"""


def recipe_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Recipes, ingredients, what each recipe takes (with repeats), and what is owned."""
    recipe = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recipe_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("method"))
    ingr = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ingredient_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    bridge = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("recipe_id"), F.col("l_partkey").alias("ingredient_id"))
    owned = ingr.where("ingredient_id % 7 = 0").select("ingredient_id")
    return recipe, ingr, bridge, owned


@query("recommend_match_rate", f"""
WITH {RECIPE_SQL},
s AS (SELECT b.recipe_id, count(*) AS total, count(o.ingredient_id) AS matched FROM bridge b JOIN ingr USING (ingredient_id) LEFT JOIN owned o USING (ingredient_id) GROUP BY b.recipe_id)
SELECT s.recipe_id, r.category, s.total::BIGINT AS total, s.matched::BIGINT AS matched, round(s.matched / s.total::DOUBLE, 4) AS match_rate
FROM s JOIN recipe r USING (recipe_id) WHERE s.matched > 0 AND s.matched / s.total::DOUBLE >= 0.2 ORDER BY round(s.matched / s.total::DOUBLE, 4) DESC, s.matched DESC, s.recipe_id LIMIT 100
""")
def recommend_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe, ingr, bridge, owned = recipe_tables(spark, sf_dir)
    got = recommendation.match_rates(bridge, ingr, owned, min_rate=0.2)
    met = got.join(recipe, "recipe_id").select("recipe_id", "category", "total", "matched", "match_rate")
    return ranking.top(met, 100, F.desc("match_rate"), F.desc("matched"), F.col("recipe_id"))


@query("ingredient_frequency", f"WITH {RECIPE_SQL} SELECT ingredient_id, count(*)::BIGINT AS frequency FROM raw_bridge GROUP BY ingredient_id")
def ingredient_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommendation.frequencies(recipe_tables(spark, sf_dir)[2])


WEIGHTS_SQL = f"""
{RECIPE_SQL},
n AS (SELECT count(*)::DOUBLE AS n FROM recipe),
f AS (SELECT ingredient_id, count(*) AS f FROM raw_bridge GROUP BY ingredient_id),
w AS (
  SELECT i.ingredient_id, i.category, i.name LIKE 'small %' AS staple, i.category IN ('ECONOMY', 'PROMO') AS core,
    CASE WHEN i.name LIKE 'small %' THEN 0.3::DOUBLE ELSE
      CASE i.category WHEN 'ECONOMY' THEN 3.0 WHEN 'PROMO' THEN 2.0 WHEN 'SMALL' THEN 1.0 ELSE 1.5 END::DOUBLE
      * CASE WHEN coalesce(f.f, 0) = 0 THEN 1.0 ELSE greatest(least(ln(n.n / f.f) / ln(n.n), 1.5), 0.5) END END AS weight
  FROM ingr i CROSS JOIN n LEFT JOIN f USING (ingredient_id))"""


@query("idf_weights", f"WITH {WEIGHTS_SQL} SELECT ingredient_id, staple, core AND NOT staple AS core, round(weight, 6) AS weight FROM w")
def idf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted(spark, sf_dir).select("ingredient_id", "staple", "core", F.round("weight", 6).alias("weight"))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe, ingr, bridge, _ = recipe_tables(spark, sf_dir)
    return recommendation.weights(
        ingr.withColumn("staple", F.col("name").startswith("small ")), recommendation.frequencies(bridge), recipe.count(), {"ECONOMY": 3.0, "PROMO": 2.0, "SMALL": 1.0}, {"ECONOMY", "PROMO"}
    )


SUBS_SQL = """
noun AS (SELECT ingredient_id, name, category, split_part(name, ' ', 2) AS noun, split_part(name, ' ', 1) AS adj FROM ingr),
low AS (SELECT name, min(ingredient_id) AS ingredient_id, min(category) AS category FROM ingr GROUP BY name),
edge AS (
  SELECT a.name AS missing, b.name AS candidate, 1 AS priority, 0.6::DOUBLE AS credit FROM low a JOIN low b ON split_part(a.name, ' ', 2) = split_part(b.name, ' ', 2) AND a.name <> b.name AND split_part(a.name, ' ', 1) IN ('red', 'blue') AND split_part(b.name, ' ', 1) IN ('red', 'blue')
  UNION ALL SELECT a.name, b.name, 2, 0.85 FROM low a JOIN low b ON split_part(a.name, ' ', 2) = split_part(b.name, ' ', 2) AND a.name LIKE 'large %' AND b.name LIKE 'small %'
  UNION ALL SELECT a.name, b.name, 3, 0.7 FROM low a JOIN low b ON split_part(a.name, ' ', 1) = split_part(b.name, ' ', 1) AND a.name LIKE '% box' AND b.name NOT LIKE '% box'),
have AS (SELECT DISTINCT name FROM ingr JOIN owned USING (ingredient_id)),
lack AS (SELECT name FROM low WHERE name NOT IN (SELECT name FROM have)),
sub AS (SELECT missing, candidate, credit FROM (SELECT e.missing, e.candidate, e.credit, row_number() OVER (PARTITION BY missing ORDER BY priority, candidate) AS k FROM edge e JOIN have h ON h.name = e.candidate JOIN lack l ON l.name = e.missing) WHERE k = 1)"""


@query("recommend_substitution", f"WITH {RECIPE_SQL.replace('p_partkey % 7 = 0', 'p_partkey % 97 = 0')}, {SUBS_SQL} SELECT missing, candidate, credit FROM sub")
def recommend_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ingr, _, _ = recipe_tables(spark, sf_dir)
    owned = ingr.where("ingredient_id % 97 = 0").select("name").distinct()
    return recommendation.substitutes(substitution_edges(ingr), ingr.select("name").distinct(), owned)


def substitution_edges(ingr: DataFrame) -> DataFrame:
    """Groups of one noun, preparations of a plainer name, and parts of a whole, by the names of the parts table."""
    names = ingr.select("name").distinct().withColumn("adj", F.split_part("name", F.lit(" "), F.lit(1))).withColumn("noun", F.split_part("name", F.lit(" "), F.lit(2)))
    member = names.where(F.col("adj").isin("red", "blue"))
    groups = recommendation.group_edges(member, "noun", "name", priority=1, credit=0.6)
    prepared = recommendation.derived_edges(names.where("adj = 'large'"), names.where("adj = 'small'"), "noun", "name", priority=2, credit=0.85)
    parts = recommendation.derived_edges(names.where("noun = 'box'"), names.where("noun <> 'box'"), "adj", "name", priority=3, credit=0.7)
    return groups.unionByName(prepared).unionByName(parts)


SCORE_SQL = f"""{WEIGHTS_SQL}, {SUBS_SQL},
sub_ids AS (SELECT i.ingredient_id, s.credit FROM ingr i JOIN sub s ON s.missing = i.name),
c AS (
  SELECT b.recipe_id, count(o.ingredient_id) AS matched, count(*) FILTER (o.ingredient_id IS NULL AND u.credit IS NOT NULL) AS substituted, count(*) FILTER (o.ingredient_id IS NULL AND u.credit IS NULL) AS missing, sum(w.weight) AS tw,
    sum(CASE WHEN o.ingredient_id IS NOT NULL THEN w.weight WHEN u.credit IS NOT NULL THEN w.weight * u.credit ELSE 0 END) AS mw, count(*) FILTER (w.core AND NOT w.staple) AS ct,
    count(*) FILTER (w.core AND NOT w.staple AND (o.ingredient_id IS NOT NULL OR u.credit IS NOT NULL)) AS cm
  FROM bridge b JOIN w USING (ingredient_id) LEFT JOIN owned o USING (ingredient_id) LEFT JOIN sub_ids u USING (ingredient_id) GROUP BY b.recipe_id),
s AS (SELECT *, mw / tw AS wm, CASE WHEN ct = 0 THEN 1.0 ELSE cm / ct::DOUBLE END AS core, 1 - (ct - cm) / greatest(ct, 1)::DOUBLE AS feas, round(matched / (matched + substituted + missing)::DOUBLE, 4) AS match_rate FROM c WHERE matched + substituted > 0),
scored AS (SELECT s.recipe_id, r.category, r.method, s.matched::BIGINT AS matched, s.substituted::BIGINT AS substituted, s.match_rate, round(0.45 * wm + 0.25 * core + 0.20 * feas + 0.10 / (1 + ln(1 + missing)), 4) AS score, round(wm, 4) AS weighted_rate, round(core, 4) AS core_coverage, round(feas, 4) AS feasibility FROM s JOIN recipe r USING (recipe_id))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recipe's score; what is missing counts by the credit of its substitute among what is owned."""
    recipe, ingr, bridge, owned = recipe_tables(spark, sf_dir)
    names = ingr.select("ingredient_id", F.col("name").alias("missing"))
    have = owned.join(ingr, "ingredient_id").select("name").distinct()
    subs = recommendation.substitutes(substitution_edges(ingr), ingr.select("name").distinct(), have)
    got = recommendation.composite(bridge, weighted(spark, sf_dir), owned, names.join(subs, "missing").select("ingredient_id", "credit"))
    return got.join(recipe, "recipe_id")


def recommended(scored: DataFrame, top_k: int = 10, category: str | None = None, method: str | None = None, min_score: float = 0.0, min_match_rate: float = 0.0, diversity: bool = True) -> DataFrame:
    """The best recipes of scored (recipe_id, category, method, method_code if there is one, score, match_rate), best first.

    method may be a name or a code, whatever the code's case. With diversity a category has at most a third of top_k, three
    at least, unless too few others are left.
    """
    checked(top_k=(top_k, 1, 100), min_score=(min_score, 0, 1), min_match_rate=(min_match_rate, 0, 1))
    kept = scored.where((F.col("score") >= min_score) & (F.col("match_rate") >= min_match_rate))
    if category:
        kept = kept.where(F.col("category") == category)
    if method:
        code = F.upper("method_code") if "method_code" in scored.columns else F.lit("")
        kept = kept.where((F.col("method") == method.strip()) | (code == method.strip().upper()))
    order = (F.desc("score"), F.col("recipe_id"))
    return ranking.quota_top(kept, "category", top_k, max(3, top_k // 3), *order) if diversity else ranking.top(kept, top_k, *order)


SHOWN = ["recipe_id", "category", "matched", "substituted", "score", "weighted_rate", "core_coverage", "feasibility"]


@query("recommend_weighted", f"WITH {SCORE_SQL} SELECT {', '.join(SHOWN)} FROM scored WHERE score >= 0.3 ORDER BY score DESC, recipe_id LIMIT 100")
def recommend_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommended(scored(spark, sf_dir), 100, min_score=0.3, diversity=False).select(*SHOWN)


@query("recommend_filtered", f"WITH {SCORE_SQL} SELECT {', '.join(SHOWN)} FROM scored WHERE category = '5-LOW' AND method = 'O' AND match_rate >= 0.2 AND score >= 0.1 ORDER BY score DESC, recipe_id LIMIT 20")
def recommend_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommended(scored(spark, sf_dir), 20, "5-LOW", "O", 0.1, 0.2, diversity=False).select(*SHOWN)


@query("recommend_diverse_topk", f"""WITH {SCORE_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, recipe_id) AS k FROM scored)
SELECT recipe_id, category, score FROM q ORDER BY CASE WHEN k > 4 THEN 1 ELSE 0 END, score DESC, recipe_id LIMIT 12""")
def recommend_diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommended(scored(spark, sf_dir), 12).select("recipe_id", "category", "score")


@query("recommend_inventory_urgency", f"""WITH {RECIPE_SQL},
stock AS (SELECT p_partkey AS ingredient_id, CASE WHEN p_size % 3 = 0 THEN 0.0 WHEN p_size % 3 = 1 THEN 0.75 ELSE 1.5 END::DOUBLE AS urgency FROM part WHERE p_partkey % 5 = 0 AND p_size > 2)
SELECT recipe_id, count(s.ingredient_id)::BIGINT AS used, (count(*) - count(s.ingredient_id))::BIGINT AS missing, 2.0 * count(s.ingredient_id) + coalesce(sum(urgency), 0) - 0.75 * (count(*) - count(s.ingredient_id)) AS score
FROM raw_bridge LEFT JOIN stock s USING (ingredient_id) GROUP BY recipe_id HAVING count(s.ingredient_id) > 0 ORDER BY score DESC, recipe_id LIMIT 50""")
def recommend_inventory_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    risk = F.when(F.col("p_size") % 3 == 0, "safe").when(F.col("p_size") % 3 == 1, "consume_soon").otherwise("urgent")
    stock = part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("ingredient_id"), risk.alias("risk_level"), (F.col("p_size") <= 2).alias("is_expired"))
    got = recommendation.urgency_scores(recipe_tables(spark, sf_dir)[2], stock)
    return ranking.top(got, 50, F.desc("score"), F.col("recipe_id"))


@query("owned_set_algebra", f"""WITH {RECIPE_SQL}
SELECT recipe_id, coalesce(string_agg(b.ingredient_id::VARCHAR, ',' ORDER BY b.ingredient_id) FILTER (o.ingredient_id IS NOT NULL), '') AS matched_ids, coalesce(string_agg(b.ingredient_id::VARCHAR, ',' ORDER BY b.ingredient_id) FILTER (o.ingredient_id IS NULL), '') AS missing_ids
FROM bridge b LEFT JOIN owned o USING (ingredient_id) GROUP BY recipe_id""")
def owned_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, bridge, owned = recipe_tables(spark, sf_dir)
    got = recommendation.matched_and_missing(bridge, owned)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return got.select("recipe_id", text("matched").alias("matched_ids"), text("missing").alias("missing_ids"))


@query("recipe_detail_nested", f"""WITH {RECIPE_SQL}
SELECT r.recipe_id, r.category, count(*)::BIGINT AS n_steps, string_agg(l.l_linenumber::VARCHAR || ':' || p.p_name, '|' ORDER BY l.l_linenumber, p.p_name) AS steps
FROM recipe r JOIN lineitem l ON l.l_orderkey = r.recipe_id JOIN part p ON p.p_partkey = l.l_partkey GROUP BY r.recipe_id, r.category""")
def recipe_detail_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe, ingr, _, _ = recipe_tables(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("recipe_id"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("ingredient_id"))
    steps = lines.join(ingr.select("ingredient_id", "name"), "ingredient_id")
    nested = recommendation.with_sorted_children(recipe, steps, "recipe_id", "steps", ["step", "name"])
    text = F.array_join(F.transform("steps", lambda s: F.concat(s["step"].cast("string"), F.lit(":"), s["name"])), "|")
    return nested.select("recipe_id", "category", F.size("steps").cast("long").alias("n_steps"), text.alias("steps"))


@query("explanations", f"""WITH {SCORE_SQL} SELECT recipe_id, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END || ' match: ' || matched::VARCHAR || ' owned' AS reason FROM scored ORDER BY score DESC, recipe_id LIMIT 100""")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.5, "medium").otherwise("low")
    best = ranking.top(scored(spark, sf_dir), 100, F.desc("score"), F.col("recipe_id"))
    return best.select("recipe_id", F.concat(level, F.lit(" match: "), F.col("matched").cast("string"), F.lit(" owned")).alias("reason"))
