"""What callers of the service see: rows of older interfaces, whole responses, checked arguments, and what a model answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import receipts as R
from .made import pick, pick_sql
from .registry import query, table

# Words in a model's answer that name no food.
BLOCKED = ["봉투", "비닐", "카드", "결제", "합계", "과세", "면세", "부가세", "승인"]
#: How many rows of the head of a receipt, and of its raw tokens, are passed on.
HEAD_ROWS, HEAD_TOKENS = 2, 4


def checked(**given: tuple[float, float, float]) -> None:
    """Raise unless each argument (value, least, most) is in range."""
    for name, (value, least, most) in given.items():
        if not least <= value <= most:
            raise ValueError(f"{name} must be between {least:g} and {most:g}, not {value:g}")


def legacy_items(items: DataFrame) -> DataFrame:
    """receipt_id, item_idx and product_name: the normalised name, else the raw one; items without either are left out."""
    name = F.coalesce(F.nullif("normalized_name", F.lit("")), F.nullif("raw_name", F.lit("")))
    return items.withColumn("product_name", F.trim(name)).where("product_name <> ''").select("receipt_id", "item_idx", "product_name")


def plain_amount(amount: Column) -> Column:
    """An amount as text, a whole one without decimals."""
    return F.when(amount == F.floor(amount), F.floor(amount).cast("string")).otherwise(amount.cast("string"))


def box_union(boxes: Column) -> Column:
    """The rectangle around all points of a list of boxes, clockwise from the upper left; null without points."""
    points = F.flatten(F.filter(boxes, lambda b: b.isNotNull()))
    lo = lambda axis: F.array_min(F.transform(points, lambda p: p[axis]))
    hi = lambda axis: F.array_max(F.transform(points, lambda p: p[axis]))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.when(F.size(points) > 0, F.array(corner(lo("x"), lo("y")), corner(hi("x"), lo("y")), corner(hi("x"), hi("y")), corner(lo("x"), hi("y"))))


def box_of_sides(sides: Column) -> Column:
    """Four numbers (left, top, right, bottom) as a box of four points."""
    corner = lambda x, y: F.struct(sides[x].alias("x"), sides[y].alias("y"))
    return F.array(corner(0, 1), corner(2, 1), corner(2, 3), corner(0, 3))


def adapter_items(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Items as the adapter shows them: raw name first, whole amounts without decimals, the box around its lines, reasons in one text.

    lines: receipt_id, line_id and box (a list of points). Items without a name are left out.
    """
    name = F.coalesce(F.nullif("raw_name", F.lit("")), F.nullif("normalized_name", F.lit("")))
    named = items.withColumn("name", name).where("name is not null")
    own = named.select("receipt_id", "item_idx", F.explode("source_line_ids").alias("line_id")).join(lines.select("receipt_id", "line_id", "box"), ["receipt_id", "line_id"])
    boxes = own.groupBy("receipt_id", "item_idx").agg(box_union(F.collect_list("box")).alias("box"))
    shown = named.select("receipt_id", "item_idx", "name", "raw_name", plain_amount(F.col("amount")).alias("amount_krw"), F.coalesce("match_confidence", "confidence", F.lit(0.0)).alias("confidence"), F.col("parse_pattern").alias("method"), F.array_join("review_reason", ", ").alias("notes"))
    return shown.join(boxes, ["receipt_id", "item_idx"], "left")


def response(receipts: DataFrame, lines: DataFrame, trace: Column | None = None) -> DataFrame:
    """receipt_id and body, the whole answer as JSON: the result, its lines in order, and a trace id."""
    texts = lines.groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("line_id", "text", "confidence"))).alias("ocr_texts"))
    fields = [c for c in receipts.columns if c != "receipt_id"]
    body = F.struct((F.substring(F.uuid(), 1, 12) if trace is None else trace).alias("trace_id"), F.lit("receipt-engine-v2").alias("engine_version"), *fields, F.coalesce("ocr_texts", F.array().cast("array<struct<line_id: int, text: string, confidence: double>>")).alias("ocr_texts"))
    return receipts.join(texts, "receipt_id", "left").select("receipt_id", F.to_json(body).alias("body"))


def head_rows(lines: DataFrame, most: int = HEAD_ROWS) -> DataFrame:
    """The first `most` lines of each receipt that aren't blank and stand before the first that titles columns or may be an item.

    lines: receipt_id, line_id, text, stops (whether a line titles columns or may be an item).
    """
    from pyspark.sql import Window as W

    filled = lines.where(F.trim("text") != "")
    first = filled.where("stops").groupBy("receipt_id").agg(F.min("line_id").alias("stop"))
    before = filled.join(first, "receipt_id", "left").where(F.col("stop").isNull() | (F.col("line_id") < F.col("stop")))
    return before.withColumn("k", F.row_number().over(W.partitionBy("receipt_id").orderBy("line_id"))).where(F.col("k") <= most).select("receipt_id", "line_id", "text")


def unfenced(text: Column) -> Column:
    """What a model answered, without its thoughts and the fence around it."""
    t = F.trim(text)
    t = F.when(t.contains("<think>") & t.contains("</think>"), F.trim(F.substr(t, F.instr(t, "</think>") + 8))).otherwise(t)
    mark = F.when(t.contains("```json"), F.lit("```json")).when(t.contains("```"), F.lit("```"))
    inside = F.substr(t, F.position(mark, t) + F.length(mark))
    closed = F.when(inside.contains("```"), F.regexp_extract(inside, "(?s)^(.*)```", 1)).otherwise(inside)
    return F.trim(F.when(mark.isNull(), t).otherwise(closed))


def json_object(text: Column) -> Column:
    """From the first opening brace to the last closing one, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def answered_items(answers: DataFrame) -> DataFrame:
    """receipt_id, pos, product_name, amount_krw, notes of a model's answers (receipt_id, text): a JSON list of items, fenced or not.

    Names are trimmed; blank names and those with a BLOCKED word are left out, amounts that are no whole number are null,
    and of equal names with equal amounts the first stays. What is no list gives no rows.
    """
    from ..operators import merging

    kind = "array<struct<product_name: string, amount_krw: string, notes: string>>"
    rows = answers.select("receipt_id", F.posexplode(F.from_json(unfenced(F.col("text")), kind)).alias("pos", "i"))
    amount = F.regexp_replace(F.trim("i.amount_krw"), ",", "")
    named = rows.select("receipt_id", "pos", F.trim(F.coalesce("i.product_name", F.lit(""))).alias("product_name"), F.when(amount.rlike(r"^[+-]?\d+$"), amount.try_cast("long")).alias("amount_krw"), F.trim(F.coalesce("i.notes", F.lit(""))).alias("notes"))
    good = named.where((F.col("product_name") != "") & ~F.col("product_name").rlike("|".join(BLOCKED)))
    return merging.first_wins(good, ["receipt_id", "product_name", "amount_krw"], "pos")


def fallback_items(items: DataFrame) -> DataFrame:
    """What is shown without a model's answer: product_name, amount_krw and notes of the rules' items (receipt_id, pos,
    product_name or name, amount_krw, notes), the first of equal names with equal amounts."""
    from ..operators import merging

    amount = F.regexp_replace(F.trim(F.col("amount_krw").cast("string")), ",", "")
    name = F.trim(F.coalesce(F.nullif("product_name", F.lit("")), F.col("name"), F.lit("")))
    rows = items.select("receipt_id", "pos", name.alias("product_name"), F.when(amount.rlike(r"^[+-]?\d+$"), amount.try_cast("long")).alias("amount_krw"), F.trim(F.coalesce("notes", F.lit(""))).alias("notes"))
    return merging.first_wins(rows.where("product_name <> ''"), ["receipt_id", "product_name", "amount_krw"], "pos")


def enriched(recommendations: DataFrame, answers: DataFrame) -> DataFrame:
    """Recommendations (recipe_id, reason, substitutes) with what a provider says instead (answers: the same columns, null
    where it says nothing), and who said it (reason_source)."""
    said_ = answers.select("recipe_id", F.nullif(F.trim("reason"), F.lit("")).alias("_reason"), F.col("substitutes").alias("_substitutes"))
    met = recommendations.join(said_, "recipe_id", "left")
    return met.withColumns({"reason_source": F.when(F.col("_reason").isNotNull(), "provider").otherwise("rules"), "reason": F.coalesce("_reason", "reason"), "substitutes": F.coalesce("_substitutes", "substitutes")}).drop("_reason", "_substitutes")


def quality_score(edge_mean: Column, edge_std: Column, std: Column) -> Column:
    """How clear an image is, 0 to 1, from the mean and deviation of its edges and the deviation of its grey values."""
    unit = lambda c: F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    return F.round(0.65 * unit((edge_mean + edge_std) / 140.0) + 0.35 * unit(std / 64.0), 4)


def quality_reasons(short_side: Column, edge_mean: Column, edge_std: Column, std: Column, least_side: int = 720, least_std: float = 32.0, least_detail: float = 0.18) -> Column:
    """What is wrong with an image, in order: too small, of low contrast, blurry, or poor altogether."""
    flags = [("small_image", short_side < least_side), ("low_contrast", std < least_std), ("blurry", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge_mean + edge_std) / 140.0)) < least_detail), ("low_quality", quality_score(edge_mean, edge_std, std) < 0.25)]
    return F.filter(F.array(*[F.when(on, F.lit(n)) for n, on in flags]), lambda x: x.isNotNull())


# Queries over orders as receipts.

NAMES = ["우유", " 두부 ", "비닐 봉투", "", "깻잎", "카드 승인"]
MADE_SQL = f"made AS (SELECT l_orderkey AS k, l_linenumber AS n, {pick_sql(NAMES, 'l_partkey')} AS name, round(l_extendedprice, 1) AS amount, l_quantity AS q, l_partkey AS p FROM lineitem)"


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("receipt_id"), F.col("l_linenumber").cast("int").alias("item_idx"), pick(NAMES, F.col("l_partkey")).alias("raw_name"), F.when(F.col("l_partkey") % 2 == 0, pick(NAMES, F.col("l_partkey") + 1)).alias("normalized_name"), F.round("l_extendedprice", 1).alias("amount"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"))


@query("legacy_items", f"WITH {MADE_SQL}, x AS (SELECT k, n, trim(coalesce(CASE WHEN p % 2 = 0 THEN nullif({pick_sql(NAMES, 'p + 1')}, '') END, nullif(name, ''))) AS name FROM made) SELECT k AS receipt_id, n::INT AS item_idx, name AS product_name FROM x WHERE name <> ''")
def legacy_items_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy_items(made(spark, sf_dir))


@query("adapter_items", f"""WITH {MADE_SQL}, x AS (SELECT *, coalesce(nullif(name, ''), CASE WHEN p % 2 = 0 THEN nullif({pick_sql(NAMES, 'p + 1')}, '') END) AS shown FROM made)
SELECT k AS receipt_id, n::INT AS item_idx, shown AS name, CASE WHEN q % 2 = 0 THEN q::BIGINT::VARCHAR ELSE (q + 0.5)::DOUBLE::VARCHAR END AS amount_krw, (n * 10)::DOUBLE AS left_x, (n * 10 + 30)::DOUBLE AS right_x, 'low_confidence, unknown_item' AS notes FROM x WHERE shown IS NOT NULL""")
def adapter_items_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = made(spark, sf_dir).withColumns({"amount": F.when(F.col("q") % 2 == 0, F.col("q")).otherwise(F.col("q") + 0.5).cast("double"), "source_line_ids": F.array(2 * F.col("item_idx"), 2 * F.col("item_idx") + 1), "match_confidence": F.lit(0.9), "confidence": F.lit(0.8), "parse_pattern": F.lit("p"), "review_reason": F.array(F.lit("low_confidence"), F.lit("unknown_item"))})
    point = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(y).alias("y"))
    line = made(spark, sf_dir).select("receipt_id", F.inline(F.array(*[F.struct((2 * F.col("item_idx") + d).alias("line_id"), F.array(point(F.col("item_idx") * 10 + 20 * d, 1.0), point(F.col("item_idx") * 10 + 20 * d + 10, 2.0)).alias("box")) for d in (0, 1)])))
    got = adapter_items(items, line)
    return got.select("receipt_id", "item_idx", "name", "amount_krw", F.col("box")[0]["x"].alias("left_x"), F.col("box")[2]["x"].alias("right_x"), "notes")


@query("model_answers", f"""WITH {MADE_SQL}, r AS (SELECT k, trim(name) AS product_name, CASE WHEN p % 5 = 0 THEN NULL ELSE q::BIGINT * 1000 END AS amount_krw, n FROM made),
g AS (SELECT * FROM r WHERE product_name <> '' AND NOT regexp_matches(product_name, '{'|'.join(BLOCKED)}'))
SELECT k AS receipt_id, product_name, amount_krw FROM g GROUP BY ALL""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("p") % 5 == 0, F.lit("unsure")).otherwise(F.format_number(F.col("q") * 1000, 0))
    listed = made(spark, sf_dir).groupBy("receipt_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("item_idx", "raw_name", price.alias("price")))), lambda s: F.struct(s["raw_name"].alias("product_name"), s["price"].alias("amount_krw"), F.lit("x").alias("notes")))).alias("j"))
    text = F.when(F.col("receipt_id") % 3 == 0, F.concat(F.lit("<think>``` maybe</think>\nHere:\n```json\n"), "j", F.lit("\n``` done"))).when(F.col("receipt_id") % 3 == 1, F.concat(F.lit("```\n"), "j", F.lit("\n```"))).otherwise(F.col("j"))
    return answered_items(listed.select("receipt_id", text.alias("text"))).select("receipt_id", "product_name", "amount_krw")


@query("header_rows", f"WITH {R.RLINE_SQL}, b AS (SELECT r, i, t, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM rline WHERE i < 3) SELECT r AS receipt_id, i::INT AS line_id, t AS text FROM b WHERE k <= 2")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.receipt_lines(spark, sf_dir).withColumn("stops", F.col("line_id") >= 3)
    return head_rows(lines).select("receipt_id", F.col("line_id").cast("int").alias("line_id"), "text")


@query("image_quality", "WITH s AS (SELECT p_partkey, p_size * 2.0::DOUBLE AS em, p_retailprice / 40.0::DOUBLE AS es, p_size + 10.0::DOUBLE AS sd FROM part), q AS (SELECT *, round(0.65::DOUBLE * greatest(0, least(1, (em + es) / 140.0::DOUBLE)) + 0.35::DOUBLE * greatest(0, least(1, sd / 64.0::DOUBLE)), 4) AS score FROM s) SELECT p_partkey, round(score, 1)::DOUBLE AS about, concat_ws(',', CASE WHEN p_partkey % 1000 < 720 THEN 'small_image' END, CASE WHEN sd < 32 THEN 'low_contrast' END, CASE WHEN (em + es) / 140.0 < 0.18 THEN 'blurry' END, CASE WHEN score < 0.25 THEN 'low_quality' END) AS reasons FROM q")
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    stats = (F.col("p_size") * 2.0, F.col("p_retailprice") / 40.0, F.col("p_size") + 10.0)
    return part.select("p_partkey", F.round(quality_score(*stats), 1).alias("about"), F.array_join(quality_reasons(F.col("p_partkey") % 1000, *stats), ",").alias("reasons"))
