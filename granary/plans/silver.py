"""Data sets of receipts labelled by an engine: annotations, their manifest, and how later results compare with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, similarity
from ..sources import files
from .made import pick, pick_sql
from .registry import query, table

LABEL_SOURCE, ENGINE = "silver-current-engine", "receipt-engine-v2"


def annotations(receipts: DataFrame, dataset: str, generated_at: str) -> DataFrame:
    """stem, file_name, source_path, generated_at and expected, what the engine made of each image, of receipts (source_path and the fields of results)."""
    name = F.element_at(F.split("source_path", "/"), -1)
    fields = [c for c in receipts.columns if c not in ("source_path", "engine_version")]
    engine = F.coalesce("engine_version", F.lit(ENGINE)) if "engine_version" in receipts.columns else F.lit(ENGINE)
    return receipts.select(
        files.safe_stem(name).alias("stem"), F.lit(dataset).alias("dataset_name"), F.lit(LABEL_SOURCE).alias("label_source"), F.lit(generated_at).alias("generated_at"),
        F.struct(name.alias("file_name"), "source_path").alias("image"), F.struct(engine.alias("engine_version")).alias("parser"), F.struct(*fields).alias("expected"),
    )


def manifest(annotated: DataFrame, input_dir: str) -> DataFrame:
    """One row: how many images and items there are and how many need a review, and the images by file name.

    The list of images is as long as the data set, which people have looked through; for larger ones read the annotations.
    """
    totals = annotated.groupBy("dataset_name").agg(
        F.count("*").alias("image_count"), F.sum(F.greatest(F.coalesce(F.size("expected.items"), F.lit(0)), F.lit(0))).alias("total_item_count"), F.count_if(F.coalesce("expected.review_required", F.lit(False))).alias("review_required_count"), F.sort_array(F.collect_list("image")).alias("images"),
    )
    return totals.withColumn("input_dir", F.lit(input_dir))


def write(annotated: DataFrame, input_dir: str, path: str) -> None:
    """annotations (JSON, a folder for each stem) and the manifest below path."""
    annotated.write.partitionBy("stem").mode("overwrite").json(f"{path}/annotations")
    files.write_json(manifest(annotated, input_dir), f"{path}/manifest")


def compared(annotated: DataFrame, parsed: DataFrame) -> DataFrame:
    """For each annotated file that was parsed again (file_name, vendor_name, purchased_at, totals, items): what matches, and F1 of item names.

    Files are met by their safe stem; null matches null. An item is known by its normalised, raw, product and plain name.
    """
    names = [c for c in ("normalized_name", "raw_name", "product_name", "name")]

    def items(df: DataFrame, column: str) -> DataFrame:
        rows = df.select("stem", F.posexplode(column).alias("k", "i"))
        own = [f.name for f in rows.schema["i"].dataType.fields]
        named = rows.select("stem", "k", evaluation.name_set(*[F.col(f"i.{n}") for n in names if n in own]).alias("names"))
        return named.where(F.size("names") > 0)

    again = parsed.withColumn("stem", files.safe_stem(F.col("file_name")))
    f1 = evaluation.greedy_f1(items(annotated, "expected.items"), items(again, "items"), "stem", "k", "names")
    paid = lambda c: F.try_element_at(F.col(c), F.lit("payment_amount"))
    met = annotated.select("stem", F.col("expected").alias("e")).join(again, "stem")
    flags = met.select("stem", "file_name", F.col("e.vendor_name").eqNullSafe(F.col("vendor_name")).alias("vendor_name_match"), F.col("e.purchased_at").eqNullSafe(F.col("purchased_at")).alias("purchased_at_match"), paid("e.totals").eqNullSafe(paid("totals")).alias("payment_amount_match"))
    got = flags.join(f1, "stem", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return got.select("file_name", "vendor_name_match", "purchased_at_match", "payment_amount_match", *[zero(c).alias(f"item_name_{c}") for c in ("precision", "recall", "f1")], *[zero(c).alias(c) for c in ("tp", "fp", "fn")])


def summary(results: DataFrame) -> DataFrame:
    """One row: the shares of files whose fields match, and the mean F1; zeros without files."""
    share = lambda c: F.coalesce(F.round(F.avg(F.col(c).cast("double")), 4), F.lit(0.0))
    return results.agg(F.count("*").alias("image_count"), *[share(f"{c}_match").alias(f"{c}_accuracy") for c in ("vendor_name", "purchased_at", "payment_amount")], share("item_name_f1").alias("item_name_f1_avg"))


def synthetic(spark: SparkSession, n: int, stores: list[str], catalog: list[tuple[str, int, str]], seed: int = 0, most: int = 15) -> DataFrame:
    """n made receipts: receipt_id, store_name, date, items (3 to `most` products of the catalog of names, prices and categories,
    each with a quantity of mostly one) and their total. The same seed gives the same receipts."""
    goods = F.array(*[F.struct(F.lit(a).alias("product_name"), F.lit(b).alias("unit_price"), F.lit(c).alias("category")) for a, b, c in catalog])
    drawn = lambda salt: (F.pmod(F.xxhash64("id", F.lit(seed), salt), F.lit(1_000_003)) / 1_000_003)
    count = F.least(F.lit(len(catalog)), (3 + F.floor(drawn(F.lit("n")) * (most - 2))).cast("int"))
    shuffled = F.transform(F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(len(catalog) - 1)), lambda k: F.struct(drawn(k).alias("r"), k.alias("k")))), lambda s: s["k"])
    luck = lambda k: drawn(F.concat(F.lit("q"), k.cast("string")))
    quantity = lambda k: F.when(luck(k) < 0.70, 1).when(luck(k) < 0.90, 2).when(luck(k) < 0.97, 3).otherwise(4)
    items = F.transform(F.slice(shuffled, F.lit(1), count), lambda k: F.struct(F.get(goods, k)["product_name"].alias("product_name"), F.get(goods, k)["category"].alias("category"), F.get(goods, k)["unit_price"].alias("unit_price"), quantity(k).alias("quantity"), (F.get(goods, k)["unit_price"] * quantity(k)).alias("total_price")))
    day = lambda salt, low, span: (low + F.floor(drawn(F.lit(salt)) * span)).cast("int")
    date = F.format_string("%d-%02d-%02d %02d:%02d", day("y", 2020, 7), day("m", 1, 12), day("d", 1, 28), day("h", 8, 15), day("i", 0, 60))
    made = spark.range(n).select(F.col("id").alias("receipt_id"), F.get(F.array(*[F.lit(s) for s in stores]), F.floor(drawn(F.lit("s")) * len(stores)).cast("int")).alias("store_name"), date.alias("date"), items.alias("items"))
    return made.withColumn("total", F.aggregate("items", F.lit(0), lambda a, i: a + i["total_price"]))


# Queries: an order as an image's receipt, its lines as items.

NAMES = ["우유 1L", "두부", "초코 볼", "Red Box", "깻잎", "계란 10구", "참치캔"]
VENDORS = ["이마트", "GS25", "홈플러스"]
ITEM_SQL = f"""it AS (SELECT l_orderkey AS k, l_linenumber AS n, {pick_sql(NAMES, 'l_partkey')} AS raw, CASE WHEN l_partkey % 3 = 0 THEN {pick_sql(NAMES, 'l_partkey + 1')} END AS norm, {pick_sql(NAMES, 'l_partkey + l_linenumber % 2')} AS again FROM lineitem)"""


def receipts(spark: SparkSession, sf_dir: str, again: bool) -> DataFrame:
    """The receipts as annotated, or as read again: then every other line has another name, some vendors and totals differ."""
    lines = table(spark, sf_dir, "lineitem")
    raw = pick(NAMES, F.col("l_partkey") + (F.col("l_linenumber") % 2 if again else 0))
    norm = F.lit(None).cast("string") if again else F.when(F.col("l_partkey") % 3 == 0, pick(NAMES, F.col("l_partkey") + 1))
    items = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("pos"), raw.alias("raw_name"), norm.alias("normalized_name")))).alias("items"))
    orders = table(spark, sf_dir, "orders").join(items, "o_orderkey")
    shift = F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0) if again else F.lit(0)
    return orders.select(
        F.concat(F.lit("/in/receipt "), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("source_path"), pick(VENDORS, F.col("o_orderkey") + shift).alias("vendor_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("purchased_at"),
        F.create_map(F.lit("payment_amount"), F.round("o_totalprice", 0) + shift).alias("totals"), "items", (F.col("o_orderkey") % 4 == 0).alias("review_required"),
    )


@query("silver_manifest", "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*)::BIGINT AS image_count, sum(n)::BIGINT AS total_item_count, count(*) FILTER (l_orderkey % 4 = 0)::BIGINT AS review_required_count, 'receipt ' || min(l_orderkey::VARCHAR || '.jpg') AS first_image FROM n")
def silver_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = manifest(annotations(receipts(spark, sf_dir, False), "d", "2026-01-01T00:00:00Z"), "/in")
    return got.select("image_count", "total_item_count", "review_required_count", F.col("images")[0]["file_name"].alias("first_image"))


@query("silver_eval", f"""
WITH RECURSIVE {ITEM_SQL},
e AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY n, raw, coalesce(norm, '')) AS p, list_distinct([lower(replace(raw, ' ', '')), coalesce(lower(replace(norm, ' ', '')), lower(replace(raw, ' ', '')))]) AS names FROM it),
a AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY n, again) AS p, lower(replace(again, ' ', '')) AS name FROM it),
al AS (SELECT k, list(name ORDER BY p) AS names FROM a GROUP BY k),
w AS (
  SELECT al.k, 0 AS p, al.names AS rest, 0 AS tp FROM al
  UNION ALL
  SELECT w.k, w.p + 1, CASE WHEN h.at IS NULL THEN w.rest ELSE list_concat(w.rest[1:h.at - 1], w.rest[h.at + 1:]) END, w.tp + CASE WHEN h.at IS NULL THEN 0 ELSE 1 END
  FROM w JOIN e ON e.k = w.k AND e.p = w.p + 1, LATERAL (SELECT min(i) AS at FROM range(1, len(w.rest) + 1) t(i) WHERE list_contains(e.names, w.rest[i])) h),
f AS (SELECT k, arg_max(tp, p) AS tp, max(p) AS n FROM w GROUP BY k)
SELECT 'receipt ' || k::VARCHAR || '.jpg' AS file_name, k % 5 <> 0 AS vendor_name_match, k % 5 <> 0 AS payment_amount_match, tp::BIGINT AS tp, round(CASE WHEN tp > 0 THEN tp / n::DOUBLE ELSE 0 END, 4) AS item_name_f1 FROM f""")
def silver_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = annotations(receipts(spark, sf_dir, False), "d", "2026-01-01T00:00:00Z")
    again = receipts(spark, sf_dir, True).withColumn("file_name", F.element_at(F.split("source_path", "/"), -1))
    return compared(known, again).select("file_name", "vendor_name_match", "payment_amount_match", "tp", "item_name_f1")


@query("silver_summary", "SELECT count(*)::BIGINT AS image_count, round(avg((o_orderkey % 5 <> 0)::INT), 4) AS vendor_name_accuracy, 1.0::DOUBLE AS purchased_at_accuracy, round(avg((o_orderkey % 5 <> 0)::INT), 4) AS payment_amount_accuracy FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem)")
def silver_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = annotations(receipts(spark, sf_dir, False), "d", "2026-01-01T00:00:00Z")
    again = receipts(spark, sf_dir, True).withColumn("file_name", F.element_at(F.split("source_path", "/"), -1))
    return summary(compared(known, again)).drop("item_name_f1_avg")


@query("best_name_in_texts")
def best_name_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of an order's lines against what else it reads; tests hold the ratio against the standard library."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), pick(NAMES, F.col("l_partkey")).alias("name"), pick(NAMES, F.col("l_partkey") + 3).alias("text"))
    return similarity.best_in_texts(lines.where("pos % 2 = 1").drop("text"), lines.where("pos % 2 = 0").drop("name"), "l_orderkey")
