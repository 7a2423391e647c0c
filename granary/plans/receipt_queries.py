"""Queries of the first receipt engines and of the review that follows parsing, on texts whose answers are known or that SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import receipt_review as Q
from . import receipts_v1 as V1
from .made import pick, pick_sql
from .registry import query, table

# Texts of lines, and what is known of each: its type, its price in line, and its name as a product.
LINES = ["=====", "8801234567890", "12,500", "2024-03-05 12:30", "사업자 등록 123", "01) 국산 두부 1,500", "삼겹 600g", "대파 2 x 1,200원", "ABC", "합계 5,000", "깨잎 900원", "양송이 (국산)", "판매일 2024.03.05"]
TYPES = ["separator", "barcode", "price", "date", "header", "product", "product", "product", "unknown", "header", "product", "product", "date"]
PRICES = [None, 8801234567890, 12500, None, 123, 1500, None, 2400, None, 5000, 900, None, None]
TITLES = ["01) 국산 두부", "삼겹 600g", "양송이 (국산)", "대파|망", "파프리카 200g*2", "(주)농심 라면", "우유 1L"]
NAMES_NEW = ["국산 두부", "삼겹살", "양송이버섯", "대파 망", "파프리카 200g", "농심 라면", "우유"]


def known(values: list, number: str) -> str:
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[({number}) % {len(values)} + 1]"


@query("line_types", f"SELECT p_partkey, {known(TYPES, 'p_partkey')} AS kind, {known(PRICES, 'p_partkey')}::BIGINT AS price FROM part")
def line_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pick(LINES, F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", V1.line_type(text).alias("kind"), V1.inline_price(text).alias("price"))


BOUGHT = ["두부 1,500", "대파 900", "두 부 1,200", "화장지 3,000", "볼펜 500", "깨잎 1,000", "합계 9,000"]
BOUGHT_NAMES = ["두부", "대파", "두 부", None, None, "깻잎", None]
BOUGHT_SQL = f"""line AS (SELECT l_orderkey AS r, l_linenumber AS i, min(l_partkey) % {len(BOUGHT)} AS k FROM lineitem GROUP BY 1, 2),
named AS (SELECT r, i, ({known(BOUGHT_NAMES, 'k')}) AS name, ([1500, 900, 1200, 3000, 500, 1000, 9000])[k + 1] AS price FROM line),
first AS (SELECT *, row_number() OVER (PARTITION BY r, replace(name, ' ', '') ORDER BY i, price) AS n FROM named WHERE name IS NOT NULL)"""
KEYWORDS = [("두부", "가공식품/두부"), ("두 부", "가공식품/두부"), ("대파", "채소/대파"), ("깻잎", "채소/잎"), ("깨잎", "채소/잎")]


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    one = line.groupBy(F.col("l_orderkey").alias("receipt_id"), F.col("l_linenumber").alias("line_idx")).agg(F.min("l_partkey").alias("p"))
    return one.select("receipt_id", F.col("line_idx").cast("int").alias("line_idx"), pick(BOUGHT, F.col("p")).alias("text"))


@query("first_engine_items", f"WITH {BOUGHT_SQL} SELECT r AS receipt_id, i::INT AS line_idx, name AS product_name, price::BIGINT AS amount_krw FROM first WHERE n = 1")
def first_engine_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, prices, corrections, food alone, equal names once, categories: the whole first engine."""
    return V1.items(bought(spark, sf_dir), KEYWORDS).select("receipt_id", "line_idx", "product_name", "amount_krw")


@query("product_names", f"SELECT p_partkey, {known(NAMES_NEW, 'p_partkey')} AS name FROM part")
def product_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", V1.product_name(pick(TITLES, F.col("p_partkey"))).alias("name"))


# Review: an order's lines as items with reasons.

RAW = ["국산 콩나물 무침", "A]", "과자", "ab", "양파 L"]
ITEM_SQL = f"""item AS (SELECT l_orderkey AS r, l_linenumber AS i, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
due AS (SELECT r, i, p, {pick_sql(RAW, 'p')} AS raw, p % 2 = 0 AS unknown, p % 3 = 0 AS low, p % 5 = 0 AS missing FROM item),
scored AS (SELECT *, CASE WHEN missing THEN 180 ELSE 0 END + CASE WHEN low THEN 70 ELSE 0 END + CASE WHEN unknown AND (length(replace(raw, ' ', '')) <= 2 OR regexp_matches(raw, '[\\[\\]{{}}|]') OR regexp_matches(raw, '[LI\\]]$')) THEN 40 ELSE 0 END AS priority FROM due)"""


def doubtful(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("receipt_id"), F.col("l_linenumber").cast("int").alias("item_idx")).agg(F.min("l_partkey").alias("p"))
    has = lambda n, name: F.when(F.col("p") % n == 0, F.lit(name))
    reasons = F.filter(F.array(has(2, "unknown_item"), has(3, "low_confidence"), has(5, "missing_quantity_or_unit")), lambda x: x.isNotNull())
    return item.select("receipt_id", "item_idx", "p", pick(RAW, F.col("p")).alias("raw_name"), reasons.alias("review_reason"), F.array(F.col("item_idx") * 2, F.col("item_idx") * 2 + 1).alias("source_line_ids")).withColumn("needs_review", F.size("review_reason") > 0)


@query("review_queue", f"WITH {ITEM_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY priority DESC, i) AS place FROM scored WHERE (unknown OR low OR missing) AND priority > 0) SELECT r AS receipt_id, i::INT AS item_idx, priority::INT AS priority, place::INT AS place FROM q WHERE place <= 4")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.review_queue(doubtful(spark, sf_dir)).select("receipt_id", "item_idx", F.col("priority").cast("int").alias("priority"), F.col("place").cast("int").alias("place"))


@query("review_context", f"WITH {ITEM_SQL}, n AS (SELECT r, max(i) AS last, min(i) AS first FROM item GROUP BY r) SELECT item.r AS receipt_id, i::INT AS item_idx, (4 - CASE WHEN i = first THEN 1 ELSE 0 END - CASE WHEN i = last THEN 1 ELSE 0 END)::INT AS n_lines FROM item JOIN n USING (r)")
def review_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's two lines with one line on either side; line numbers may have gaps."""
    items = doubtful(spark, sf_dir)
    lines = items.select("receipt_id", F.explode("source_line_ids").alias("line_id")).withColumn("text", F.concat(F.lit("t"), F.col("line_id").cast("string")))
    return Q.context(items, lines).select("receipt_id", "item_idx", F.size("context").alias("n_lines"))


@query("review_proposals", f"WITH {ITEM_SQL} SELECT r AS receipt_id, i::INT AS item_idx, CASE WHEN p % 4 = 0 THEN '제안' WHEN p % 2 = 0 THEN NULL ELSE raw END AS normalized_name, CASE WHEN p % 5 = 0 THEN CASE WHEN p % 4 = 0 THEN 2.0 END ELSE 1.0 END::DOUBLE AS quantity, p % 4 <> 0 AND (p % 2 = 0 OR p % 3 = 0 OR p % 5 = 0) AS needs_review FROM due")
def review_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth item gets a name and a quantity from a provider; what it takes settles its doubts."""
    p = F.col("p")
    items = doubtful(spark, sf_dir).withColumns({"normalized_name": F.when(p % 2 != 0, F.col("raw_name")), "quantity": F.when(p % 5 != 0, F.lit(1.0)), "unit": F.lit("개"), "amount": F.lit(100.0), "purchased_at": F.lit("2024-01-01")})
    offered = items.where("p % 4 = 0").select("receipt_id", "item_idx", F.lit("제안").alias("normalized_name"), F.lit("2").alias("quantity"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("amount"))
    return Q.with_proposals(items, offered).select("receipt_id", "item_idx", "normalized_name", "quantity", "needs_review")
