"""Shelf life, expiry risk, alerts and sharing eligibility: the rules, and queries over parts and line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .made import pick, pick_sql
from .registry import query, table

# What may not be shared, by category; what needs a review.
BLOCKED = {
    "생고기/생선": ["생고기", "생선회", "회", "육회", "생닭", "생삼겹", "날고기", "생등심", "생갈비"],
    "개봉 반찬/조리 음식": ["반찬", "조리음식", "밑반찬", "국", "찌개", "볶음", "조림", "무침", "샐러드", "도시락"],
    "유제품(개봉)": ["개봉우유", "개봉요거트"],
}
REVIEW = ["수제", "직접만든", "홈메이드", "집밥", "개봉", "뜯은", "냉장", "냉동", "해동"]

# Days by category and storage, and the items that differ, in the order in which they are tried.
SHELF_LIFE = {
    "정육/계란": ({"냉장": 3, "냉동": 90, "상온": 0}, {"계란": {"냉장": 21}, "달걀": {"냉장": 21}, "삼겹살": {"냉장": 3, "냉동": 60}, "닭가슴살": {"냉장": 2, "냉동": 60}, "소고기": {"냉장": 3, "냉동": 90}}),
    "해산물": ({"냉장": 2, "냉동": 60, "상온": 0}, {"연어": {"냉장": 2, "냉동": 90}, "새우": {"냉장": 2, "냉동": 90}, "오징어": {"냉장": 2, "냉동": 60}}),
    "채소/과일": (
        {"냉장": 7, "냉동": 30, "상온": 5},
        {
            "양파": {"냉장": 30, "상온": 14}, "감자": {"냉장": 21, "상온": 14}, "당근": {"냉장": 14}, "대파": {"냉장": 7}, "시금치": {"냉장": 3}, "상추": {"냉장": 3}, "깻잎": {"냉장": 5},
            "콩나물": {"냉장": 3}, "버섯": {"냉장": 5}, "토마토": {"냉장": 7, "상온": 5}, "사과": {"냉장": 30, "상온": 7}, "바나나": {"상온": 5}, "딸기": {"냉장": 3},
        },
    ),
    "유제품": ({"냉장": 7, "냉동": 30, "상온": 0}, {"우유": {"냉장": 7}, "치즈": {"냉장": 30}, "버터": {"냉장": 60, "냉동": 180}, "요구르트": {"냉장": 14}}),
    "가공식품": ({"냉장": 14, "냉동": 60, "상온": 30}, {"두부": {"냉장": 5}, "어묵": {"냉장": 7, "냉동": 60}, "햄": {"냉장": 14}, "소시지": {"냉장": 14}, "만두": {"냉동": 90}}),
    "쌀/면/빵": ({"냉장": 7, "냉동": 90, "상온": 30}, {"빵": {"냉장": 5, "상온": 3}, "쌀": {"상온": 180}, "라면": {"상온": 180}}),
    "소스/조미료/오일": ({"냉장": 180, "상온": 180}, {"간장": {"상온": 365}, "된장": {"냉장": 90}, "고추장": {"냉장": 90}, "식용유": {"상온": 365}, "참기름": {"상온": 180}}),
    "김치/절임": ({"냉장": 30, "상온": 7}, {"김치": {"냉장": 30}}),
}
# Days by category and storage of the second engine, and what to do at each risk.
DEFAULT_DAYS = {
    ("vegetable", "room"): 7, ("fruit", "room"): 7, ("dairy", "refrigerated"): 7, ("meat", "refrigerated"): 3, ("seafood", "refrigerated"): 2, ("egg", "refrigerated"): 14, ("tofu_bean", "refrigerated"): 5,
    ("sauce", "room"): 30, ("sauce", "refrigerated"): 14, ("beverage", "room"): 30, ("beverage", "refrigerated"): 7, ("frozen", "frozen"): 30, ("other", "room"): 7,
}
ADVICE = {"safe": "보관", "consume_soon": "오늘 소비", "urgent": "오늘 소비 우선", "share_now": "나눔 등록 권장"}
EXPIRED_ADVICE = "폐기 검토"
FALLBACK_DAYS = 7


def sharing_status(df: DataFrame, name: str) -> DataFrame:
    """df with status (blocked, review_required, allowed), category and matched word; the leftmost, first listed word decides."""
    blocked, review = "|".join(k for own in BLOCKED.values() for k in own), "|".join(REVIEW)
    hit, doubt = F.nullif(F.regexp_extract(name, f"(?i)({blocked})", 1), F.lit("")), F.nullif(F.regexp_extract(name, f"(?i)({review})", 1), F.lit(""))
    category = F.coalesce(*[F.when(hit.isin(*own), F.lit(c)) for c, own in BLOCKED.items()])
    status = F.when(hit.isNotNull(), "blocked").when(doubt.isNotNull(), "review_required").otherwise("allowed")
    return df.withColumns({"status": status, "category": category, "matched": F.coalesce(hit, doubt)})


def sharing_counts(df: DataFrame, status: str = "status") -> DataFrame:
    names = ("blocked", "review_required", "allowed")
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == n).alias(n) for n in names])


def storage_days(days: dict[str, int], storage: Column) -> Column:
    """The days of a storage; of none, those of the cold one; else the fallback."""
    out = F.lit(days.get("냉장", FALLBACK_DAYS))
    for k, v in days.items():
        out = F.when(storage == k, v).otherwise(out)
    return out


def shelf_days(name: Column, storage: Column, category: Column) -> Column:
    """Days that an item keeps: by the first listed item in its name; only without one by category, contained either way.

    An item that is found but has neither the storage nor the cold one keeps for the fallback; no category is tried then.
    """
    out = F.lit(FALLBACK_DAYS)
    for label, (days, _) in reversed(SHELF_LIFE.items()):
        related = F.coalesce(category, F.lit("")) != ""
        out = F.when(related & (F.contains(category, F.lit(label)) | F.contains(F.lit(label), category)), storage_days(days, storage)).otherwise(out)
    for item, days in reversed([(i, d) for _, items in SHELF_LIFE.values() for i, d in items.items()]):
        out = F.when(F.contains(name, F.lit(item)), storage_days(days, storage)).otherwise(out)
    return out


def expiry(df: DataFrame, now: Column, name: str = "item_name", purchased: str = "purchase_date", storage: str = "storage_method", category: str = "category") -> DataFrame:
    """df with shelf_days, expiry_date, d_day and risk. d_day counts whole days from the moment `now` to the expiry's midnight.

    A purchase date that doesn't parse is that of `now`. On the day of expiry d_day is -1 already, which counts as expired.
    """
    days = shelf_days(F.col(name), F.col(storage), F.col(category))
    bought = F.coalesce(F.try_to_date(F.col(purchased), "yyyy-MM-dd"), now.cast("date"))
    got = df.withColumn("shelf_days", days).withColumn("expiry_date", F.date_add(bought, F.col("shelf_days")))
    left = F.floor((F.unix_timestamp(F.col("expiry_date").cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))) / 86400).cast("int")
    return got.withColumn("d_day", left).withColumn("risk", risk_by_day(F.col("d_day")))


def risk_by_day(d: Column) -> Column:
    return F.when(d < 0, "expired").when(d <= 1, "danger").when(d <= 3, "caution").otherwise("safe")


def alerts(df: DataFrame, threshold: int = 3) -> DataFrame:
    """Rows due within `threshold` days; a missing d_day counts as far away. Works on a stream as on a table."""
    message = F.when(F.col("d_day") < 0, F.concat("item_name", F.lit(" 유통기한이 지났습니다"))).otherwise(F.concat("item_name", F.lit(" D-"), F.col("d_day").cast("string")))
    return df.where(F.coalesce("d_day", F.lit(999)) <= threshold).withColumn("message", message)


def inventory_risk(df: DataFrame, as_of: Column, purchased: str = "purchased_at", category: str = "category", storage: str = "storage_type") -> DataFrame:
    """df with days_since_purchase, shelf_days, risk_level, cta and is_expired, by the second engine's table."""
    days = F.lit(DEFAULT_DAYS["other", "room"])
    for (c, s), n in reversed(DEFAULT_DAYS.items()):
        days = F.when((F.col(category) == c) & (F.col(storage) == s), n).otherwise(days)
    since = F.datediff(as_of, F.col(purchased).cast("date"))
    got = df.withColumn("days_since_purchase", since).withColumn("shelf_days", days)
    left = F.col("shelf_days") - F.col("days_since_purchase")
    risk = F.when(left >= 4, "safe").when(left >= 2, "consume_soon").when(left >= 1, "share_now").otherwise("urgent")
    got = got.withColumn("risk_level", risk).withColumn("is_expired", left < 0)
    cta = F.lit(EXPIRED_ADVICE)
    for k, v in ADVICE.items():
        cta = F.when(~F.col("is_expired") & (F.col("risk_level") == k), v).otherwise(cta)
    return got.withColumn("cta", cta)


SHARED = ["김치찌개", "생닭 1kg", "개봉우유", "수제 잼", "사과", "냉동 만두", "홈메이드 샐러드", "라면", "뜯은 과자"]
SHARED_SQL = f"""made AS (SELECT p_partkey, {pick_sql(SHARED, 'p_partkey')} AS name FROM part),
hit AS (SELECT *, nullif(regexp_extract(name, '({'|'.join(k for own in BLOCKED.values() for k in own)})', 1), '') AS b, nullif(regexp_extract(name, '({'|'.join(REVIEW)})', 1), '') AS d FROM made),
shared AS (SELECT p_partkey, name, CASE WHEN b IS NOT NULL THEN 'blocked' WHEN d IS NOT NULL THEN 'review_required' ELSE 'allowed' END AS status, coalesce(b, d) AS matched FROM hit)"""


@query("sharing_filter", f"WITH {SHARED_SQL} SELECT p_partkey, status, matched FROM shared")
def sharing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", pick(SHARED, F.col("p_partkey")).alias("name"))
    return sharing_status(named, "name").select("p_partkey", "status", "matched")


@query("sharing_summary", f"WITH {SHARED_SQL} SELECT count(*)::BIGINT AS total, count(*) FILTER (status = 'blocked')::BIGINT AS blocked, count(*) FILTER (status = 'review_required')::BIGINT AS review_required, count(*) FILTER (status = 'allowed')::BIGINT AS allowed FROM shared")
def sharing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharing_counts(sharing_filter(spark, sf_dir))


KEPT = ["국산 계란 10구", "삼겹살", "연어회", "양파", "우유", "두부", "이름 없는 것", "쌀 10kg", "김치"]
KEPT_IN, KEPT_AS = ["냉장", "냉동", "상온", "진공"], ["정육/계란", "해산물", "", "소스", "유제품", None]


def days_sql(days: dict[str, int]) -> str:
    return "CASE storage " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in days.items()) + f" ELSE {days.get('냉장', FALLBACK_DAYS)} END"


KEEP_SQL = f"""kept AS (SELECT l_orderkey, l_linenumber, {pick_sql(KEPT, 'l_partkey')} AS name, {pick_sql(KEPT_IN, 'l_linenumber')} AS storage, ([{', '.join('NULL' if c is None else f"'{c}'" for c in KEPT_AS)}])[l_orderkey % {len(KEPT_AS)} + 1] AS category, CASE WHEN l_linenumber = 3 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS bought FROM lineitem),
days AS (SELECT *, CASE {' '.join(f"WHEN contains(name, '{i}') THEN {days_sql(d)}" for _, items in SHELF_LIFE.values() for i, d in items.items())} {' '.join(f"WHEN coalesce(category, '') <> '' AND (contains(category, '{c}') OR contains('{c}', category)) THEN {days_sql(d)}" for c, (d, _) in SHELF_LIFE.items())} ELSE {FALLBACK_DAYS} END AS shelf_days FROM kept)"""


@query("expiry_dates", f"WITH {KEEP_SQL}, e AS (SELECT *, coalesce(try_cast(bought AS DATE), DATE '1996-06-15') + shelf_days::INT AS until FROM days) SELECT l_orderkey, l_linenumber::INT AS l_linenumber, shelf_days::INT AS shelf_days, strftime(until, '%Y-%m-%d') AS expiry_date, floor((epoch(until::TIMESTAMP) - epoch(TIMESTAMP '1996-06-15 10:00:00')) / 86400)::INT AS d_day, CASE WHEN until <= DATE '1996-06-15' THEN 'expired' WHEN until - DATE '1996-06-15' <= 2 THEN 'danger' WHEN until - DATE '1996-06-15' <= 4 THEN 'caution' ELSE 'safe' END AS risk FROM e")
def expiry_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first engine over lines as stock: by item, else by category, counted in whole days from ten in the morning."""
    line = table(spark, sf_dir, "lineitem")
    category = F.get(F.array(*[F.lit(c) for c in KEPT_AS]), (F.col("l_orderkey") % len(KEPT_AS)).cast("int"))
    bought = F.when(F.col("l_linenumber") == 3, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    kept = line.select("l_orderkey", "l_linenumber", pick(KEPT, F.col("l_partkey")).alias("item_name"), pick(KEPT_IN, F.col("l_linenumber")).alias("storage_method"), category.alias("category"), bought.alias("purchase_date"))
    got = expiry(kept, F.lit("1996-06-15 10:00:00").cast("timestamp"))
    return got.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "shelf_days", F.date_format("expiry_date", "yyyy-MM-dd").alias("expiry_date"), "d_day", "risk")


LINE_SQL = """line AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE AS bought, CASE l_returnflag WHEN 'A' THEN 'dairy' WHEN 'R' THEN 'meat' ELSE 'sauce' END AS category, CASE WHEN l_linenumber % 2 = 0 THEN 'refrigerated' ELSE 'room' END AS storage FROM lineitem),
r AS (SELECT *, CASE WHEN category = 'dairy' AND storage = 'refrigerated' THEN 7 WHEN category = 'meat' AND storage = 'refrigerated' THEN 3 WHEN category = 'sauce' AND storage = 'room' THEN 30 WHEN category = 'sauce' THEN 14 ELSE 7 END AS days FROM line),
e AS (SELECT *, days - (DATE '1998-01-10' - bought) AS left_days FROM r)"""


def stocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("purchased_at"),
        F.when(F.col("l_returnflag") == "A", "dairy").when(F.col("l_returnflag") == "R", "meat").otherwise("sauce").alias("category"),
        F.when(F.col("l_linenumber") % 2 == 0, "refrigerated").otherwise("room").alias("storage_type"),
    )
    return inventory_risk(lines, F.lit("1998-01-10").cast("date"))


@query("expiry_rule", f"WITH {LINE_SQL} SELECT category, storage, days, count(*)::BIGINT AS n FROM r GROUP BY ALL")
def expiry_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stocked(spark, sf_dir).groupBy("category", F.col("storage_type").alias("storage"), F.col("shelf_days").alias("days")).agg(F.count("*").alias("n"))


@query("expiry_bucket", f"WITH {LINE_SQL} SELECT CASE WHEN left_days >= 4 THEN 'safe' WHEN left_days >= 2 THEN 'consume_soon' WHEN left_days >= 1 THEN 'share_now' ELSE 'urgent' END AS risk_level, left_days < 0 AS is_expired, count(*)::BIGINT AS n FROM e GROUP BY ALL")
def expiry_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stocked(spark, sf_dir).groupBy("risk_level", "is_expired").agg(F.count("*").alias("n"))


@query("expiry_alerts", f"WITH {LINE_SQL} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, left_days::INT AS d_day, CASE WHEN left_days < 0 THEN 'expired' WHEN left_days <= 1 THEN 'danger' ELSE 'caution' END AS risk FROM e WHERE left_days <= 3")
def expiry_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = stocked(spark, sf_dir).withColumn("d_day", (F.col("shelf_days") - F.col("days_since_purchase")).cast("int")).withColumn("item_name", F.col("l_partkey").cast("string"))
    return alerts(due).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "d_day", risk_by_day(F.col("d_day")).alias("risk"))
