"""Request metrics over a look-back window, tail latency, drift status, recent errors and last states."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_RATE, CRITICAL_RATE, SLOW_MS = 0.1, 0.3, 5000.0
#: What a service is held to, and what to do where a part of it fails.
THRESHOLDS = {"ocr_confidence_min": 0.80, "match_similarity_min": 0.50, "expiry_alert_days": 3}
FALLBACKS = {"ocr_timeout": {"action": "manual_input", "timeout_sec": 30}, "gpt_unavailable": {"action": "rule_based_fallback"}, "low_confidence": {"action": "review_queue", "threshold": 0.60}}
#: How fine the sketches are that bracket a rank: off by one in SKETCH rows at most.
SKETCH = 2000
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(window: str) -> int:
    """Seconds of a window such as 30s, 5m, 1h or 7d; one unit without a number, an hour if the unit is unknown."""
    m = re.fullmatch(r"(\d*)([smhd])", window.strip())
    return int(m[1] or 1) * UNITS[m[2]] if m else 3600


def nearest_rank(values: Column, share: float) -> Column:
    """The value at zero-based position min(int(n * share), n - 1) of the sorted values."""
    n = F.size(values)
    return F.try_element_at(F.sort_array(values), F.least((F.floor(n * share)).cast("int"), n - 1) + 1)


def ranked_value(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The value at position min(int(n * share), n - 1) of each key, exactly, however many rows a key has.

    Mergeable sketches bracket the value first; then what is below the bracket is only counted, and only the values
    inside it, a few thousandths of all, are put in order. Without keys the answer is one row, of no rows none.
    """
    from pyspark.sql import Window as W

    near = 4 / SKETCH
    one = df.withColumn("_one", F.lit(1)) if not keys else df
    by = keys or ["_one"]
    rows = one.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    bracket = F.percentile_approx("_v", [max(0.0, share - near), min(1.0, share + near)], SKETCH)
    sketch = rows.groupBy(*by).agg(F.count("*").alias("_n"), bracket.alias("_b"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    low = F.when(F.lit(share) <= near, F.col("_lo")).otherwise(F.col("_b")[0])
    high = F.when(F.lit(share) >= 1 - near, F.col("_hi")).otherwise(F.col("_b")[1])
    place = F.least(F.floor(F.col("_n") * share), F.col("_n") - 1) + 1
    met = rows.join(sketch.select(*by, low.alias("_from"), high.alias("_to"), place.alias("_place")), by)
    counted = met.where(F.col("_v") <= F.col("_to")).groupBy(*by, F.when(F.col("_v") >= F.col("_from"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"), F.min("_place").alias("_place"))
    ran = counted.withColumn("_upto", F.sum("_c").over(W.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first())))
    return ran.where((F.col("_upto") >= F.col("_place")) & F.col("_v").isNotNull()).groupBy(*by).agg(F.min("_v").alias(name)).select(*keys, name)


def in_window(df: DataFrame, now: Column, window: str) -> DataFrame:
    """Events strictly later than now less the window."""
    return df.where(F.col("ts") > now - F.make_interval(secs=F.lit(seconds(window))))


def metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, errors (status 400 and above), error rate and mean latency, by key."""
    got = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.avg("elapsed_ms").alias("avg_ms"))
    return got.withColumn("error_rate", F.round(F.try_divide("errors", "n"), 4)).withColumn("avg_ms", F.round("avg_ms", 2))


def drift_status(error_rate: Column, p95: Column) -> Column:
    """Slow outranks critical, critical outranks degraded."""
    return F.when(p95 > SLOW_MS, "slow").when(error_rate > CRITICAL_RATE, "critical").when(error_rate > ERROR_RATE, "degraded").otherwise("normal")


def recent_errors(df: DataFrame, limit: int = 50) -> DataFrame:
    return df.where(F.col("status_code") >= 400).orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def thresholds(**changes: float) -> dict[str, float]:
    """The service's thresholds with some changed."""
    return {**THRESHOLDS, **changes}


def fallback(policy: str, policies: dict[str, dict] = FALLBACKS, **changes: object) -> dict[str, dict] | None:
    """A policy with some of it changed, by its name; None for one that isn't there."""
    return {policy: {**policies[policy], **changes}} if policy in policies else None


def last_state(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The fields of each key's last event."""
    return df.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("s")).select(key, "s.*")
