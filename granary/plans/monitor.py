"""Service monitoring over the events table as a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monitoring
from .registry import query, table

LOG_SQL = """reqlog AS (SELECT event_id AS seq, ts, event_type AS endpoint, value * 20 AS elapsed_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, user_id FROM events),
w AS (SELECT * FROM reqlog WHERE ts > (SELECT max(ts) FROM reqlog) - INTERVAL 7 DAY)"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("endpoint"), (F.col("value") * 20).alias("elapsed_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), "user_id")


def last_week(log: DataFrame) -> DataFrame:
    """The last seven days of the log. The latest time is read first, so that the filter reaches the scan as a literal."""
    now = log.agg(F.max("ts")).first()[0]
    return log.where(F.lit(False)) if now is None else monitoring.in_window(log, F.lit(now).cast(log.schema["ts"].dataType), "7d")


@query("monitor_metrics", f"WITH {LOG_SQL} SELECT count(*)::BIGINT AS n, count(*) FILTER (status_code >= 400)::BIGINT AS errors, round(count(*) FILTER (status_code >= 400) / count(*)::DOUBLE, 4) AS error_rate, round(avg(elapsed_ms), 2) AS avg_ms FROM w")
def monitor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.metrics(last_week(request_log(spark, sf_dir)), []).select("n", "errors", "error_rate", "avg_ms")


@query("monitor_endpoint", f"WITH {LOG_SQL} SELECT endpoint, count(*)::BIGINT AS n, count(*) FILTER (status_code >= 400)::BIGINT AS errors, round(count(*) FILTER (status_code >= 400) / count(*)::DOUBLE, 4) AS error_rate, round(avg(elapsed_ms), 2) AS avg_ms FROM w GROUP BY endpoint")
def monitor_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.metrics(last_week(request_log(spark, sf_dir)), ["endpoint"]).select("endpoint", "n", "errors", "error_rate", "avg_ms")


P95 = "list_sort(list({0}))[least(cast(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1]"


@query("monitor_p95", f"WITH {LOG_SQL} SELECT endpoint, {P95.format('elapsed_ms')} AS p95_ms FROM w GROUP BY endpoint")
def monitor_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.ranked_value(last_week(request_log(spark, sf_dir)), ["endpoint"], "elapsed_ms", 0.95, "p95_ms")


@query("monitor_drift", f"WITH {LOG_SQL}, m AS (SELECT endpoint, count(*) FILTER (status_code >= 400) / count(*)::DOUBLE AS rate, {P95.format('elapsed_ms')} AS p95 FROM w GROUP BY endpoint) SELECT endpoint, CASE WHEN p95 > 5000 THEN 'slow' WHEN rate > 0.3 THEN 'critical' WHEN rate > 0.1 THEN 'degraded' ELSE 'normal' END AS status FROM m")
def monitor_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = last_week(request_log(spark, sf_dir))
    p95 = monitoring.ranked_value(week, ["endpoint"], "elapsed_ms", 0.95, "p95")
    got = monitoring.metrics(week, ["endpoint"]).join(p95, "endpoint")
    return got.select("endpoint", monitoring.drift_status(F.col("errors") / F.col("n"), F.col("p95")).alias("status"))


@query("recent_errors", f"WITH {LOG_SQL} SELECT seq, endpoint, status_code FROM reqlog WHERE status_code >= 400 ORDER BY ts DESC, seq DESC LIMIT 50")
def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.recent_errors(request_log(spark, sf_dir)).select("seq", "endpoint", "status_code")


@query("monitor_tumbling", f"WITH {LOG_SQL} SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, endpoint, count(*)::BIGINT AS n FROM reqlog GROUP BY ALL")
def monitor_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = request_log(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "endpoint").agg(F.count("*").alias("n"))
    return got.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "endpoint", "n")


@query("job_state_latest", f"WITH {LOG_SQL} SELECT user_id, arg_max(endpoint, {{'t': ts, 's': seq}}) AS status, max(seq)::BIGINT AS last_seq, count(*)::BIGINT AS n_events FROM reqlog GROUP BY user_id")
def job_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir)
    state = monitoring.last_state(log, "user_id", ["ts", "seq"], ["endpoint"])
    return state.join(log.groupBy("user_id").agg(F.max("seq").alias("last_seq"), F.count("*").alias("n_events")), "user_id").select("user_id", F.col("endpoint").alias("status"), "last_seq", "n_events")


@query("ring_buffer_tail", f"WITH {LOG_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY ts DESC, seq DESC) AS k FROM reqlog) SELECT endpoint, count(*)::BIGINT AS kept FROM k WHERE k <= 5000 GROUP BY endpoint")
def ring_buffer_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = request_log(spark, sf_dir).select("endpoint", "ts", "seq").orderBy(F.desc("ts"), F.desc("seq")).limit(5000)
    return kept.groupBy("endpoint").agg(F.count("*").alias("kept"))
