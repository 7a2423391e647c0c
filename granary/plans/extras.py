"""Evaluation reports, round trips through files, and streams run over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from ..session import work_dir
from ..sources import files
from ..streaming import monitor as streams
from .registry import query, table


@query("benchmark_grouping_sets", "SELECT l_returnflag AS preprocessor, l_linestatus AS degradation, round(avg(l_discount), 4) AS recall, round(avg(l_tax) FILTER (l_quantity > 10), 4) AS char_accuracy, count(*)::BIGINT AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))")
def benchmark_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("preprocessor"), F.col("l_linestatus").alias("degradation"), F.col("l_discount").alias("recall"), F.when(F.col("l_quantity") > 10, F.col("l_tax")).alias("char_accuracy"))
    return evaluation.grouped_means(lines, [["preprocessor", "degradation"], ["preprocessor"]], ["recall", "char_accuracy"])


@query("eval_grouping", "SELECT l_returnflag AS difficulty, round(avg(l_discount), 4) AS recall, count(*)::BIGINT AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())")
def eval_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("difficulty"), F.col("l_discount").alias("recall"))
    return evaluation.grouped_means(lines, [["difficulty"], []], ["recall"])


F1_SQL = """
e AS (SELECT l_orderkey AS f, l_partkey % 5 AS name, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL),
a AS (SELECT l_orderkey AS f, l_partkey % 5 AS name, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL),
m AS (SELECT coalesce(e.f, a.f) AS f, sum(least(coalesce(e.n, 0), coalesce(a.n, 0))) AS tp, sum(coalesce(e.n, 0)) AS ne, sum(coalesce(a.n, 0)) AS na FROM e FULL JOIN a ON e.f = a.f AND e.name = a.name GROUP BY 1)"""


@query("item_f1", f"WITH {F1_SQL} SELECT f AS file_name, tp::BIGINT AS tp, (na - tp)::BIGINT AS fp, (ne - tp)::BIGINT AS fn, round(CASE WHEN na > 0 THEN tp / na::DOUBLE ELSE 0 END, 4)::DOUBLE AS precision, round(CASE WHEN ne > 0 THEN tp / ne::DOUBLE ELSE 0 END, 4)::DOUBLE AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (na + ne) ELSE 0 END, 4)::DOUBLE AS f1 FROM m")
def item_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_name"), F.col("l_linenumber").alias("k"), F.array((F.col("l_partkey") % 5).cast("string")).alias("names"))
    return evaluation.greedy_f1(lines.where("k % 2 = 1"), lines.where("k % 2 = 0"), "file_name", "k", "names")


@query("field_accuracy", "SELECT count(*)::BIGINT AS n, round(avg((o_orderstatus IS NOT DISTINCT FROM CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'F' END)::INT), 4) AS status_accuracy, round(avg((o_orderpriority IS NOT DISTINCT FROM '5-LOW')::INT), 4) AS priority_accuracy FROM orders")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return evaluation.field_accuracy(orders, {"status_accuracy": (F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 5 != 0, "F")), "priority_accuracy": (F.col("o_orderpriority"), F.lit("5-LOW"))})


@query("csv_roundtrip", "SELECT n_nationkey, n_name FROM nation")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    files.append_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return files.read_csv(spark, path, "n_nationkey int, n_name string")


@query("json_roundtrip", "SELECT s_suppkey, s_name FROM supplier")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    files.write_json(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), path)
    return files.read_json(spark, path, "s_suppkey long, s_name string", multiline=False)


@query("stream_endpoint_metrics", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type AS endpoint, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'error')::BIGINT AS errors FROM events GROUP BY ALL")
def stream_endpoint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log read as a stream, aggregated by day and endpoint, run to its end."""
    log = streams.file_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("endpoint"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), (F.col("value") * 20).alias("elapsed_ms"))
    got = streams.run_to_end(streams.windowed_metrics(log, "1 day", watermark="36500 days"), "complete")
    return got.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "endpoint", "n", "errors")


@query("stream_job_states", "SELECT user_id AS trace_id, arg_max(CASE WHEN event_type = 'view' THEN 'pending' WHEN event_type = 'error' THEN 'failed' ELSE 'running' END, event_id) AS status, count(*) FILTER (event_type <> 'view')::BIGINT AS updates, count(*)::BIGINT AS seen FROM events GROUP BY user_id")
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed job states kept over a stream: every event of a job but views updates it."""
    events = streams.file_stream(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "error", "failed").otherwise("running").alias("status"), F.col("event_id").alias("seq"))
    last = streams.run_to_end(streams.job_states(events), "update")
    return last.groupBy("trace_id").agg(F.max_by("status", "seen").alias("status"), F.max_by("updates", "seen").alias("updates"), F.max("seen").alias("seen"))


@query("stream_sessions", """WITH e AS (SELECT user_id, ts::TIMESTAMP AS t, lag(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT user_id, t, sum(CASE WHEN before IS NULL OR t - before >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, count(DISTINCT k)::BIGINT AS sessions, count(*)::BIGINT AS n FROM s GROUP BY user_id""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a user's events less than twelve hours apart, from a stream run to its end."""
    log = streams.file_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    got = streams.run_to_end(streams.sessions(log, "user_id", "12 hours", watermark="36500 days"), "complete")
    return got.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))
