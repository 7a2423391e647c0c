"""Streams: request metrics over event-time windows, job states by key, and running a stream to its end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, work_dir


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet as a stream; new files of that name are taken up as they land."""
    ship(spark)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def windowed_metrics(log: DataFrame, width: str, slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Requests, errors and mean latency by window of event time and endpoint; events later than the watermark are left out."""
    when = F.window("ts", width, slide) if slide else F.window("ts", width)
    return log.withWatermark("ts", watermark).groupBy(when.alias("window"), "endpoint").agg(F.count("*").alias("n"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.avg("elapsed_ms").alias("avg_ms"))


def sessions(log: DataFrame, key: str, gap: str, watermark: str = "10 minutes") -> DataFrame:
    """Sessions of each key: stretches of events no more than `gap` apart."""
    return log.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("window"), key).agg(F.count("*").alias("n"))


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job (trace_id) after each batch: its last status by seq, how many updates it took, events seen.

    A job is `pending` from its first event on; a pending event after that is no update.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, updates, seen, last = state.get if state.exists else ("pending", 0, 0, -1)
        for b in batches:
            b = b.sort_values("seq")
            seen += len(b)
            updates += int((b["status"] != "pending").sum())
            if len(b) and int(b["seq"].iloc[-1]) > last:
                status, last = str(b["status"].iloc[-1]), int(b["seq"].iloc[-1])
        state.update((status, updates, seen, last))
        yield pd.DataFrame([(key[0], status, updates, seen)], columns=["trace_id", "status", "updates", "seen"])

    return events.groupBy("trace_id").applyInPandasWithState(step, "trace_id long, status string, updates long, seen long", "status string, updates long, seen long, last long", "update", "NoTimeout")


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has put out once all its input is taken: batches are written to the shared folder and read again.

    In complete mode the last batch holds all; else all batches do.
    """
    spark = stream.sparkSession
    out = work_dir(spark)
    seen: list[int] = []

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")
        seen.append(batch)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{out}/rows/batch={b}" for b in (seen[-1:] if mode == "complete" else seen)])


def alert_stream(inventory: DataFrame, now, threshold: int = 3) -> DataFrame:
    """Expiry alerts as items come in; stateless."""
    from ..plans import shelf

    return shelf.alerts(shelf.expiry(inventory, now), threshold)
