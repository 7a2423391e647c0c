"""Global shuffling into shards in two passes: records are scattered over memory-sized buckets, then each is shuffled."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Text bytes of a bucket, which one task holds at a time.
BUCKET_BYTES = 8 << 20


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniformly random order of n rows; the seed decides it."""
    rng = np.random.default_rng(seed)
    order = np.arange(n)
    picks = (rng.random(max(n - 1, 0)) * np.arange(n, 1, -1)).astype(np.int64)
    out = order.tolist()
    for i, j in zip(range(n - 1, 0, -1), picks.tolist()):
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def shuffle_into_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of df, with shard (from 0) and slot (gapless from 0 in each shard); shard sizes differ by one row at most.

    Pass one scatters whole records by a seeded hash of the row and copy number over buckets of about bucket_bytes, so
    rows of one id, or without one, scatter as any others do. Pass two shuffles each bucket by Fisher-Yates, seeded by
    the bucket; a partition holds one bucket, or several one after the other where there are more buckets than
    MOST_PARTITIONS. A bucket's rows follow those of the buckets before it in one global order, of which shard s holds
    a contiguous share. Equal seeds and tables give equal shards whatever the partitioning. Null ids and texts are
    ordinary values; a very long text fills a bucket of its own; an empty table gives no rows; columns named shard or
    slot stay, and the new ones get an underscore more.
    """
    spark = df.sparkSession
    common.ship(spark)
    mark, salt, bucket, part, shard, slot = (common.free_name(df, n) for n in ("_mark", "_salt", "_bucket", "_part", "shard", "slot"))
    n = max(common.partitions(spark), math.ceil(common.text_bytes(df, text_col) / bucket_bytes))
    each = math.ceil(n / max(common.partitions(spark), common.MOST_PARTITIONS))
    parts = math.ceil(n / each)
    salted = common.copies_told_apart(df, mark, salt)
    home = F.pmod(F.xxhash64(F.lit(seed), F.col(mark), F.col(salt)), F.lit(n))
    placed = salted.withColumn(bucket, home).withColumn(part, F.floor(F.col(bucket) / each).cast("int"))
    # One row for each partition: where its rows begin in the global order.
    counts = dict(placed.groupBy(part).count().collect())
    begin = np.zeros(parts + 1, np.int64)
    begin[1:] = np.cumsum([counts.get(b, 0) for b in range(parts)])
    total = int(begin[-1])
    edge = np.array([total * s // shards for s in range(shards + 1)], np.int64)
    out = T.StructType([*df.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(slot, T.LongType())])

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto, now = 0, -1
        for b, t in common.groups(batches, bucket):
            if b // each != now:
                now = int(b // each)
                upto = int(begin[now])
            order = fisher_yates(t.num_rows, seed * 1_000_003 + int(b))
            at = upto + np.arange(t.num_rows)
            upto += t.num_rows
            home = np.searchsorted(edge, at, side="right") - 1
            t = t.combine_chunks().take(pa.array(order)).drop_columns([mark, salt, bucket, part])
            t = t.append_column(shard, pa.array(home.astype(np.int32))).append_column(slot, pa.array(at - edge[home]))
            yield from t.to_batches(max_chunksize=4096)

    # The order before the shuffle must be the same in every attempt; copies that tie are alike.
    return placed.repartition(parts, part).sortWithinPartitions(bucket, mark, salt).mapInArrow(shuffle, out)


def write_shards(df: DataFrame, path: str, shards: int, **options) -> None:
    """Write the shuffled rows as Parquet, one folder for each shard; rows keep their slot."""
    shuffle_into_shards(df, shards, **options).write.partitionBy("shard").parquet(path)
