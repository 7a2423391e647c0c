"""Best row of a group, top rows, quotas and surrogate numbers; ties always go by an explicit position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored


def keep_best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in `order`. The rows of a key are combined before the shuffle, so no key is hot.

    order: what to compare by, smallest first (negate for largest); the last should be unique within a key.
    """
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_best"))
    return best.select("_best.*")


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes last in `order`: a map that later rows overwrite."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_best"))
    return best.select("_best.*")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; each task keeps k of its own."""
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with their rank from 1. Spark keeps k rows of a group in each task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def quota_top(df: DataFrame, group: str, k: int, quota: int, *order: Column) -> DataFrame:
    """The first k rows with at most `quota` of a group, filled up with the rest in order if too few are left.

    The same as walking the rows in order and passing over full groups: rows above their group's quota sort behind.
    Each group sends k rows at most, so the last sort is of k rows a group.
    """
    ranked = top_per_group(df, [group], k, *order).withColumn("over_quota", (F.col("rank") > quota).cast("int"))
    return ranked.orderBy("over_quota", *order).limit(k)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with gapless numbers from 1 in the given order, without bringing all rows into one task.

    Rows are dealt into sorted ranges once and written to the shared folder with their place in their range, so that the
    counts of the ranges, of which the driver adds up one number for each, are those of the very rows that are numbered.
    An empty table gives no rows; rows that tie in all of `order` are numbered in any order.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    at, begin = "_at", "_begin"
    while {at, begin} & set(df.columns):
        at, begin = at + "_", begin + "_"
    ranged = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    sizes = sorted(ranged.groupBy(part.alias("p")).agg(F.max(place).alias("last")).collect())
    offsets, total = {}, 0
    for p, last in sizes:
        offsets[p], total = total, total + last + 1
    starts = spark.createDataFrame(list(offsets.items()), "_part long, _start long")  # one row for each shuffle partition
    met = ranged.withColumn(begin, part).join(F.broadcast(starts), F.col(begin) == F.col("_part"))
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("_start") + place + 1).cast("long").alias(name))
