"""Evaluation: greedy item matching with precision, recall and F1, field accuracy, and means by grouping sets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grouped_means(df: DataFrame, sets: list[list[str]], values: list[str]) -> DataFrame:
    """Means of the values (four decimals, of rows, not of means) and row counts for each grouping set; null where a column isn't in it."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    got = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return got.agg(*[F.round(F.avg(v), 4).alias(v) for v in values], F.count("*").alias("n"))


def name_set(*fields: Column) -> Column:
    """What an item can be called: its filled names, compact and in lower case, each once."""
    return F.array_distinct(F.filter(F.array(*[F.lower(F.regexp_replace(F.coalesce(f, F.lit("")), r"(?U)\s+", "")) for f in fields]), lambda x: x != ""))


def matched_pairs(expected: list[list[str]], actual: list[list[str]]) -> int:
    """How many expected items find an actual one that shares a name, each in turn taking the first that is left."""
    left = [set(a) for a in actual]
    hits = 0
    for e in expected:
        at = next((i for i, a in enumerate(left) if a & set(e)), None)
        if at is not None:
            hits += 1
            del left[at]
    return hits


def greedy_f1(expected: DataFrame, actual: DataFrame, key: str, pos: str, names: str) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 (four decimals) for each file of expected or actual items.

    A file's items are matched one to one in order; each list is as short as the file's items.
    """
    lists = lambda df, name: df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(names).alias("n")))), lambda s: s["n"]).alias(name))
    both = lists(expected, "e").join(lists(actual, "a"), key, "full")

    @F.arrow_udf(T.LongType())
    def hits(e: pa.Array, a: pa.Array) -> pa.Array:
        return pa.array([matched_pairs(x or [], y or []) for x, y in zip(e.to_pylist(), a.to_pylist())], pa.int64())

    sized = both.select(key, hits("e", "a").alias("tp"), F.coalesce(F.size("e"), F.lit(0)).alias("ne"), F.coalesce(F.size("a"), F.lit(0)).alias("na"))
    sized = sized.withColumns({"ne": F.greatest("ne", F.lit(0)), "na": F.greatest("na", F.lit(0))})
    rate = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 4)
    p, r = F.try_divide(F.col("tp"), F.col("na")), F.try_divide(F.col("tp"), F.col("ne"))
    f1 = F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4)
    return sized.select(key, "tp", (F.col("na") - F.col("tp")).cast("long").alias("fp"), (F.col("ne") - F.col("tp")).cast("long").alias("fn"), rate(F.col("tp"), F.col("na")).alias("precision"), rate(F.col("tp"), F.col("ne")).alias("recall"), f1.alias("f1"))


def field_accuracy(df: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """The share of rows whose field is as expected, null for null counting as equal; of no rows, zeros."""
    return df.agg(F.count("*").alias("n"), *[F.coalesce(F.round(F.avg(a.eqNullSafe(b).cast("int")), 4), F.lit(0.0)).alias(n) for n, (a, b) in fields.items()])

