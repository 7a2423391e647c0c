"""Shared helpers: reading tables, the shared work folder, shipping code, and splitting a table into id ranges."""

from __future__ import annotations

import ctypes
import functools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, ship, stored, work_dir

__all__ = ["discard", "ship", "stored", "work_dir"]

#: Text bytes that one range of documents should hold; a task works on one range at a time. Ranges grow with the table, up
#: to MOST_BYTES. The driver holds MOST_CUTS cuts at most; beyond that a range between two cuts is split evenly by id.
RANGE_BYTES, MOST_BYTES, MOST_CUTS = 4 << 20, 64 << 20, 20_000
#: Rows that the cuts are worked out from, for each cut; a row is taken with a chance in proportion to its bytes.
SAMPLED = 40
#: Text bytes for each bucket of hashes, whose hashes are about as many bytes; a task sorts one bucket at a time. Beyond
#: MOST_BUCKETS buckets grow with the table.
HASHED_BYTES, MOST_BUCKETS = 16 << 20, 200_000
#: Rows of a few numbers that are sent to every task, some ten megabytes; tables are counted before.
FEW = 250_000
#: Partitions of an exchange at most; a partition holds several ranges or buckets, one after the other, beyond that.
MOST_PARTITIONS = 20_000
LEAST_ID = -(2**63)
TIE_BITS = 47


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. The code that workers import is shipped first."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task, perhaps of another stage, beside those that run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def light(work: Callable) -> Callable:
    """A function over Arrow batches, which gives its freed memory back once its task has had all rows."""

    @functools.wraps(work)
    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return worked


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(df: DataFrame, text: str) -> int:
    got = df.agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{text}`")).cast("long"), F.lit(0)) + 1)).first()[0]
    return int(got or 0)


def long_id(id_col: str) -> Column:
    """The id as a number; a null id is the least of all."""
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LEAST_ID))


def joined(many: DataFrame, few: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """many joined to few on a key of which few has one row and `weight` says how many rows of many have it, `total` in all.

    few is stored and counted first. FEW rows or less are sent to every task. Of more, those that stand for over a
    thousandth of many, fewer than a thousand, are sent; the others are met by a shuffle in which no key is hot.
    """
    few = stored(few)
    if few.count() <= FEW:
        return many.join(F.broadcast(few), key)
    limit = max(total // 1000, 100)
    hot = F.broadcast(few.where(F.col(weight) > limit))
    rest = many.join(hot.select(key), key, "left_anti").join(few.where(F.col(weight) <= limit), key)
    return many.join(hot, key).unionByName(rest)


def hashed(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])


def copies_told_apart(df: DataFrame, mark: str, salt: str) -> DataFrame:
    """df with a mark, the hash of the row, and a salt that is 0, but numbers the copies of rows that come more than once.

    Repeated marks are found from the marks alone. Their rows are grouped over all columns, which counts copies before
    the shuffle, and dealt out again; so even copies that make up a third of all rows scatter evenly, and the same table
    gives the same salts on any cluster.
    """
    again, n = free_name(df, "_again"), free_name(df, "_n")
    marked = df.withColumn(mark, hashed(df))
    repeated = marked.groupBy(F.col(mark).alias(again)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(again)
    if repeated.isEmpty():
        return marked.withColumn(salt, F.lit(0))
    match = F.col(mark) == F.col(again)
    once = marked.join(repeated, match, "left_anti").withColumn(salt, F.lit(0))
    every = [F.col(f"`{c}`") for c in marked.columns]
    more = marked.join(repeated, match, "left_semi").groupBy(*every).agg(F.count("*").alias(n))
    return once.unionByName(more.select(*every, F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))).alias(salt)))


def in_order(docs: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """_id, _tie, _text and _rest (a struct of other columns) of every row, which is in the order of id, then tie, then text.

    The tie is 31 bits of a hash of the text, then 16 that tell equal rows apart, so rows of one id spread over ranges.
    """
    mark, salt = free_name(docs, "_mark"), free_name(docs, "_salt")
    high = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), 33)
    return copies_told_apart(docs, mark, salt).select(
        long_id(id_col).alias("_id"),
        F.shiftleft(high, 16).bitwiseOR(F.pmod(F.col(salt).cast("long"), F.lit(1 << 16))).alias("_tie"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest") if rest else F.lit(None).cast("int").alias("_rest"),
    )


class Ranges(NamedTuple):
    """Ascending cuts (id, tie) that split a table into groups of about as many bytes, and into how many ranges each is split again.

    A cut is the first key of its group. An id may lie in several ranges, so a hot or null id is spread over tasks.
    low and high are the ids between which a group lies: it is split evenly by id, or by tie if all of it is one id.
    """

    ids: np.ndarray
    ties: np.ndarray
    low: np.ndarray
    high: np.ndarray
    inner: int = 1

    @property
    def count(self) -> int:
        return (len(self.ids) + 1) * self.inner

    def head(self, number: int) -> int | None:
        """The id that a range begins with, if rows of that id may lie in the range before it."""
        group, k = divmod(number, self.inner)
        if k and self.low[group] == self.high[group] or not k and group:
            return int(self.low[group])
        return None

    def tail(self, number: int) -> int:
        """The id whose rows may go on in the range after."""
        return int(self.high[number // self.inner])

    def number(self, id_col: Column, tie_col: Column) -> Column:
        """The number of the range that a key lies in."""
        known, begin = np.unique(self.ids, return_index=True)
        first = np.append(begin, len(self.ids))
        keys = np.repeat(np.arange(len(known)), np.diff(first)) * (1 << TIE_BITS) + self.ties
        low, high, inner = self.low.astype(np.float64), self.high.astype(np.float64), self.inner

        @F.arrow_udf("long")
        def place(ids: pa.Array, ties: pa.Array) -> pa.Array:
            i, t = ids.to_numpy(zero_copy_only=False), ties.to_numpy(zero_copy_only=False)
            k = np.searchsorted(known, i)
            own = k < len(known)
            own[own] = known[k[own]] == i[own]
            got = first[k].astype(np.int64)
            got[own] = np.searchsorted(keys, k[own] * (1 << TIE_BITS) + t[own], side="right")
            if inner > 1:
                a, b = low[got], high[got]
                share = np.where(b > a, (i - a) / np.maximum(b - a, 1), t / float(1 << TIE_BITS))
                got = got * inner + np.clip(share * inner, 0, inner - 1).astype(np.int64)
            return pa.array(got)

        return place(id_col, tie_col)


def ranges(rows: DataFrame) -> Ranges:
    """Ranges of the keys (_id, _tie) of rows in_order by bytes, one for each shuffle partition at least.

    The cuts come from a sample of about SAMPLED rows a cut, in which a row's chance grows with its bytes; they decide
    how even the ranges are, never what is in the result.
    """
    total = text_bytes(rows, "_text")
    n = max(partitions(rows.sparkSession), math.ceil(total / min(MOST_BYTES, max(RANGE_BYTES, total // MOST_CUTS))))
    cuts = min(n, MOST_CUTS)
    none = np.zeros(0, np.int64)
    whole = Ranges(none, none, np.array([LEAST_ID]), np.array([2**63 - 1]))
    if cuts < 2 or not total:
        return whole
    size = (F.octet_length("_text") + 1).cast("long").alias("b")
    picked = rows.select("_id", "_tie", size).where(F.rand(7) * float(total) < F.col("b") * float(SAMPLED * cuts)).toArrow()
    i, t, b = (picked.column(c).to_numpy() for c in ("_id", "_tie", "b"))
    if not len(i):
        return whole
    order = np.lexsort((t, i))
    weight = np.cumsum(np.maximum(b[order], total / (SAMPLED * cuts)))
    at = np.unique(np.minimum(np.searchsorted(weight, weight[-1] * np.arange(1, cuts) / cuts), len(order) - 1))
    keys = np.unique(np.stack([i[order][at], t[order][at]], 1), axis=0)
    ids = keys[:, 0].copy()
    return Ranges(ids, keys[:, 1].copy(), np.append(i.min(), ids), np.append(ids, i.max()), math.ceil(n / cuts))


def bucket_count(df: DataFrame, text_col: str) -> int:
    """How many buckets of hashes the windows of a table are dealt into."""
    return max(partitions(df.sparkSession), min(MOST_BUCKETS, math.ceil(text_bytes(df, text_col) / HASHED_BYTES)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each text begins, plus the end. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(starts):
        starts = np.zeros(1, np.int64)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `target` bytes each; a longer text is a run of its own."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + target, side="right")) - 1)
        yield i, min(j, n)
        i = j


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows of equal key, from batches that are sorted by it. Only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if held and keys[s] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[s]
            held.append(b.slice(s, e - s))
    if held:
        yield now, pa.Table.from_batches(held)
