"""Document fingerprints: digests of byte-triplet counts by quartile, with a bounded difference score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS = 256
#: The largest difference that scores above 0.
SCALE = 300.0
#: What one step of the length code adds to a difference, and the most that length adds.
LENGTH_STEP, LENGTH_MOST = 2, 60
_rng = np.random.default_rng(77)
_MIX = _rng.integers(0, 2**32, (3, 256), dtype=np.uint32)


def counts(data: np.ndarray) -> np.ndarray:
    """How many of the text's byte triplets fall into each bucket; triplets take in bytes up to four apart."""
    total = np.zeros(BUCKETS, np.int64)
    if len(data) < 3:  # no triplet: each byte counts in a bucket of its own value, that of the second byte on the other side
        for k, x in enumerate(data.tolist()):
            total[(x + BUCKETS // 2 * k) % BUCKETS] += 1
        return total
    a, b, c = _MIX[0][data], _MIX[1][data], _MIX[2][data]
    for i, j in ((1, 2), (1, 3), (2, 3)):
        m = len(data) - j
        if m > 0:
            h = a[:m] ^ b[i : i + m] ^ c[j : j + m]
            total += np.bincount(((h * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8), minlength=BUCKETS)
    return total


def codes(data: np.ndarray) -> tuple[int, np.ndarray]:
    """The length code (about seven steps for each doubling) and the quartile, 0 to 3, of every bucket's count."""
    n = len(data)
    length = 0 if not n else 1 + min(254, round(10 * math.log(n)))
    got = counts(data)
    q = np.sort(got)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return length, np.searchsorted(q, got, side="left").astype(np.uint8)


def text_of(length: int, quartiles: np.ndarray) -> str:
    """Two hex digits of length, then two bits for each bucket."""
    q = quartiles.reshape(-1, 4)
    return f"{length:02x}" + (q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).astype(np.uint8).tobytes().hex()


def fingerprint(data: bytes | np.ndarray) -> str:
    return text_of(*codes(np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data))


def difference(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> int:
    """0 for equal codes: the steps between quartiles, opposite ends counted double, and those between lengths, bounded."""
    d = np.abs(x[1].astype(np.int8) - y[1].astype(np.int8))
    return int(d.sum() + 3 * (d == 3).sum()) + min(LENGTH_MOST, LENGTH_STEP * abs(x[0] - y[0]))


def likeness(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> float:
    """1 for equal fingerprints, 0 for a difference of SCALE or more."""
    return 1.0 - min(difference(x, y), SCALE) / SCALE


def parse(text: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    body = raw[1:]
    return int(raw[0]), np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], 1).ravel()


def compare(a: str, b: str) -> float:
    """The likeness of two fingerprints as text."""
    return likeness(parse(a), parse(b))


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a fingerprint column; a null text counts as empty. Equal texts have equal fingerprints."""
    common.ship(docs.sparkSession)

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        data, starts = common.utf8(texts)
        return pa.array([fingerprint(data[s:e]) for s, e in zip(starts[:-1], starts[1:])], pa.string())

    return docs.withColumn(common.free_name(docs, "fingerprint"), of(F.col(text_col)))


def neighbour_ranges(rows: DataFrame, cut: common.Ranges) -> DataFrame:
    """rows (_id, _tie, _text) in ranges; the first row of each range comes also at the end of the range before it (_ghost).

    One key for each range, of which the driver holds MOST_CUTS at most, reaches it. The first range follows the last,
    so the last document has a next one.
    """
    placed = rows.withColumn("_range", cut.number(F.col("_id"), F.col("_tie")))
    firsts = sorted(placed.groupBy("_range").agg(F.min(F.struct("_id", "_tie")).alias("k")).select("_range", "k._id", "k._tie").collect())
    if not firsts:
        return placed.withColumn("_ghost", F.lit(False))
    spots = rows.sparkSession.createDataFrame([(i, t, firsts[k - 1][0]) for k, (_, i, t) in enumerate(firsts)], "_id long, _tie long, _home long")
    # Rows may share the range's first key; the one whose text sorts first is the one that comes first.
    ghosts = placed.drop("_range").join(F.broadcast(spots), ["_id", "_tie"]).groupBy("_id", "_tie", "_home").agg(F.min("_text").alias("_text"))
    return placed.withColumn("_ghost", F.lit(False)).unionByName(ghosts.select("_id", "_tie", "_text", F.col("_home").alias("_range"), F.lit(True).alias("_ghost")))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: n_chars, the edited text, both fingerprints, and the likeness to the edited and to the next text.

    The edited text has its last floor(n_chars/4) code points replaced by the first as many (or all) of the next
    document by ascending id; the first follows the last, and a document alone follows itself. Rows of one id are in
    the order of a hash of their text; a null id comes first, a null text is empty. The texts are dealt once, by ranges
    of about as many bytes, over which one id may spread; a range is walked in order and holds two texts at a time, so
    a very long text is held alone. Only id and text are read, so other columns' names don't matter. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    common.ship(spark)
    kind = docs.schema[id_col].dataType
    rows = common.in_order(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col, []).drop("_rest")
    cut = common.ranges(rows)._replace(inner=1)  # a range is walked, not held, so it may be large
    ranges = neighbour_ranges(rows, cut)
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(row, the row after it) within each range."""
        last = None
        for b in batches:
            for row in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_range", "_ghost", "_id", "_text")]):
                own = (*row, codes(np.frombuffer(row[3].encode(), np.uint8)))
                if last is not None and last[0] == own[0]:
                    yield last, own
                last = own

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for (_, _, i, text, code), (_, _, _, after, next_code) in pairs(batches):
            cut = len(text) // 4
            edited = text[: len(text) - cut] + after[:cut]
            changed = codes(np.frombuffer(edited.encode(), np.uint8))
            out.append((i, len(text), edited, text_of(*code), text_of(*changed), likeness(code, changed), likeness(code, next_code)))
            held += len(edited)
            if held > 1 << 22 or len(out) >= 4096:
                yield batch(out)
                out, held = [], 0
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=names)

    got = ranges.repartition(max(cut.count, common.partitions(spark)), "_range").sortWithinPartitions("_range", "_ghost", "_id", "_tie", "_text").mapInArrow(work, schema)
    return got.withColumn(id_col, F.nullif(F.col(id_col), F.lit(common.LEAST_ID)).cast(kind))
