"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window, repeats cut out as maximal intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .first_seen import mark_repeats

WINDOW = 13


def joined(data: np.ndarray, first: np.ndarray, last: np.ndarray, row: np.ndarray, rows: int, glue: int) -> pa.Array:
    """The spans of each row, joined by one byte, as a text column."""
    size = (last - first) + 1
    ends = np.cumsum(size)
    begin = ends - size
    total = int(ends[-1]) if len(ends) else 0
    out = np.full(total, glue, np.uint8)
    if total:
        source = np.arange(total, dtype=np.int64) + np.repeat(first - begin, size)
        inner = np.ones(total, bool)
        inner[ends - 1] = False
        out[inner] = data[source[inner]]
    upto = np.zeros(rows + 1, np.int64)
    upto[1:] = np.cumsum(np.bincount(row, weights=size, minlength=rows)).astype(np.int64)
    # Each row ends with a byte of glue, which is left out.
    keep = np.ones(total, bool)
    filled = np.flatnonzero(upto[1:] > upto[:-1])
    keep[upto[1:][filled] - 1] = False
    lengths = upto[1:] - upto[:-1]
    lengths[filled] -= 1
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(out[keep].tobytes())).cast(pa.string())


def intervals(gone: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """Maximal runs of removed positions of each row, as lists of (start, stop) that count from the row's first position."""
    starts_of_row = np.searchsorted(row, np.arange(rows))
    edge = np.ones(len(row), bool)
    edge[1:] = row[1:] != row[:-1]
    before = np.zeros(len(gone), bool)
    before[1:] = gone[:-1]
    begin = np.flatnonzero(gone & (~before | edge))
    after = np.zeros(len(gone), bool)
    after[:-1] = gone[1:]
    last_of_row = np.ones(len(row), bool)
    last_of_row[:-1] = edge[1:]
    end = np.flatnonzero(gone & (~after | last_of_row)) + 1
    owner = row[begin]
    pairs = pa.StructArray.from_arrays([pa.array((begin - starts_of_row[owner]).astype(np.int32)), pa.array((end - starts_of_row[owner]).astype(np.int32))], names=["start", "stop"])
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def result(t: pa.Table, text: pa.Array, counts: np.ndarray, gone: np.ndarray, row: np.ndarray) -> pa.Table:
    rows = t.num_rows
    lost = np.bincount(row[gone], minlength=rows).astype(np.int64)
    return pa.table([t.column("_rest"), text, pa.array(counts.astype(np.int64)), pa.array(lost), intervals(gone, row, rows)], names=["_rest", "text", "n", "lost", "removed"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """docs with each word removed that a window of `size` words covers which also starts in a document of a smaller id.

    The text becomes the kept words, joined by one space; n_words and n_removed count the words before and those cut,
    and removed holds the maximal removed intervals (start, stop) in words. Windows are judged on the input. A null or
    empty text has no words and becomes an empty text, a text of fewer than `size` words stays whole, rows of one id
    don't cut each other, and a null id counts as the smallest. Names that docs has already get an underscore more.
    """

    def find(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, row, _, _ = words.words(data, starts)
        got, at = words.windows(h, row, size)
        return got, words.second_windows(h, at, size), row[at]

    def finish(t: pa.Table, mask: np.ndarray) -> pa.Table:
        data, starts = common.utf8(t.column("_text"))
        first, last, row = words.word_spans(data, starts)
        n = len(first) - size + 1
        at = np.flatnonzero(row[:n] == row[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
        gone = words.covered(at[mask], size, len(first))
        keep = ~gone
        text = joined(data, first[keep], last[keep], row[keep], t.num_rows, 0x20)
        return result(t, text, np.bincount(row, minlength=t.num_rows), gone, row)

    return with_columns(docs, text_col, mark_repeats(docs, id_col, text_col, find, finish, schema_of(docs, text_col), within=False), ("n_words", "n_removed", "removed"))


def schema_of(docs: DataFrame, text_col: str):
    from pyspark.sql import types as T

    rest = T.StructType([f for f in docs.schema.fields if f.name != text_col])
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    return T.StructType([T.StructField("_rest", rest), T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("lost", T.LongType()), T.StructField("removed", T.ArrayType(span))])


def with_columns(docs: DataFrame, text_col: str, got: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """The columns of docs in their order, the text replaced, and the three new ones."""
    own = [F.col("text").alias(c) if c == text_col else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns]
    return got.select(*own, *[F.col(a).alias(common.free_name(docs, b)) for a, b in zip(("n", "lost", "removed"), names)])
