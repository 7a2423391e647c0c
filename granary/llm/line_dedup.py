"""Line deduplication by overlapping windows of three lines: repeats anywhere in the corpus are cut by covered position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, words
from .first_seen import mark_repeats
from .substring_dedup import joined, result, schema_of, with_columns

WINDOW = 3


def line_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every line: first byte, byte after the last (without the line break), and its row. An empty text is one empty line."""
    breaks = np.flatnonzero(data == 0x0A)
    first = np.sort(np.concatenate([starts[:-1], breaks + 1]), kind="stable")
    # A text's lines begin at its start and after each of its breaks; count them by row to name the rows.
    per_row = 1 + np.searchsorted(breaks, starts[1:], side="left") - np.searchsorted(breaks, starts[:-1], side="left")
    row = np.repeat(np.arange(len(starts) - 1), per_row)
    last_of_row = np.ones(len(row), bool)
    last_of_row[:-1] = row[1:] != row[:-1]
    last = np.empty(len(row), np.int64)
    last[last_of_row] = starts[1:]
    last[~last_of_row] = breaks
    return first, last, row


def line_windows(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Window hashes, second hashes, the first line of each, and the lines. Windows of blank lines alone are left out."""
    first, last, row = line_spans(data, starts)
    h = words.hash_spans(data, first, last)
    got, at = words.windows(h, row, size)
    ink = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~words._SPACE[data], out=ink[1:])
    said = ink[last] > ink[first]
    some = np.zeros(len(at), bool)
    for k in range(size):
        some |= said[at + k]
    return got[some], words.second_windows(h, at[some], size), at[some], (first, last, row)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """docs without the lines that a later occurrence of a repeated window of `size` lines covers.

    Occurrences are ordered by id, then position; the first of a window stays, every other occurrence, in the same or
    another document, is removed, overlapping ones as one stretch. Lines are compared byte by byte. Lines end at "\\n"
    alone. The kept lines are joined again by "\\n"; n_lines and n_removed count lines before and those cut, removed
    holds the maximal removed intervals (start, stop) in lines. A null text becomes an empty one (one empty line), a
    document of fewer than `size` lines stays whole, a window of blank lines alone never counts, a null id is the
    smallest, and rows of one id are ordered by a hash of their text. Names that docs has already get an underscore more.
    """

    def find(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, second, at, (_, _, row) = line_windows(data, starts, size)
        return h, second, row[at]

    def finish(t: pa.Table, mask: np.ndarray) -> pa.Table:
        data, starts = common.utf8(t.column("_text"))
        _, _, at, (first, last, row) = line_windows(data, starts, size)
        gone = words.covered(at[mask], size, len(first))
        keep = ~gone
        text = joined(data, first[keep], last[keep], row[keep], t.num_rows, 0x0A)
        return result(t, text, np.bincount(row, minlength=t.num_rows), gone, row)

    return with_columns(docs, text_col, mark_repeats(docs, id_col, text_col, find, finish, schema_of(docs, text_col), within=True), ("n_lines", "n_removed", "removed"))
