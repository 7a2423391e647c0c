"""Which windows have been seen before: the counting that substring and line deduplication share.

The documents are dealt into ranges of ascending id, of about as many bytes; an id with very many rows spreads over
several. A range sends each distinct window hash once, packed by hash bucket, so a window that half of all documents
hold arrives once for each range and no key is hot. A bucket answers every range with one bit for each hash it sent:
whether an earlier range has it too, or, for rows of an id that began in an earlier range, whether a smaller id has.
The answers are joined to the ranges, where repeats inside the range are found locally. Rows shuffled: the texts by
range, eight bytes for each distinct window of a range, and one bit back.

A window's bucket comes from a second hash, so that two windows count as one only if all 64 bits and the bucket agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Windows: a hash of each, a second hash of 32 bits, and the row (ascending) of each.
Windows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _ordered(t: pa.Table) -> pa.Table:
    return t.sort_by([("_id", "ascending"), ("_tie", "ascending"), ("_text", "ascending")])


class Distinct:
    """The distinct hashes of a range's windows by bucket, then hash; where each window's entry is, and the first window of each."""

    def __init__(self, h: np.ndarray, second: np.ndarray, buckets: int) -> None:
        order = np.argsort(h, kind="stable")
        inner = h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = inner[1:] != inner[:-1]
        begin = np.flatnonzero(fresh)
        least = np.minimum.reduceat(second[order], begin) if len(h) else second
        bucket = (least.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.back = np.empty(len(h), np.int64)
        self.back[order] = place[np.cumsum(fresh) - 1]
        self.first = order[begin][by]  # the sorts are stable, so this is the earliest window
        self.hashes = inner[begin][by]
        self.buckets, cuts = np.unique(bucket[by].astype(np.int32), return_index=True)
        self.cuts = np.append(cuts, len(by))


def mark_repeats(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    find: Callable[[np.ndarray, np.ndarray], Windows],
    finish: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch] | pa.Table],
    schema: str,
    within: bool,
) -> DataFrame:
    """finish(rows of a range, mask of its windows) for every range of documents; its tables have the given schema.

    find(bytes, starts) gives the windows of some texts. The mask tells for each window, in the order of rows, whether
    its hash also begins in a document with a smaller id; with `within`, whether it begins anywhere before: in a smaller
    id, earlier in the same document, or in a row of the same id that comes before it by a hash of its text. A null id
    counts as the smallest. An empty table gives no rows.
    """
    common.ship(docs.sparkSession)
    spark = docs.sparkSession
    ordered = common.in_order(docs, id_col, text_col, [c for c in docs.columns if c != text_col])
    cut, buckets = common.ranges(ordered), common.bucket_count(ordered, "_text")
    n = min(cut.count, max(common.MOST_PARTITIONS, common.partitions(spark)))
    rows = ordered.withColumn("_range", cut.number(F.col("_id"), F.col("_tie"))).repartition(n, "_range")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in common.groups(batches, "_range"):
            h, second, row = find_all(t, find)
            own = Distinct(h, second, buckets)
            # Hashes of rows of the last id alone: a later range with rows of that id must not take them for a smaller id's.
            late = np.zeros(len(own.hashes), bool)
            last = (t.column("_id").to_numpy() == cut.tail(number))[row]
            if not within and last.any():
                late[own.back] = True
                late[own.back[~last]] = False
            for part in np.array_split(np.arange(len(own.buckets)), max(1, len(own.hashes) // 500_000)):
                spans = [(own.cuts[k], own.cuts[k + 1]) for k in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own.buckets[part], pa.int32()),
                        pa.array(np.full(len(part), number), pa.int64()),
                        pa.array([own.hashes[s:e].tobytes() for s, e in spans], pa.binary()),
                        pa.array([np.packbits(late[s:e]).tobytes() if late[s:e].any() else None for s, e in spans], pa.binary()),
                    ],
                    names=["bucket", "_range", "hashes", "late"],
                )

    def answer(t: pa.Table) -> pa.Table:
        t = t.sort_by("_range")
        blobs = [np.frombuffer(b, np.uint64) for b in t.column("hashes").to_pylist()]
        sizes = np.array([len(b) for b in blobs], np.int64)
        numbers = t.column("_range").to_numpy()
        h = np.concatenate(blobs) if blobs else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        again = np.zeros(len(h), bool)
        if len(h):
            again[order[1:]] = h[order[1:]] == h[order[:-1]]
        ends = np.cumsum(sizes)
        # Where the first range that has a hash has it in rows of its last id alone, rows of that id in later ranges stay.
        only: np.ndarray | None = None
        late = t.column("late").to_pylist()
        if any(x is not None for x in late):
            held = np.concatenate([np.zeros(k, bool) if x is None else np.unpackbits(np.frombuffer(x, np.uint8), count=k).astype(bool) for x, k in zip(late, sizes.tolist())])
            entry = np.repeat(np.arange(len(blobs)), sizes)
            start = np.maximum.accumulate(np.where(again[order], 0, np.arange(len(h))))
            origin = order[start]  # of each hash in order: its first entry
            tails = np.where(held[origin], np.array([cut.tail(int(r)) for r in numbers], np.int64)[entry[origin]], 2**63 - 1)
            heads = np.array([2**63 - 2 if (x := cut.head(int(r))) is None else x for r in numbers], np.int64)[entry[order]]
            only = np.zeros(len(h), bool)
            only[order] = again[order] & (tails == heads)
        out = []
        for b, r, s, e in zip(t.column("bucket").to_pylist(), numbers.tolist(), (ends - sizes).tolist(), ends.tolist()):
            if again[s:e].any():
                same = only is not None and only[s:e].any()
                out.append((b, r, np.packbits(again[s:e]).tobytes(), np.packbits(only[s:e]).tobytes() if same else None))
        return pa.table([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "_range", "bits", "only"])

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        t = _ordered(left.select(["_id", "_tie", "_text", "_rest"]))
        h, second, row = find_all(t, find)
        own = Distinct(h, second, buckets)
        before, stays = np.zeros(len(own.hashes), bool), np.zeros(len(own.hashes), bool)
        place = np.searchsorted(own.buckets, right.column("bucket").to_numpy())
        for k, bits, only in zip(place.tolist(), right.column("bits").to_pylist(), right.column("only").to_pylist()):
            s, e = own.cuts[k], own.cuts[k + 1]
            before[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(e - s)).astype(bool)
            if only is not None:
                stays[s:e] = np.unpackbits(np.frombuffer(only, np.uint8), count=int(e - s)).astype(bool)
        owner = t.column("_id").to_numpy()[row]
        mask = before[own.back]
        if stays.any():
            mask &= ~(stays[own.back] & (owner == cut.head(left.column("_range")[0].as_py())))
        if len(h):
            mask |= (np.arange(len(h)) > own.first[own.back]) if within else (owner > owner[own.first][own.back])
        done = finish(t, mask)
        del h, second, row, own, before, stays, owner, mask
        common.give_back()
        return done

    # Both sides read the same columns of the same exchange, so Spark deals the texts out once and reuses it.
    sent = rows.sortWithinPartitions("_range").mapInArrow(common.light(send), "bucket int, _range long, hashes binary, late binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "bucket int, _range long, bits binary, only binary")
    return rows.groupBy("_range").cogroup(answers.groupBy("_range")).applyInArrow(settle, schema)


def find_all(t: pa.Table, find: Callable[[np.ndarray, np.ndarray], Windows]) -> Windows:
    """The windows of all rows, some megabytes of text at a time."""
    data, starts = common.utf8(t.column("_text"))
    hashes, seconds, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for i, j in common.slices(starts, 1 << 20):
        h, second, row = find(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
        hashes.append(h)
        seconds.append(second)
        rows.append(row + i)
    return np.concatenate(hashes), np.concatenate(seconds), np.concatenate(rows)
