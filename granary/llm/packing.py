"""Packing of token ids into sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

CAPACITY = 4096
END_ID = 2
#: The longest piece that goes into the differencing; documents above it are cut.
PIECE = 1024
#: Windows that are packed together; more give less padding and cost more merges.
WINDOWS = 192
#: Text bytes of a task at least: its last windows are not full, so input partitions of less are read together.
TASK_BYTES = 2 << 20


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp for k windows: the window of each piece, and the windows' loads.

    Each piece starts as a partition with one loaded slot. The two partitions whose loads differ most are merged, the
    fullest slot of one with the emptiest of the other, until one is left. Which slots met is kept for each merge and
    read back from the root down.
    """
    n = len(sizes)
    loads: list[np.ndarray | None] = []
    heap = []
    for i, x in enumerate(sizes.tolist()):
        v = np.zeros(k, np.int64)
        v[0] = x
        loads.append(v)
        heap.append((-x if k > 1 else 0, i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = loads[a] + loads[b][::-1]
        order = np.argsort(-both, kind="stable")
        v = both[order]
        loads[a] = loads[b] = None
        loads.append(v)
        merges.append((a, b, order))
        heapq.heappush(heap, (int(v[-1] - v[0]), len(loads) - 1))
    slots: dict[int, np.ndarray] = {len(loads) - 1: np.arange(k)}
    window = np.zeros(n, np.int64)
    for node in range(len(loads) - 1, -1, -1):
        at = slots.pop(node)
        if node < n:
            window[node] = at[0]
            continue
        a, b, order = merges[node - n]
        place = np.empty(k, np.int64)
        place[order] = at
        slots[a], slots[b] = place, place[::-1]
    return window, loads[-1]


def windows_for(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; one window more for as long as any is above capacity."""
    k = max(1, math.ceil(int(sizes.sum()) / capacity))
    while True:
        window, loads = difference(sizes, k)
        if loads.max() <= capacity:
            return window
        k += 1


def cuts(total: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences first, then pieces of about equal length up to `piece`."""
    whole = total // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    rest, at = total - whole * capacity, whole * capacity
    if rest:
        n = math.ceil(rest / piece)
        edges = [at + rest * i // n for i in range(n + 1)]
        out += [(s, e - s) for s, e in zip(edges, edges[1:])]
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, piece: int = PIECE, group: int = WINDOWS) -> DataFrame:
    """The pieces of all documents: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are its tokens without special ones, then end_id; a null or empty text is end_id alone. Ids beyond
    whole sequences are cut into pieces of at most `piece` and dealt to windows of `capacity` by differencing, `group`
    windows at a time within a task. Nothing is shuffled; input partitions are joined into tasks of TASK_BYTES or more,
    so what their last windows lack is a percent or two however many files there are. The order of a partition's rows
    decides, so the input must be a stored table. sequence_id is unique, not gapless. Rows of one id are packed each by
    itself, null ids too; a very long text fills sequences of its own; an empty table gives no rows. Other columns are
    not carried, whatever they are called.
    """
    common.ship(docs.sparkSession)
    path = path or vocabulary()
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind)] + [T.StructField(n, t()) for n, t in (("start", T.LongType), ("length", T.LongType), ("ids", T.BinaryType), ("doc_tokens", T.LongType), ("sequence_id", T.LongType), ("offset", T.LongType))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        serial = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # id, start, ids of the piece, tokens of its document
        weight = 0

        def flush(some: list[tuple]) -> pa.RecordBatch:
            nonlocal serial
            window = windows_for(np.array([len(x[2]) for x in some], np.int64), capacity)
            order = np.argsort(window, kind="stable")
            out, now, offset = [], -1, 0
            for i in order.tolist():
                if window[i] != now:
                    now, offset, serial = window[i], 0, serial + 1
                d, s, ids, n = some[i]
                out.append((d, s, len(ids), ids.tobytes(), n, serial - 1, offset))
                offset += len(ids)
            return record(out)

        def record(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            data, starts = common.utf8(b.column(1))
            names = b.column(0).to_pylist()
            for i, j in common.slices(starts, 2 << 20):
                ids, begin = encode(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                full = []
                for r in range(i, j):
                    own = np.append(ids[begin[r - i] : begin[r - i + 1]], np.int32(end_id)).astype("<u4")
                    for s, n in cuts(len(own), capacity, piece):
                        if n == capacity:
                            full.append((names[r], s, n, own[s : s + n].tobytes(), len(own), serial, 0))
                            serial += 1
                        else:
                            held.append((names[r], s, own[s : s + n], len(own)))
                            weight += n
                if full:
                    yield record(full)
                while weight >= 2 * group * capacity:
                    upto = took = 0
                    while took < group * capacity:
                        took += len(held[upto][2])
                        upto += 1
                    yield flush(held[:upto])
                    held, weight = held[upto:], weight - took
        if held:
            yield flush(held)

    rows = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    return rows.coalesce(max(1, common.text_bytes(rows, "_text") // TASK_BYTES)).mapInArrow(common.light(work), schema)
