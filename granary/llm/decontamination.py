"""Benchmark decontamination: SimHash of item-sized windows, found by multi-index Hamming blocks, and rare shingles of items; verified by weighted shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words
from .tokens import _LOWER

SHINGLE = 5
THRESHOLD = 0.8
#: Fingerprints have 64 bits in 4 blocks of 16. Two within RADIUS differ by at most RADIUS // 4 bits in some block.
BLOCKS, RADIUS = 4, 11
#: Documents are windowed at every STRIDE-th word. An item has a fingerprint for each offset that its window size leaves,
#: STRIDE at least, so one always meets.
STRIDE = 4
#: Items of fewer words are windowed whole, at every word.
SHORT = 12
#: The most items, about, and bytes of their texts, that one pass over the documents looks for; their index, of some 10 kB
#: an item, is sent to every task. More items take more passes.
ITEMS_A_PASS, BYTES_A_PASS = 20_000, 32 << 20
U = np.uint64


def window_size(m: int) -> tuple[int, int]:
    """The window size for an item of m words, and the stride: the item's own, less the words that make windows begin and
    end at every STRIDE-th word, three to six of them; items of over 255 words share sizes in steps of a 32nd."""
    if m < SHORT:
        return m, 1
    unit = STRIDE * max(1, m // 128)
    return 1 + (m - STRIDE) // unit * unit, STRIDE


def near(block: int, radius: int) -> list[int]:
    """All 16-bit values within `radius` bits of one."""
    return [block ^ sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(16), k)]


def hashed(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, ASCII letters in lower case, and the row of each."""
    h, row, _, _ = words.words(_LOWER[data], starts)
    return h, row


def ones(h: np.ndarray, stride: int) -> np.ndarray:
    """Before every stride-th position, how many word pairs so far set each of the 64 bits, modulo 2**16."""
    with np.errstate(over="ignore"):
        pair = words.mix(h[:-1] * U(words.WINDOW_BASE) + h[1:])
    n = len(pair) // stride
    bits = np.unpackbits(pair[: n * stride].view(np.uint8).reshape(-1, 8), axis=1)
    step = bits[::stride].copy()
    for k in range(1, stride):
        step += bits[k::stride]
    out = np.zeros((n + 1, 64), np.uint16)
    np.cumsum(step, axis=0, dtype=np.uint16, out=out[1:])
    return out


def prints(h: np.ndarray, total: np.ndarray, size: int, stride: int) -> np.ndarray:
    """SimHash of the word pairs of the windows of `size` words at every stride-th word; of one word, the word's hash."""
    if size == 1:
        return h[::stride]
    k = (size - 1) // stride
    set_ = (total[k:] - total[:-k]) > (size - 1) // 2
    return np.packbits(set_, axis=1).view(np.uint64).ravel()


class Index:
    """Fingerprints of items by window size and block. Bounded by ITEMS_A_PASS items of BYTES_A_PASS."""

    def __init__(self, items: list[tuple], weights: dict[int, float], rare: float, threshold: float) -> None:
        self.threshold, self.rare = threshold, rare
        self.ids = [i for i, _ in items]
        self.length: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for k, (_, text) in enumerate(items):
            data, starts = common.utf8(pa.array([text or ""]))
            h, _ = hashed(data, starts)
            self.length.append(len(h))
            self.hashes.append(h)
            g = grams(h)
            self.grams.append((g, np.array([weights.get(int(x), rare) for x in g])))
            if not len(h):
                continue
            size, stride = window_size(len(h))
            for o, f in enumerate(prints(h, ones(h, 1), size, 1).tolist()):
                found.setdefault((size, stride), []).append((f, k, o))
        self.sizes = {}
        for key, rows in sorted(found.items()):
            f, item, offset = (np.array(c, kind) for c, kind in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
            tables = []
            masks = np.array(near(0, RADIUS // BLOCKS), np.uint16)
            for b in range(BLOCKS):
                every = ((f >> U(16 * b)).astype(np.uint16)[:, None] ^ masks).ravel()
                count = np.bincount(every, minlength=65536).astype(np.int32)
                flat = (np.argsort(every, kind="stable") // len(masks)).astype(np.int32)
                tables.append((count, np.cumsum(count) - count, flat))
            self.sizes[key] = (f, item, offset, tables)
        self._keep_rare()
        del self.hashes

    def _keep_rare(self) -> None:
        """The rarest shingles of each item of SHINGLE words or more, where it has them, and a table of their last bits.

        Their weights sum to more than a passage can lack that reaches the threshold, so it has one of them.
        """
        kept = [np.zeros((0, 3), np.uint64)]
        for k, h in enumerate(self.hashes):
            if len(h) < SHINGLE:
                continue
            g, w = self.grams[k]
            order = np.lexsort((g, -w))
            total = np.cumsum(w[order])
            n = int(np.searchsorted(total, (1 - self.threshold) * total[-1] * (1 + 1e-9) + 1e-9, side="right")) + 1
            every, at = words.windows(h, np.zeros(len(h), np.int64), SHINGLE)
            every = every ^ U(SHINGLE)
            own = np.isin(every, g[order[:n]])
            kept.append(np.stack([every[own], np.full(own.sum(), k, np.uint64), at[own].astype(np.uint64)], 1))
        rare = np.concatenate(kept)
        rare = rare[np.argsort(rare[:, 0], kind="stable")]
        self.rare_grams, first, self.rare_count = np.unique(rare[:, 0], return_index=True, return_counts=True)
        self.rare_first, self.rare_item, self.rare_at = first, rare[:, 1].astype(np.int64), rare[:, 2].astype(np.int64)
        self.rare_bits = np.zeros(1 << 20, bool)
        self.rare_bits[self.rare_grams & U(0xFFFFF)] = True

    def sharing(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, where it would begin, row) wherever a row has one of the item's rare shingles, wherever in the row."""
        got, at = words.windows(h, row, SHINGLE)
        got = got ^ U(SHINGLE)
        maybe = np.flatnonzero(self.rare_bits[got & U(0xFFFFF)])
        place = np.searchsorted(self.rare_grams, got[maybe])
        hit = place < len(self.rare_grams)
        hit[hit] = self.rare_grams[place[hit]] == got[maybe[hit]]
        place, at = place[hit], at[maybe[hit]]
        c = self.rare_count[place]
        spread = np.repeat(np.arange(len(place)), c)
        which = np.arange(len(spread)) - np.repeat(np.cumsum(c) - c, c) + self.rare_first[place][spread]
        return self.rare_item[which], at[spread] - self.rare_at[which], row[at[spread]]

    def candidates(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, where it would begin, row) of every window within RADIUS of one of the item's fingerprints."""
        items, begins, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        totals = {stride: ones(h, stride) for stride in {s for _, s in self.sizes}} if len(h) else {}
        for (size, stride), (f, item, offset, tables) in self.sizes.items():
            n = len(h) - size + 1
            if n <= 0:
                continue
            p = prints(h, totals[stride], size, stride)
            at = np.arange(len(p)) * stride
            inside = row[at] == row[at + size - 1]
            p, at = p[inside], at[inside]
            for b, (count, begin, flat) in enumerate(tables):
                v = (p >> U(16 * b) & U(0xFFFF)).astype(np.int64)
                hit = np.flatnonzero(count[v])
                c = count[v[hit]]
                spread = np.repeat(np.arange(len(hit)), c)
                which = flat[np.arange(len(spread)) - np.repeat(np.cumsum(c) - c, c) + begin[v[hit]][spread]]
                near_by = np.bitwise_count(p[hit][spread] ^ f[which]) <= RADIUS
                which, spread = which[near_by], spread[near_by]
                items.append(item[which])
                begins.append(at[hit[spread]] - offset[which])
                rows.append(row[at[hit[spread]]])
        return np.concatenate(items), np.concatenate(begins), np.concatenate(rows)

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of the shingle sets of an item and of a window of words."""
        g, w = self.grams[item]
        own = grams(window)
        shared = w[np.isin(g, own, assume_unique=True)].sum()
        # What the window has besides is weighted by the benchmark as well.
        extra = own[~np.isin(own, g, assume_unique=True)]
        union = w.sum() + sum(self.weights_of(extra))
        return round(float(shared / union), 12) if union else 0.0  # sums of floats: 0.8 must not fall short of itself

    def trimmed(self, item: int, h: np.ndarray, lo: int, hi: int) -> tuple[int, int]:
        """The part of a window from the first shingle that the item has to the last one; passages cut short end there."""
        k = min(SHINGLE, self.length[item], max(hi - lo, 1))
        got, _ = words.windows(h[lo:hi], np.zeros(hi - lo, np.int64), k)
        same = np.flatnonzero(np.isin(got ^ U(k), self.grams[item][0]))
        return (lo + int(same[0]), lo + int(same[-1]) + k) if len(same) else (lo, lo)

    def weights_of(self, g: np.ndarray) -> list[float]:
        return [self.known.get(x, self.rare) for x in g.tolist()]

    @property
    def known(self) -> dict[int, float]:
        if not hasattr(self, "_known"):
            self._known = {x: y for g, w in self.grams for x, y in zip(g.tolist(), w.tolist())}
        return self._known

    def matches(self, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity): the best window for each row and item that reaches the threshold."""
        h, row = hashed(data, starts)
        row_begin = np.searchsorted(row, np.arange(len(starts)))
        tried = set(zip(*(x.tolist() for x in self.candidates(h, row))))
        tried.update(zip(*(x.tolist() for x in self.sharing(h, row))))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k, s, r in sorted(tried):
            # Words put in or left out move one end of a passage, so the window is tried with some words more on either side
            # too; words beyond the document's edge are left out.
            for slack in (0, max(STRIDE, self.length[k] // 8)):
                lo, hi = max(s - slack, int(row_begin[r])), min(s + self.length[k] + slack, int(row_begin[r + 1]))
                lo, hi = self.trimmed(k, h, lo, max(lo, hi))
                if hi > lo:
                    sim = self.similarity(k, h[lo:hi])
                    if sim >= self.threshold and (sim, -(lo - row_begin[r])) > best.get((r, k), (-1.0, 0, 0))[:2]:
                        best[r, k] = (sim, -int(lo - row_begin[r]), hi - lo)
        for (r, k), (sim, s, n) in sorted(best.items()):
            yield r, k, -s, n, sim


def grams(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of runs of five words; of fewer words, of all of them as one run."""
    if not len(h):
        return np.zeros(0, np.uint64)
    k = min(SHINGLE, len(h))
    got, _ = words.windows(h, np.zeros(len(h), np.int64), k)
    return np.unique(got ^ U(k))


def shingle_weights(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """The weight of every shingle of the benchmark, 1 + ln((N + 1) / (items with it + 1)), and that of a shingle in none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, starts = common.utf8(b.column(0))
            h, row = hashed(data, starts)
            cut = np.searchsorted(row, np.arange(len(starts)))
            g = [grams(h[s:e]) for s, e in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *g]).view(np.int64))], names=["gram"])

    n = items.count()
    rare = 1 + math.log(n + 1)
    counted = items.select(F.col(text_col)).mapInArrow(common.light(work), "gram long").groupBy("gram").count()
    return counted.select("gram", (1 + F.log((n + 1) / (F.col("count") + 1))).alias("weight")), rare


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and benchmark item it holds: doc id, item id, start and n_words of the best window, similarity.

    Windows of an item's size over every whole text are fingerprinted by SimHash of their word pairs. Every window within
    RADIUS bits of an item's is found, and so is every place that has one of an item's rarest shingles, of which a
    passage that reaches the threshold has one wherever it begins or is cut. Then the item-sized window there, from its
    first shingle of the item to its last, is verified by the weighted Jaccard similarity of five-word shingles. Case of
    ASCII letters doesn't count. Null or empty texts hold nothing and are held by nothing; an item of fewer than five
    words is one shingle. Rows of one id give rows each, repeated items a row each; an empty table on either side gives no
    rows. The columns are called after id_col and item_col, with an underscore more where these are the same. Items are
    looked for ITEMS_A_PASS at a time, which bounds the index that is sent out; documents are never shuffled.
    """
    name = item_col + "_" * (item_col.lower() == id_col.lower())
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(name, benchmark.schema[item_col].dataType), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())])
    rows = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    out = None
    for index in indexes(benchmark, item_col, item_text, threshold):
        got = rows.mapInArrow(_searcher(index, schema), schema)
        out = got if out is None else out.unionByName(got)
    return out


def passes(benchmark: DataFrame, item_text: str) -> int:
    n, size = benchmark.agg(F.count("*"), F.sum(F.octet_length(F.col(f"`{item_text}`")).cast("long"))).first()
    return max(1, math.ceil(n / ITEMS_A_PASS), math.ceil((size or 0) / BYTES_A_PASS))


def indexes(benchmark: DataFrame, item_col: str, item_text: str, threshold: float) -> Iterator:
    """The index of each pass, sent to the executors; weights count over the whole benchmark."""
    spark = benchmark.sparkSession
    common.ship(spark)
    bench = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text"))
    weights, rare = shingle_weights(bench, "item", "text")
    parts = passes(bench, "text")
    place = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    for part in range(parts):
        items = [tuple(r) for r in bench.where(place == part).collect()]
        mine = shingle_table(spark, items)
        yield spark.sparkContext.broadcast(Index(items, {g % 2**64: w for g, w in weights.join(mine, "gram", "left_semi").collect()}, rare, threshold))


def shingle_table(spark, items: list[tuple[int, str]]) -> DataFrame:
    grams_of = set()
    for _, text in items:
        grams_of.update(grams(hashed(*common.utf8(pa.array([text or ""])))[0]).view(np.int64).tolist())
    return spark.createDataFrame([(g,) for g in sorted(grams_of)], "gram long")


def _searcher(index, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for b in batches:
            data, starts = common.utf8(b.column(1))
            rows: list[tuple] = []
            for i, j in common.slices(starts, 1 << 18):
                rows += [(i + r, found.ids[k], s, n, sim) for r, k, s, n, sim in found.matches(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])]
            r, *rest = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r, pa.int64())), *(pa.array(x, kinds.field(k + 1).type) for k, x in enumerate(rest))], names=kinds.names)

    return common.light(work)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that hold a benchmark item, all columns kept, whatever they are called.

    Each row is judged by itself, as by `contaminated`; nothing is shuffled. Null and empty texts stay, rows of one id
    are judged each, an empty benchmark leaves all. Where the items take several passes, what each leaves is stored, so
    that a task holds one index at a time.
    """
    at, more = docs.columns.index(text_col), passes(benchmark, item_text)
    out = docs
    for k, index in enumerate(indexes(benchmark, item_col, item_text, threshold)):
        out = out.mapInArrow(_keeper(index, at), docs.schema)
        if k + 1 < more:
            out = common.stored(out)
    return out


def _keeper(index, at: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for b in batches:
            data, starts = common.utf8(b.column(at))
            keep = np.ones(b.num_rows, bool)
            for i, j in common.slices(starts, 1 << 18):
                keep[[i + r for r, *_ in found.matches(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])]] = False
            yield b.filter(pa.array(keep))

    return common.light(work)
