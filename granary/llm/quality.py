"""Quality classifier: a generalised additive model with pairwise interactions, boosted in turn feature by feature."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, line_dedup, words

#: The most labelled rows that the model is fitted on, exactly; a hash of the id chooses them.
TRAINING_ROWS = 20_000
#: A document is predicted good from this score on.
ACCEPT = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, CALM = 150, 60, 0.1, 2.0

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "hash_signs", "bars", "bangs", "stops", "other_signs", "repeated_next", "distinct_words", "top_pairs", "line_words", "repeated_lines", "short_words", "long_words", "beyond_ascii", "capital_words", "ends_signed", "at_signs")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _LOWER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
_SIGNS, _BAR, _BANG, _STOP = _class("#$%&*"), _class("|"), _class("!"), _class(".,;:?")
_ELSE = _class("\"'()+-/<=>@[\\]^_`{}~")
_HIGH = np.arange(256) >= 0xC0
_AT = _class("@")


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text. An empty text has zeros."""
    n = len(starts) - 1
    h, row, first, last = words.words(data, starts)
    size = np.diff(starts).astype(np.float64)
    count = np.bincount(row, minlength=n).astype(np.float64)
    per_word = lambda mask: np.bincount(row[mask], minlength=n) / np.maximum(count, 1)
    total = np.zeros(len(data) + 1, np.int64)

    def chars(kind: np.ndarray) -> np.ndarray:
        np.cumsum(kind[data], out=total[1:])
        return (total[starts[1:]] - total[starts[:-1]]).astype(np.float64)

    letters = np.maximum(chars(_UPPER) + chars(_LOWER) + chars(_HIGH), 1)
    some, at_least = np.maximum(size, 1), np.maximum(count, 1)
    next_same = np.zeros(len(h), bool)
    next_same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    with np.errstate(over="ignore"):
        pair = h * words.U(words.BASE)
        pair[:-1] += h[1:]
    porder = np.lexsort((pair, row))
    again = np.zeros(len(h), bool)
    again[1:] = (pair[porder][1:] == pair[porder][:-1]) & (row[porder][1:] == row[porder][:-1])
    l_first, l_last, l_row = line_dedup.line_spans(data, starts)
    lh = words.hash_spans(data, l_first, l_last)
    lorder = np.lexsort((lh, l_row))
    l_again = np.zeros(len(lh), bool)
    l_again[1:] = (lh[lorder][1:] == lh[lorder][:-1]) & (l_row[lorder][1:] == l_row[lorder][:-1])
    lines = np.bincount(l_row, minlength=n).astype(np.float64)
    long_ = last - first
    capital = np.zeros(len(h), bool)
    if len(h):
        capital = _UPPER[data[first]] & _LOWER[data[np.minimum(first + 1, len(data) - 1)]]
    return np.stack(
        [
            np.log1p(size), np.log1p(count), np.bincount(row, weights=long_, minlength=n) / at_least, chars(_UPPER) / letters, chars(_DIGIT) / some, chars(_SIGNS) / some, chars(_BAR) / some, chars(_BANG) / some,
            chars(_STOP) / at_least, chars(_ELSE) / some, per_word(next_same), np.bincount(row[order][fresh], minlength=n) / at_least, np.bincount(row[porder][again], minlength=n) / at_least, count / np.maximum(lines, 1),
            np.bincount(l_row[lorder][l_again], minlength=n) / np.maximum(lines, 1), per_word(long_ <= 3), per_word(long_ >= 12), chars(_HIGH) / letters, per_word(capital), per_word(_STOP[data[last - 1]] if len(h) else capital), chars(_AT) / some,
        ],
        axis=1,
    )


class Model(NamedTuple):
    """Cuts of each feature, a table of scores by bin for each, and tables for pairs of features on coarser bins."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row: a table look-up and addition for each feature and pair."""
        z = np.full(len(x), self.bias)
        for k, (c, t) in enumerate(zip(self.cuts, self.tables)):
            z += t[np.searchsorted(c, x[:, k], side="right")]
        coarse = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.pair_cuts)]
        for i, j, t in self.pairs:
            z += t[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-z))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins)) if len(v) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + CALM)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step of a tree of three leaves at most over ordered bins: the best cut, then the best cut on either side."""
    n = len(g)
    leaves = [(0, n)]
    for _ in range(2):
        best = (1e-9, None, 0)
        for s, e in leaves:
            if e - s < 2:
                continue
            cg, ch = np.cumsum(g[s:e]), np.cumsum(h[s:e])
            gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            k = int(np.argmax(gains))
            if gains[k] > best[0]:
                best = (float(gains[k]), (s, e), s + k + 1)
        if best[1] is None:
            break
        s, e = best[1]
        leaves[leaves.index((s, e)) : leaves.index((s, e)) + 1] = [(s, best[2]), (best[2], e)]
    out = np.zeros(n)
    for s, e in leaves:
        out[s:e] = g[s:e].sum() / (h[s:e].sum() + CALM)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step of a tree with one cut along each axis: the pair of cuts with the largest gain."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    best, at = -1.0, (0, 0)
    total_g, total_h = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    if a.size:
        right_g, right_h = cg[:-1, -1:] - a, ch[:-1, -1:] - b
        low_g, low_h = cg[-1:, :-1] - a, ch[-1:, :-1] - b
        gains = _gain(a, b) + _gain(right_g, right_h) + _gain(low_g, low_h) + _gain(total_g - a - right_g - low_g, total_h - b - right_h - low_h)
        at = np.unravel_index(int(np.argmax(gains)), gains.shape)
        best = float(gains[at])
    out = np.zeros_like(g)
    if best > 0:
        for rows in (slice(0, at[0] + 1), slice(at[0] + 1, None)):
            for cols in (slice(0, at[1] + 1), slice(at[1] + 1, None)):
                out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + CALM)
    return out


def fit_model(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of each feature's table, then of the tables of the pairs whose interaction explains most of the rest.

    Without rows the score is one half; of one label alone, near that label.
    """
    rate = (y.sum() + 1) / (len(y) + 2)
    bias = math.log(rate / (1 - rate))
    k = x.shape[1]
    cuts, pair_cuts = [_cuts(x[:, i], BINS) for i in range(k)], [_cuts(x[:, i], PAIR_BINS) for i in range(k)]
    bins = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)]
    coarse = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(pair_cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    pairs: list[tuple[int, int, np.ndarray]] = []
    if not len(y) or y.min() == y.max():
        return Model(bias, cuts, tables, pair_cuts, pairs)
    z = np.full(len(y), bias)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i in range(k):
            r, c = slope()
            size = len(tables[i])
            step = RATE * shallow_tree(np.bincount(bins[i], r, size), np.bincount(bins[i], c, size))
            tables[i] += step
            z += step[bins[i]]
    r, c = slope()
    gains = []
    for i, j in combinations(range(k), 2):
        shape = (len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        g, h = (np.bincount(cell, v, shape[0] * shape[1]) for v in (r, c))
        gains.append((float(_gain(g, h).sum()) / math.sqrt(shape[0] * shape[1]), i, j, cell, shape))
    for _, i, j, cell, shape in sorted(gains, key=lambda t: -t[0])[:PAIRS]:
        pairs.append((i, j, np.zeros(shape)))
    cells = {(i, j): cell for _, i, j, cell, _ in gains}
    for _ in range(PAIR_ROUNDS):
        for i, j, t in pairs:
            r, c = slope()
            cell = cells[i, j]
            step = RATE * quadrants(*(np.bincount(cell, v, t.size).reshape(t.shape) for v in (r, c)))
            t += step
            z += step.ravel()[cell]
    return Model(bias, cuts, tables, pair_cuts, pairs)


def held_out(id_col: Column) -> Column:
    """Whether a row is never learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAINING_ROWS) -> Model:
    """The model of labelled documents that are not held out, of `most` rows at most, the least by a hash of the id.

    The chosen ids and labels (bounded by `most`) are sent to the documents; their features alone reach the driver. An id
    with several labels has the largest, one with several texts that of the least hash, so an id is one row. Null ids
    and labels teach nothing, a null text is empty, and without rows every score is one half.
    """
    common.ship(docs.sparkSession)
    own, mark = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    open_ = labels.where(mark.isNotNull() & own.isNotNull() & ~held_out(own)).select(own.cast("long").alias("id"), mark.cast("int").alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    n, chance = open_.count(), F.xxhash64("id", F.lit(9))
    # A share of a fifth too many, so that what is then sorted is bounded, and of these the least `most`.
    some = open_.where(F.pmod(chance, F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, 1.2 * most / max(n, 1))))
    chosen = some.orderBy(F.pmod(chance, F.lit(1 << 20)), "id").limit(most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, i, j in _featured(b, 2):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(list(map(bytes, x)), pa.binary())], names=["id", "label", "x"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    met = docs.select(own.cast("long").alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    one = met.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.mapInArrow(common.light(work), "id long, label int, x binary").collect()
    rows.sort()
    x = np.array([np.frombuffer(r[2], np.float64) for r in rows]).reshape(-1, len(FEATURES))
    return fit_model(x, np.array([r[1] for r in rows], np.float64))


def _featured(b: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, int, int]]:
    data, starts = common.utf8(b.column(column))
    for i, j in common.slices(starts, 1 << 20):
        yield features(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]), i, j


def score(docs: DataFrame, model: Model, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """docs with score (0 to 1, higher: likelier good) and predicted (1 from `accept` on).

    Only the text decides, so equal texts have equal scores; null and empty texts are scored as texts without words.
    An empty table gives no rows. Where docs has such columns, the new ones get an underscore more.
    """
    common.ship(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["t"])
        got = pa.array(np.concatenate([np.zeros(0), *[model.score(x) for x, _, _ in _featured(batch, 0)]]))
        common.give_back()
        return got

    name = common.free_name(docs, "score")
    return docs.withColumn(name, scored(F.col(text_col))).withColumn(common.free_name(docs, "predicted"), (F.col(name) >= accept).cast("int"))
