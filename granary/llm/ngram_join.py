"""Similarity join on word n-grams: MinHash values compared step by step under a Bayesian bound, survivors verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
#: Bands and rows of a band. A pair of similarity 0.8 shares no band with probability 5e-5, one of 0.85 with 4e-7.
BANDS, ROWS = 25, 5
#: A pair is dropped when the probability that it reaches the threshold, given the values compared so far, is below this.
TOLERANCE = 1e-6
STEP = 25
#: Distinct sets, and bytes of their texts, that are compared with one another in one task; larger candidate groups are
#: split into pairs of blocks. Of signatures alone, SIGNED are compared in one task.
BLOCK, BLOCK_BYTES, SIGNED = 512, 16 << 20, 1024
#: A group of more blocks is cut down by signatures first, since chance bands may have chained unlike texts together.
MANY = 16
U = np.uint64
_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_ODD = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of n equal MinHash values with which a pair stays.

    With a uniform prior on the similarity, the probability that it reaches t after m of n matches is that of at most m
    successes in n + 1 trials of probability t.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def shingles(data: np.ndarray, starts: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of `size` words; of fewer words, of all of them as one run."""
    h, row, _, _ = words.words(data, starts)
    got, at = words.windows(h, row, size)
    n = len(starts) - 1
    edge = np.searchsorted(row[at], np.arange(n + 1)) if len(at) else np.zeros(n + 1, np.int64)
    begin = np.searchsorted(row, np.arange(n + 1))
    out = []
    for i in range(n):
        if edge[i + 1] > edge[i]:
            out.append(np.unique(got[edge[i] : edge[i + 1]]))
        elif k := int(begin[i + 1] - begin[i]):
            short, _ = words.windows(h[begin[i] : begin[i + 1]], np.zeros(k, np.int64), k)
            out.append(short ^ U(k))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash values of each set, a row for each; of an empty set, the largest value throughout."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        x = (np.concatenate([sets[i] for i in full]) >> U(32)).astype(np.uint32)
        at = np.cumsum(sizes[full]) - sizes[full]
        for k in range(BANDS * ROWS):
            y = (x ^ _XOR[k]) * _ODD[k]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[full, k] = np.minimum.reduceat(y, at)
    return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number. Two of n different sets share one with probability n*n/4e19."""
    with np.errstate(over="ignore"):
        return int(words.mix(np.array([words.mix(s).sum(dtype=np.uint64) + U(len(s))], np.uint64)).view(np.int64)[0])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature; the band's number is part of it."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            h = np.full(len(sig), b + 1, np.uint64)
            for k in range(ROWS):
                h = words.mix(h * U(words.BASE) + sig[:, b * ROWS + k])
            out[:, b] = h
    return out.view(np.int64)


def _features(docs: DataFrame) -> DataFrame:
    """The set key, text bytes and band keys of every document (id, mark, text); a text without words has no bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, starts = common.utf8(b.column(2))
            for i, j in common.slices(starts, 1 << 20):
                sets = shingles(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                keys = band_keys(signatures(sets))
                own = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array(np.diff(starts[i : j + 1])), pa.array([k if len(s) else [] for k, s in zip(keys.tolist(), sets)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in (0, 1)), *own], names=["id", "mark", "node", "bytes", "bands"])

    return docs.mapInArrow(common.light(work), "id long, mark long, node long, bytes long, bands array<long>")


def _signed(texts: DataFrame) -> DataFrame:
    """node, and for each of its bands the key and the whole signature, from node and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, starts = common.utf8(b.column(1))
            for i, j in common.slices(starts, 1 << 18):
                sig = signatures(shingles(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]))
                node = np.repeat(b.column(0).to_numpy()[i:j], BANDS)
                every = [x for r in sig for x in [r.tobytes()] * BANDS]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(band_keys(sig).ravel()), pa.array(every, pa.binary())], names=["node", "band", "sig"])

    return texts.mapInArrow(common.light(work), "node long, band long, sig binary")


def survivors(a: np.ndarray, b: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and b that the Bayesian bound leaves; of one block, each pair once."""
    count = (a[:, None, 0] == b[None, :, 0]).astype(np.int16)
    for k in range(1, STEP):
        count += a[:, None, k] == b[None, :, k]
    stay = count >= least_matches(STEP, threshold, tolerance)
    if same:
        stay &= np.triu(np.ones(stay.shape, bool), 1)
    i, j = np.nonzero(stay)
    got = count[i, j].astype(np.int64)
    for n in range(STEP, a.shape[1], STEP):
        got += (a[i, n : n + STEP] == b[j, n : n + STEP]).sum(1)
        stay = got >= least_matches(n + STEP, threshold, tolerance)
        i, j, got = i[stay], j[stay], got[stay]
    return i, j


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact number of shared elements of each pair (i, j) of sets."""
    if not len(i):
        return np.zeros(0, np.int64)
    used = np.unique(np.concatenate([i, j]))
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    everything = np.concatenate([sets[u] for u in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    uniq, back, n = np.unique(everything, return_inverse=True, return_counts=True)
    shared = n[back] > 1
    column = np.cumsum(n > 1) - 1
    if len(i) * 64 < len(used) ** 2 or len(used) < 24:
        own = [set_ for set_ in np.split(column[back][shared], np.cumsum(np.bincount(owner[shared], minlength=len(used)))[:-1])]
        return np.array([len(np.intersect1d(own[p], own[q], assume_unique=True)) for p, q in zip(place[i], place[j])], np.int64)
    # Many pairs among few sets: shared elements in slices of columns, counted by matrix products.
    total = np.zeros((len(used), len(used)), np.float32)
    col, own = column[back][shared], owner[shared]
    order = np.argsort(col, kind="stable")
    col, own = col[order], own[order]
    for s in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        lo, hi = np.searchsorted(col, [s, s + 4096])
        m = np.zeros((len(used), 4096), np.float32)
        m[own[lo:hi], col[lo:hi] - s] = 1
        total += m @ m.T
    return total[place[i], place[j]].astype(np.int64)


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """For each of n things the least one that the pairs (i, j) join it to."""
    parent = list(range(n))
    for p, q in zip(i.tolist(), j.tolist()):
        p, q = _root(parent, p), _root(parent, q)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return [_root(parent, x) for x in range(n)]


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    """rows (with blocks, the number that its group is split into) once for each pair of blocks that its own is in: low, high, and spot, the pair's key."""
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    pairs = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return pairs.withColumns({"low": low, "high": high}).withColumn("spot", F.xxhash64(group, "low", "high"))


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of a spot's two blocks, each node once, and whether they are the same block."""
    block, low, high = (t.column(c).to_numpy() for c in ("block", "low", "high"))
    own = np.unique(t.column("node").to_numpy(), return_index=True)[1]
    if low[0] == high[0]:
        return own, own, True
    return own[block[own] == low[0]], own[block[own] == high[0]], False


def _likely(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, root) wherever the Bayesian bound leaves a pair of a spot, by their signatures alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in common.groups(batches, "spot"):
            a, b, same = _sides(t)
            if not len(a) or not len(b):
                continue
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
            pairs = [(a[s : s + BLOCK][i], b[r : r + BLOCK][j]) for s in range(0, len(a), BLOCK) for r in range(s if same else 0, len(b), BLOCK) for i, j in [survivors(sig[a[s : s + BLOCK]], sig[b[r : r + BLOCK]], same and r == s, threshold, tolerance)]]
            i, j = (np.concatenate(x) for x in zip(*pairs))
            root = np.array(_roots(t.num_rows, i, j))
            some = np.unique(np.concatenate([i, j]))
            node = t.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], names=["node", "root"])

    return rows.mapInArrow(common.light(work), "node long, root long")


def _verified(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """For every pair of blocks (spot) of candidates: node, a node of the same linked set (root), and the documents linked to it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in common.groups(batches, "spot"):
            a, b, same = _sides(t)
            if not len(a) or not len(b) or same and len(a) < 2:
                continue
            data, starts = common.utf8(t.column("text"))
            node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
            sets: list[np.ndarray] = []
            for i, j in common.slices(starts, 1 << 20):
                sets += shingles(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            sig = signatures(sets)
            i, j = survivors(sig[a], sig[b], same, threshold, tolerance)
            i, j = a[i], b[j]
            size = np.array([len(s) for s in sets], np.int64)
            both = overlaps(sets, i, j)
            good = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[good], j[good]
            if not len(i):
                continue
            links = np.bincount(i, weights=copies[j], minlength=len(sets)) + np.bincount(j, weights=copies[i], minlength=len(sets))
            some = np.flatnonzero(links)
            root = np.array(_roots(len(sets), i, j))[some]
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root]), pa.array(links[some].astype(np.int64))], names=["node", "root", "links"])

    return rows.mapInArrow(common.light(work), "node long, root long, links long")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of docs: its id, class_id and n_links.

    Two documents are linked where the Jaccard similarity of their sets of five-word shingles is at least the threshold;
    a text of fewer words is one shingle, and texts without words (null, empty, white space) are alike. n_links counts
    the other rows linked to a row, copies too. class_id is the least id among the rows that links join, directly or
    through others; a row alone is its own class, and a class of null ids has a null class_id.

    Equal sets become one node, counted before the shuffle. Nodes that share a MinHash band fall into one candidate
    group; a group of over MANY blocks, of BLOCK nodes or BLOCK_BYTES, is first cut down to what pairs of likely signatures,
    band by band, hold together. A group's pairs are pruned by the Bayesian bound and verified on the whole texts; a large one is dealt
    out as pairs of blocks, and a task returns one row for each node at most, so no pair is ever a row. One text of each
    node is fetched by id and a hash of the text, so rows that share an id, or have none, meet their own text alone. An
    empty table gives no rows; only the id and the text are read, whatever other columns are called.
    """
    features, named = _classes(docs, id_col, text_col, threshold, tolerance)
    first = named.groupBy("component").agg(F.min("id").alias("class_id"))
    final = named.join(first, "component").select("node", "copies", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    shown = lambda c: F.nullif(F.col(c), F.lit(common.LEAST_ID))
    got = common.joined(features.select("id", "node"), final, "node", "copies", features.count())
    return got.select(shown("id").cast(docs.schema[id_col].dataType).alias(id_col), shown("class_id").alias("class_id"), "n_links")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(common.long_id(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _texts(nodes: DataFrame, rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """nodes (id, mark) with the text of each; of the rows that `repeated` says come more than once, of one of them.

    FEW nodes or less are sent to the texts; of more, texts and nodes are shuffled.
    """
    wanted = common.stored(nodes)
    met = rows.join(F.broadcast(wanted) if wanted.count() <= common.FEW else wanted, ["id", "mark"])
    if repeated is None:
        return met
    once = met.join(repeated, ["id", "mark"], "left_anti")
    more = met.join(repeated, ["id", "mark"], "left_semi").groupBy(*[c for c in met.columns if c != "text"]).agg(F.min("text").alias("text"))
    return once.unionByName(more)


def _candidates(nodes: DataFrame, rows: DataFrame, repeated: DataFrame | None, threshold: float, tolerance: float) -> DataFrame:
    """node, component and blocks of every node that may have a link, and into how many blocks its component is split."""
    total = nodes.count()
    banded = nodes.select("node", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    edges = common.joined(banded, least, "band", "n", BANDS * total).select(F.col("node").alias("a"), F.col("least").alias("b"))
    grouped = common.stored(_split(components(edges), nodes))
    large = grouped.where(F.col("blocks") > MANY)
    if large.isEmpty():
        return grouped
    held = nodes.drop("bands").join(large.select("node"), "node").select("id", "mark", "node")
    signed = _signed(_texts(held, rows, repeated).select("node", "text"))
    sizes = banded.join(large.select("node"), "node").groupBy("band").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / SIGNED).cast("int"))
    spots = _dealt(common.joined(signed, sizes, "band", "n", BANDS * total), "band")
    n = max(common.partitions(nodes.sparkSession), 1)
    likely = _likely(spots.repartition(n, "spot").sortWithinPartitions("spot").select("spot", "node", "sig", "block", "low", "high"), threshold, tolerance)
    again = _split(components(likely.select(F.col("node").alias("a"), F.col("root").alias("b"))), nodes)
    return common.stored(grouped.where(F.col("blocks") <= MANY).unionByName(again))


def _split(grouped: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component, and into how many blocks its component is split by its nodes and their bytes."""
    own = grouped.join(nodes.select("node", "bytes"), "node")
    sizes = own.groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    blocks = sizes.select("component", "n", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("b") / BLOCK_BYTES, F.lit(1.0))).cast("int").alias("blocks"))
    return grouped.join(blocks, "component").select("node", "component", "blocks")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Each row's id, mark and node (set key), and each node's least id, mark, copies, class (component, a node of it) and links."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = _narrow(docs, id_col, text_col)
    features = common.stored(_features(rows))
    nodes = common.stored(features.groupBy("node").agg(F.min(F.struct("id", "mark")).alias("k"), F.count("*").alias("copies"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands")).select("node", "k.id", "k.mark", "copies", "bytes", "bands"))
    repeated = common.stored(features.groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("id", "mark"))
    repeated = None if repeated.isEmpty() else repeated
    members = _candidates(nodes, rows, repeated, threshold, tolerance)
    chosen = members.join(nodes.select("node", "id", "mark", "copies"), "node")
    spots = _dealt(_texts(chosen, rows, repeated), "component").select("spot", "node", "copies", "block", "low", "high", "text")
    n = max(common.partitions(spark), 1)
    found = common.stored(_verified(spots.repartition(n, "spot").sortWithinPartitions("spot"), threshold, tolerance))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "id", "mark", "copies").join(classes, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return features.select("id", "mark", "node"), common.stored(named)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near duplicates, that of the least id; all columns kept.

    Classes are of texts, so rows that share an id, or have none, and whose texts are unlike all stay. Where several
    texts of a class have its least id, that of the least set key stays, then the least by a hash of the text; of rows
    that share that too, the least by a hash of the row. A null id is the least of all. Texts without words (null, empty)
    are one class. An empty table gives no rows.
    """
    key, mark, again, row = (common.free_name(docs, n) for n in ("_id", "_mark", "_again", "_row"))
    features, named = _classes(docs, id_col, text_col, THRESHOLD, TOLERANCE)
    chosen = named.groupBy("component").agg(F.min(F.struct("id", "node", "mark")).alias("k")).select("k.id", "k.mark")
    counts = features.groupBy("id", "mark").agg(F.count("*").alias("n"))
    kept = common.stored(chosen.join(counts, ["id", "mark"]).select(F.col("id").alias(key), F.col("mark").alias(mark), (F.col("n") > 1).alias(again)))
    own = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn(key, common.long_id(id_col)).withColumn(mark, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    rows = marked.join(kept, [key, mark])
    if kept.where(F.col(again)).isEmpty():
        return rows.select(*own)
    least = rows.where(F.col(again)).groupBy(key, mark).agg(F.min_by(F.struct(*own), common.hashed(docs)).alias(row)).select(f"{row}.*")
    return rows.where(~F.col(again)).select(*own).unionByName(least)
