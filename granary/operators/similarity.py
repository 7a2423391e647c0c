"""Name matching: exact, containment and Ratcliff-Obershelp similarity against a dimension, best or top few."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINED = 0.9
#: Names of a dimension that are sent to every task at once; a larger dimension is gone through in parts.
PART = 20_000


def normalized(c: Column) -> Column:
    """Lower case, letters, digits and underscores alone. The text should be composed; see `composed`."""
    return F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w가-힣]", "")


def composed(c: Column) -> Column:
    """Unicode form NFC, which the JVM functions lack."""

    @F.arrow_udf("string")
    def nfc(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return nfc(c)


def composed_rows(df: DataFrame, column: str) -> DataFrame:
    """df with the column in form NFC. Only rows that hold combining signs or single letters of Hangul go through Python."""
    loose = F.coalesce(F.col(column).rlike(r"[\u0300-\u036f\u1100-\u11ff\u3099\u309a\ua960-\ua97f\ud7b0-\ud7ff]"), F.lit(False))
    return df.where(~loose).unionByName(df.where(loose).withColumn(column, composed(F.col(column))))


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """SequenceMatcher's ratio of a to b (not symmetric), or 0 where a cheap bound shows it is below `least`."""
    m = SequenceMatcher(None, a, b)
    return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0


def score(a: str, b: str, least: float = 0.0) -> float:
    """1 for equal names, CONTAINED where one is in the other, else their ratio."""
    if a == b:
        return 1.0
    return CONTAINED if a in b or b in a else ratio(a, b, least)


def _nearest(own: list[tuple[int, str]], k: int, least: float):
    @F.arrow_udf("array<struct<pos: bigint, score: double>>")
    def matched(texts: pa.Array) -> pa.Array:
        got = []
        for t in texts.to_pylist():
            found = [(-s, p) for p, n in own if t and (s := score(t, n, least)) >= least]
            got.append([{"pos": p, "score": -s} for s, p in nsmallest(k, found)])
        return pa.array(got, pa.list_(pa.struct([("pos", pa.int64()), ("score", pa.float64())])))

    # Else Spark infers a filter from a later explode and evaluates it on rows that are not distinct yet.
    return matched.asNondeterministic()


def ranked(names: DataFrame, dimension: DataFrame, k: int, least: float) -> DataFrame:
    """names (name) with matches: up to k (pos, score) of at least `least`, the best first, lower positions first on a tie.

    dimension: pos, name; both sides' names normalised. Distinct names are scored once. An empty name has no match.
    """
    out, parts = None, 0
    for own in _parts(dimension):
        one = names.select("name").distinct().withColumn("matches", _nearest(own, k, least)(F.col("name")))
        out, parts = one if out is None else out.unionByName(one), parts + 1
    if parts > 1:
        nearer = lambda a, b: F.when(a["score"] != b["score"], F.signum(b["score"] - a["score"]).cast("int")).otherwise(F.signum(a["pos"] - b["pos"]).cast("int"))
        out = out.groupBy("name").agg(F.slice(F.array_sort(F.flatten(F.collect_list("matches")), nearer), 1, k).alias("matches"))
    return out


def tiers(names: DataFrame, dimension: DataFrame, threshold: float) -> DataFrame:
    """name, pos, phase (0 exact, 1 contained, 2 similar), score: the first phase that matches, then the best, then the first.

    Unlike `ranked`, containment beats any similarity, and an empty name is contained in the first entry. Equal names meet
    by a join; the others are held against the dimension PART names at a time.
    """
    exact = names.join(dimension.groupBy("name").agg(F.min("pos").alias("exact")), "name", "left")
    open_, found = exact.where("exact is null").select("name"), None
    for part in _parts(dimension):
        one = open_.select("name", _first_tier(part, threshold)("name").alias("m")).where("m is not null").select("name", "m.*")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("name").agg(F.min(F.struct("phase", F.when(F.col("phase") == 2, -F.col("score")).alias("low"), "pos", "score")).alias("b")).select("name", "b.pos", "b.phase", "b.score")
    return exact.where("exact is not null").select("name", F.col("exact").alias("pos"), F.lit(0).alias("phase"), F.lit(1.0).alias("score")).unionByName(best)


def _parts(dimension: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The dimension in order of pos, PART names at a time; no rows are one empty part."""
    parts = max(1, -(-dimension.count() // PART))
    for part in range(parts):
        yield [(r[0], r[1]) for r in dimension.where(F.pmod("pos", F.lit(parts)) == part).select("pos", "name").orderBy("pos").collect()]


def _first_tier(own: list[tuple[int, str]], threshold: float):
    @F.arrow_udf("struct<pos: bigint, phase: int, score: double>")
    def rest(texts: pa.Array) -> pa.Array:
        got = []
        for t in texts.to_pylist():
            hit = next((p for p, n in own if t in n or n in t), None)
            if hit is not None:
                got.append({"pos": hit, "phase": 1, "score": CONTAINED})
                continue
            best = min(((-ratio(t, n, threshold), p) for p, n in own), default=(0.0, None))
            got.append({"pos": best[1], "phase": 2, "score": -best[0]} if -best[0] >= threshold and best[1] is not None else None)
        return pa.array(got, pa.struct([("pos", pa.int64()), ("phase", pa.int32()), ("score", pa.float64())]))

    return rest.asNondeterministic()


def substrings(df: DataFrame, of: str, name: str, least: int = 1) -> DataFrame:
    """df with a row for each distinct substring of `of`, at least `least` characters long, in a column of that name."""
    n = F.length(of)
    starts = F.when(n >= least, F.sequence(F.lit(1), n - least + 1)).otherwise(F.array().cast("array<int>"))
    every = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(least), n - s + 1), lambda k: F.substr(F.col(of), s, k))))
    return df.withColumn(name, F.explode(F.array_distinct(every)))


def best_in_texts(names: DataFrame, texts: DataFrame, key: str, hit: float = 0.5) -> DataFrame:
    """Each name (key, pos, name) with the text (key, text) of its own key that is most like it: sim, and whether it is a hit.

    Spaces and case don't count; one in the other is worth CONTAINED at least. The first text, in order of pos, wins a
    tie; without texts sim is 0. Names are compared with the texts of their own receipt alone, which are few.
    """
    own = texts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("texts"))

    @F.arrow_udf("struct<best: string, sim: double>")
    def best(given: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for g, ts in zip(given.to_pylist(), lists.to_pylist()):
            a, found = g.replace(" ", "").lower(), ("", 0.0)
            for t in ts or []:
                b = t.replace(" ", "").lower()
                s = ratio(a, b)
                s = max(CONTAINED, s) if a in b or b in a else s
                if s > found[1]:
                    found = (t, s)
            out.append({"best": found[0], "sim": found[1]})
        return pa.array(out, pa.struct([("best", pa.string()), ("sim", pa.float64())]))

    met = names.join(own, key, "left").withColumn("_b", best.asNondeterministic()("name", "texts"))
    return met.select(key, "pos", "name", "_b.best", F.round("_b.sim", 3).alias("sim"), (F.col("_b.sim") >= hit).alias("hit"))


def char_accuracy(reference: Column, heard: Column) -> Column:
    """1 less the edit distance over the reference's length, not below 0; spaces don't count. Without a reference, whether both are empty."""
    r, h = (F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "") for c in (reference, heard))
    return F.when(r == "", F.when(h == "", 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(r, h) / F.length(r)))


def first_contained(texts: DataFrame, text: str, passages: DataFrame, passage: str, key: str | None = None) -> DataFrame:
    """Rows of texts and passages where the text contains the passage whole.

    Both are keyed by runs of three words: a passage by its second to fourth word, which stand in the text as whole words
    if the passage does. Of the texts only ids and the keys that some passage has are joined; the few pairs that meet
    fetch their texts and are compared. The passages' keys are few and narrow; they are sent to the texts while they are
    under KEYS, and joined by a shuffle beyond that. Passages of fewer than five words can't be keyed this way; they are
    keyed by their first three characters instead, in the same manner. `key`, by default the first column, is unique in texts.
    """
    key = key or texts.columns[0]
    wide = passages.withColumn("_w", _words(F.col(passage)))
    long_ = _keyed_join(texts, text, wide.where(F.size("_w") >= 5).withColumn("_key", F.xxhash64(*[F.try_element_at("_w", F.lit(i)) for i in (2, 3, 4)])).drop("_w"), passage, key, _triples)
    short = wide.where((F.size("_w") < 5) & (F.col(passage) != ""))
    if short.isEmpty():
        return long_
    few = short.withColumn("_key", F.xxhash64(F.substring(passage, 1, 3), F.least(F.length(passage), F.lit(3)))).drop("_w")
    return long_.unionByName(_keyed_join(texts, text, few, passage, key, _starts))


#: Keys of passages that are sent to every task.
KEYS = 1_000_000


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def _triples(text: Column) -> Column:
    w = _words(text)
    n = F.size(w)
    zipped = F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(n, F.lit(1))).alias("b"), F.slice(w, F.lit(3), F.greatest(n, F.lit(1))).alias("c"))
    return F.transform(zipped, lambda t: F.xxhash64(t["a"], t["b"], t["c"]))


def _starts(text: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.flatten(F.transform(places, lambda i: F.array(*[F.xxhash64(F.substr(text, i, F.lit(k)), F.lit(k)) for k in (1, 2, 3)])))


def _keyed_join(texts: DataFrame, text: str, keyed: DataFrame, passage: str, key: str, keys_of) -> DataFrame:
    wanted = keyed.select("_key").distinct()
    runs = texts.select(key, F.explode(F.array_distinct(keys_of(F.col(text)))).alias("_key"))
    few = wanted.limit(KEYS + 1).count() <= KEYS
    hits = runs.join(F.broadcast(wanted) if few else wanted, "_key")
    narrow = keyed.drop(passage).columns
    met = hits.join(keyed.select(*narrow), "_key").drop("_key").distinct()
    rows = met.join(texts, key).join(keyed.drop("_key").distinct(), [c for c in narrow if c != "_key"])
    return rows.where(F.contains(F.col(text), F.col(passage)))
