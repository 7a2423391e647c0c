"""Substring, line and near-duplicate operators against brute force."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from granary.llm import line_dedup, ngram_join, substring_dedup
from granary.llm.components import components

from .conftest import prose

LEAST = -(2**63)


def key(i):
    return LEAST if i is None else i


def brute_substring(rows, size):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, 2**63), key(i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < key(i):
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def test_substring_matches_brute_force(docs, rows):
    got = substring_dedup.deduplicate(docs)
    assert "removed_" in got.columns and got.columns[: len(docs.columns)] == docs.columns
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect())
    assert found == brute_substring(rows, 13)
    for r in got.collect():
        assert sum(x["stop"] - x["start"] for x in r["removed_"]) == r["n_removed"]
        assert all(a["stop"] < b["start"] for a, b in zip(r["removed_"], r["removed_"][1:]))


def test_line_windows_match_brute_force(docs, rows):
    order = sorted(((key(i), t or "", i) for i, t in rows))
    seen, expected = set(), []
    for _, t, i in order:
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            g = tuple(lines[k : k + 3])
            if not any(x.strip() for x in g):
                continue
            if g in seen:
                gone.update(range(k, k + 3))
            seen.add(g)
        expected.append((i, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    found = [(r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.deduplicate(docs).collect()]
    assert Counter(found) == Counter(expected)


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def test_join_matches_brute_force(docs, rows, monkeypatch):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    linked = [[j for j in range(n) if j != i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))] for i in range(n)]
    expected = []
    for i in range(n):
        reach, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        least = min(key(rows[j][0]) for j in reach)
        expected.append((rows[i][0], None if least == LEAST else least, len(linked[i])))
    for block in (512, 3):  # small blocks: a large group is dealt out as pairs of blocks
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        found = [(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.link(docs).collect()]
        assert Counter(found) == Counter(expected)


def test_one_of_each_keeps_one_row(docs):
    kept = ngram_join.one_of_each(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and kept.columns == docs.columns
    assert 3 in ids and 100 not in ids and not set(range(200, 212)) & set(ids)


def test_one_of_each_keeps_unlike_texts_of_one_id(spark):
    rng = random.Random(7)
    a, b, *other = [prose(rng, 60) for _ in range(12)]
    rows = [(7, a), (7, b), (9, b), (9, b), *[(None, t) for t in other[:6]], (None, other[0]), *[(5, t) for t in other[6:]], (5, other[6]), (5, other[6])]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    for n in (1, 7):
        got = ngram_join.one_of_each(df.repartition(n)).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(7, a), (7, b), *[(None, t) for t in other[:6]], *[(5, t) for t in other[6:]]])
        assert n == 1 or first == {r["n"] for r in got}
        first = {r["n"] for r in got}


def test_bound_never_drops_likely_pairs():
    least = [ngram_join.least_matches(n, 0.8, 1e-6) for n in (25, 50, 125)]
    assert least == sorted(least) and 0 < least[0] < 20 and least[2] < 100


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)] + [(500, 500 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 200, 300)} == {100} and {got[500 + i] for i in range(30)} == {500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(empty):
    assert substring_dedup.deduplicate(empty).count() == 0
    assert line_dedup.deduplicate(empty).count() == 0
    assert ngram_join.link(empty).count() == 0


def test_one_id_spreads_over_ranges(spark, monkeypatch):
    """A null id with most rows, and one more hot id: results as by brute force, and no range holds an unfair share."""
    from granary.llm import common

    monkeypatch.setattr(common, "RANGE_BYTES", 1 << 12)
    rng = random.Random(11)
    part = [prose(rng, 16) for _ in range(8)]
    rows = [(i, prose(rng, 14) + "\n" + rng.choice(part) + "\n" + prose(rng, 3)) for i in [None] * 260 + [50] * 160 + list(range(100))]
    rows += [(None, None)] * 40 + [(50, rows[300][1])] * 30 + [(7, prose(rng, 4000))]
    for inner in (1, 3):
        monkeypatch.setattr(common, "MOST_CUTS", 20_000 if inner == 1 else 12)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        ordered = common.in_order(df, "doc_id", "text", [])
        cut = common.ranges(ordered)
        sizes = [r[1] for r in ordered.groupBy(cut.number(F.col("_id"), F.col("_tie")).alias("r")).agg(F.sum(F.octet_length("_text") + 1)).collect()]
        assert len(sizes) > 8 and max(sizes) < 0.3 * sum(sizes)
        got = substring_dedup.deduplicate(df).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == brute_substring(rows, 13)
    lines = line_dedup.deduplicate(df.withColumn("text", F.concat(F.lit("a\nb\n"), "text"))).collect()
    whole = [(r["doc_id"], r["text"]) for r in lines]
    assert len(whole) == len(rows) and sum(r["n_removed"] == 0 for r in lines) < len(rows)
    once = Counter(tuple(t.split("\n")[k : k + 3]) for _, t in whole for k in range(len(t.split("\n")) - 2) if any(x.strip() for x in t.split("\n")[k : k + 3]))
    assert all(n == 1 for n in once.values())


def test_join_of_rows_without_an_id(spark, monkeypatch):
    """Near-alike rows that share the null id, and repeats of one row: every text is fetched once, links as by brute force."""
    rng = random.Random(21)
    base = [prose(rng, 80).split() for _ in range(3)]
    rows = []
    for k in range(150):
        w = list(base[k % 3])
        w[rng.randrange(80)] = f"e{k}"
        rows.append((None, " ".join(w)))
    rows += [(None, rows[0][1])] * 20 + [(5, rows[1][1])] * 7 + [(None, None)] * 9
    sets = [shingle_set(t) for _, t in rows]
    links = Counter(sum(1 for j, b in enumerate(sets) if j != i and (a == b or len(a & b) >= 0.8 * len(a | b))) for i, a in enumerate(sets))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    fetched = []
    monkeypatch.setattr(ngram_join, "_texts", lambda nodes, r, f, real=ngram_join._texts: (fetched.append(real(nodes, r, f)), fetched[-1])[1])
    for signed, block in ((4096, 512), (7, 16)):
        monkeypatch.setattr(ngram_join, "SIGNED", signed)
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "MANY", 16 if block == 512 else 1)
        assert Counter(r["n_links"] for r in ngram_join.link(df).collect()) == links
    assert all(t.count() == t.select("node").distinct().count() == 150 for t in fetched)


def test_chained_groups_come_apart(spark, monkeypatch):
    """A group of unlike texts that chance bands chain together is cut down to its likely pairs before texts are compared."""
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " tail") for i, t in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "MANY", 1)
    calls = []

    def chained(edges):
        calls.append(edges)
        return components(edges.unionByName(edges.select("a", F.lit(0).cast("long").alias("b"))).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).cast("long").alias("b")))) if len(calls) == 1 else components(edges)

    splits = []
    split = ngram_join._split
    monkeypatch.setattr(ngram_join, "components", chained)
    monkeypatch.setattr(ngram_join, "_split", lambda *a: (splits.append(split(*a)), splits[-1])[1])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.link(df).collect()}
    assert got == {i: (i % 100, 1) for i, _ in rows}
    assert splits[0].where("blocks > 1").count() >= 80 and splits[1].where("blocks > 1").count() == 0
