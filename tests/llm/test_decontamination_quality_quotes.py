"""Decontamination, the quality model and quotation linking."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import common, decontamination, quality, quotes

from .conftest import prose


def words5(w):
    return {tuple(x.lower() for x in w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(x.lower() for x in w)}


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 2, 4, 5, 11, 12, 15, 24, 30, 45, 60, 200])] + [(90, ""), (91, None)]
    return spark.createDataFrame(items, "item_id long, text string"), items


def test_passages_are_found_wherever_they_begin(spark, bench):
    table, items = bench
    rng = random.Random(2)
    rows, expected = [], set()
    for k in range(120):
        i, text = items[4 + k % 8]
        w, start = text.split(), rng.randrange(0, 60)
        if k % 3 == 1 and len(w) >= 60:
            w[len(w) // 2] = "changed"
        if k % 3 == 2 and len(w) >= 30:
            w = w[1:-1]
        body = prose(rng, start).split() + [x.upper() if k % 5 == 0 else x for x in w] + prose(rng, rng.randrange(0, 60)).split()
        a, b = words5(w), words5(text.split())
        if len(a & b) / len(a | b) >= 0.83:
            expected.add((k, i))
        rows.append((k, "  ".join(body)))
    rows += [(1000 + k, prose(rng, 150)) for k in range(60)] + [(2000, None), (2001, ""), (2002, items[3][1]), (2003, items[2][1]), (None, items[8][1])]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), table.where("item_id > 1")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert expected - found == set() and len(expected) > 90
    assert not [x for x in found if x[0] is not None and 1000 <= x[0] < 2002]
    assert (2002, 3) in found and (2003, 2) in found and (None, 8) in found
    assert all(r["similarity"] >= 0.8 for r in got)


def test_cut_items_standing_alone_are_found(spark):
    rng = random.Random(12)
    items = {m: [f"x{m}_{i}" for i in range(m)] for m in (11, 20, 44, 48, 52, 56, 100, 400)}
    table = spark.createDataFrame([(m, " ".join(w)) for m, w in items.items()], "item_id long, text string")
    rows, expected = [], set()
    for m, w in items.items():
        for less in range(1, m // 5 + 1):
            for part in (w[less:], w[: m - less], w[less // 2 : m - (less - less // 2)]):
                k = 2 * len(rows)
                rows += [(k, " ".join(part)), (k + 1, prose(rng, rng.randrange(1, 9)))]  # documents between shift the alignment
                if (len(part) - 4) / (m - 4) >= 0.8:
                    expected.add((k, m))
                    rows.append((k + 10**6, prose(rng, rng.randrange(1, 30)) + " " + " ".join(part) + " " + prose(rng, 5)))
                    expected.add((k + 10**6, m))
    found = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), table).collect()
    assert expected - {(r["doc_id"], r["item_id"]) for r in found} == set() and len(expected) > 300


def test_many_items_take_several_passes(spark, bench, monkeypatch):
    table, items = bench
    df = spark.createDataFrame([(i, "before it " + t) for i, t in items if t], "doc_id long, text string")
    one = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, table.where("item_id > 3")).collect()}
    monkeypatch.setattr(decontamination, "ITEMS_A_PASS", 4)
    many = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, table.where("item_id > 3")).collect()}
    assert one == many and len(one) == 8


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(3)
    for _ in range(200):
        f = int(rng.integers(0, 2**64, dtype=np.uint64))
        g = f
        for b in rng.choice(64, decontamination.RADIUS, replace=False):
            g ^= 1 << int(b)
        assert any((g >> 16 * b & 0xFFFF) in set(decontamination.near(f >> 16 * b & 0xFFFF, decontamination.RADIUS // decontamination.BLOCKS)) for b in range(decontamination.BLOCKS))


def brute_similarity(a, b, weights, rare):
    x, y = words5(a), words5(b)
    of = lambda s: sum(weights.get(g, rare) for g in s)
    return of(x & y) / of(x | y)


def test_every_passage_that_reaches_the_threshold(spark, bench):
    """Brute force over every part of every text: what is found is what some part of the text, trimmed or not, makes of it."""
    import math

    table, items = bench
    rng = random.Random(31)
    items = [(i, t) for i, t in items if t and 5 <= len(t.split()) <= 45]
    count = {}
    for _, t in items:
        for g in words5(t.split()):
            count[g] = count.get(g, 0) + 1
    weights, rare = {g: 1 + math.log((len(items) + 1) / (n + 1)) for g, n in count.items()}, 1 + math.log(len(items) + 1)
    rows = []
    for k in range(90):
        w = items[k % len(items)][1].split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "edited"
        cut = rng.randrange(0, 4)
        rows.append((k, " ".join(prose(rng, rng.randrange(1, 12)).split() + w[cut:] + prose(rng, rng.randrange(1, 12)).split())))
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, text in rows:
        w = text.split()
        for i, item in items:
            own = item.split()
            m = len(own)
            best = max((brute_similarity(w[s : s + n], own, weights, rare) for n in range(max(5, m - m // 4), m + 1) for s in range(len(w) - n + 1)), default=0)
            if best >= 0.8 + 1e-9:
                assert (k, i) in got and got[k, i]["similarity"] <= best + 1e-9
            elif (k, i) in got:
                raise AssertionError((k, i, best, got[k, i]))


def test_item_ids_of_any_type_and_clashing_names(spark):
    text = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([("a", "x " + text, 1), ("b", None, 2)], "item_id string, text string, start int")
    bench = spark.createDataFrame([("one", text), ("two", None)], "item_id string, text string")
    got = decontamination.contaminated(docs, bench, id_col="item_id")
    assert [(r["item_id"], r["item_id_"]) for r in got.collect()] == [("a", "one")]
    assert [r["item_id"] for r in decontamination.clean(docs, bench).collect()] == ["b"]


def test_repeated_ids_are_one_row_of_training(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i} of some words") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)] * 5, "doc_id long, quality int")
    seen = []
    real = quality.fit_model
    quality.fit_model = lambda x, y: (seen.append(len(y)), real(x, y))[1]
    try:
        quality.fit(docs, labels)
        quality.fit(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")), spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")), most=500)
    finally:
        quality.fit_model = real
    assert seen[0] <= 3 and seen[1] == 500


def test_clean_keeps_the_rest(docs, bench, empty):
    table, _ = bench
    assert decontamination.clean(docs, table.where("item_id > 3")).count() == docs.count()
    assert decontamination.contaminated(empty, table).count() == 0
    assert decontamination.contaminated(docs, table.limit(0)).count() == 0


def labelled(spark, n=600):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(rng, rng.randrange(20, 90))
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 8 else " | ".join(text.split())
        rows.append((i, text, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_model_learns_and_held_out_rows_are_unseen(spark):
    t = labelled(spark)
    docs, labels = t.select("doc_id", "text"), t.select("doc_id", "quality")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    right = sum(r["predicted"] == r["quality"] for r in got)
    assert len(got) > 80 and right / len(got) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, flipped)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables))
    assert len(quality.fit(docs, labels, most=100).tables) == len(quality.FEATURES)


def test_scores_are_sums_of_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction that no single feature shows
    model = quality.fit_model(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and any({i, j} == {0, 1} for i, j, _ in model.pairs)
    z = np.full(len(x), model.bias)
    for k in range(4):
        z += np.array([model.tables[k][np.searchsorted(model.cuts[k], v, side="right")] for v in x[:, k]])
    for i, j, t in model.pairs:
        z += np.array([t[np.searchsorted(model.pair_cuts[i], r[i], side="right"), np.searchsorted(model.pair_cuts[j], r[j], side="right")] for r in x])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-z)))


def test_quality_edge_cases(docs, empty, spark):
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.score(docs, none)
    assert "score_" in got.columns and got.count() == docs.count() and {r["score_"] for r in got.collect()} == {0.5}
    assert quality.score(empty, none).count() == 0
    same = quality.fit(docs, docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality")))
    assert min(r["score_"] for r in quality.score(docs, same).collect()) > 0.8


def test_features_do_not_depend_on_batching():
    texts = ["A b c. A b c.", "", "x | y!! 12 #a", "é É", "l\nl\nm"]
    data, starts = common.utf8(pa.array(texts))
    together = quality.features(data, starts)
    for k, t in enumerate(texts):
        assert np.allclose(together[k], quality.features(*common.utf8(pa.array([t])))[0])
    assert not together[1].any()


CHAT = [
    (1, 0, "Anna", "The build fails on ARM.\n\nDoes anyone know why?"),
    (1, 1, "Ben", "> The build fails on ARM.\nWhich compiler?"),
    (1, 2, "Cem", "Ben wrote:\n> > The build fails on ARM.\n> Which compiler?\nGCC 14, I think."),
    (1, 3, "Dee", "> Does anyone\n> know why?\nThe flags."),
    (1, 4, "Eve", "Thanks all."),
    (1, 5, "Fay", "> never said by anyone\nWhat?"),
    (2, 0, "Ann", "The build fails on ARM."),
    (2, 1, "Bob", "Which compiler?"),
    (2, 1, "Bob", "Which compiler?"),
    (3, 5, "Kim", None),
    (3, 9, "Kim", ""),
    (None, 1, "x", "> a\nb"),
    (4, None, "x", "alone"),
]


def test_quotes_link_to_their_messages(spark):
    df = spark.createDataFrame([(*r, 7) for r in CHAT], "conv_id long, turn long, role string, text string, depth int")
    got = quotes.link(df, linear=False)
    by = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert got.count() == len(CHAT) and "depth_" in got.columns
    parent = {k: r["parent_turn"] for k, r in by.items() if k[0] == 1}
    assert parent == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): None, (1, 5): None}
    assert by[1, 2]["text"] == "GCC 14, I think." and by[1, 2]["quote_depth"] == 2 and by[1, 2]["n_quoted"] == 2
    assert by[1, 2]["root_turn"] == 0 and by[1, 2]["depth_"] == 2 and by[1, 3]["depth_"] == 1
    assert [by[1, t]["position"] for t in range(6)] == [1, 2, 3, 4, 5, 6] and by[1, 5]["text"] == "What?"
    assert by[None, 1]["text"] == "b" and by[None, 1]["position"] == 1 and by[4, None]["root_turn"] is None
    assert by[3, 5]["text"] == "" and by[2, 1]["position"] == 2


def test_the_message_quoted_most_is_the_parent(spark):
    said = [(1, "First one.\nSecond one.\nThird one.\nw"), (2, "Hello"), (3, "Hello"), (5, "First one.\nSecond one.\nThird one.\nu\nv")]
    asked = [(6, "> First one.\n> Second one.\n> Third one.\n> u\nYes."), (7, "> Hello\nHi."), (8, "> First one.\nAnd?")]
    df = spark.createDataFrame([("c", t, "u", x) for t, x in said + asked], "conv_id string, turn long, role string, text string").repartition(3)
    got = {r["turn"]: r["parent_turn"] for r in quotes.link(df, linear=False).collect()}
    assert got == {1: None, 2: None, 3: None, 5: None, 6: 5, 7: 3, 8: 5}


def test_parents_match_counting_every_pair():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(2, 30)
        turn = sorted(rng.randrange(40) for _ in range(n))
        own = [rng.sample(range(9), rng.randrange(5)) for _ in range(n)]
        quoted = [[{"level": v, "h": h, "size": 1 + h % 4} for v in range(1, 3) for h in rng.sample(range(10), rng.randrange(4))] for _ in range(n)]
        expected = []
        for t in sorted(set(turn)):
            for level in (1, 2):
                sizes = {k["h"]: k["size"] for i in range(n) if turn[i] == t for k in quoted[i] if k["level"] == level}
                scores = [(sum(s for h, s in sizes.items() if any(h in own[i] for i in range(n) if turn[i] == o)), o) for o in set(turn) if o < t]
                if scores and max(scores)[0]:
                    expected.append((t, max(scores)[1]))
                    break
        assert quotes.most_quoted(turn, own, quoted) == expected


def test_unquoted_messages_follow_one_another(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 4)
    rows = [(1, t, "u", f"line {t}") for t in range(0, 40, 3)] + [(2, 0, "u", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted((r["conv_id"], r["turn"], r["parent_turn"], r["root_turn"], r["depth"], r["position"]) for r in quotes.link(df).where("parent_turn is not null").collect())
    assert got == [(1, t, t - 3, 0, k + 1, k + 2) for k, t in enumerate(range(3, 40, 3))]
    assert quotes.link(df.limit(0)).count() == 0


def test_clean_drops_what_is_found(spark, bench):
    table, items = bench
    rows = [(1, items[8][1], "a"), (2, "before " + items[9][1] + " after", "b"), (3, "nothing to see here at all", "c"), (None, None, "d"), (1, "other text", "e")]
    got = decontamination.clean(spark.createDataFrame(rows, "doc_id long, text string, item_id string"), table.where("item_id > 3"))
    assert got.columns == ["doc_id", "text", "item_id"] and {r["item_id"] for r in got.collect()} == {"c", "d", "e"}


def test_very_long_runs_of_marks_and_breaks(spark):
    n = 100_000
    quote = "> a passage that is quoted here"
    texts = ["a passage that is quoted here", ">" * n + " deep", "> " * n + "deep", "\n" * n + quote + "\nown" + "\n" * n, " " * n + "x" + " " * n, "\r\n" * n, (">\n" * n), "\n".join(">" * k + " x" for k in range(300)), ">" + " " * n]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string")
    got = {r["turn"]: r for r in quotes.link(df).collect()}
    assert [got[i]["quote_depth"] for i in range(9)] == [0, n, n, 1, 0, 0, 1, 299, 1]
    assert got[3]["text"] == "own" and got[3]["linked"] and got[3]["parent_turn"] == 0
    assert got[4]["text"] == " " * n + "x" and got[5]["text"] == "" and got[1]["text"] == ""


def test_marks_by_a_slower_rule(spark):
    import random
    import re

    rng = random.Random(3)
    texts = ["".join(rng.choice("> \ta\n\r") for _ in range(rng.randrange(30))) for _ in range(400)]

    def slow(text):
        out = []
        for line in re.split("\r?\n", text):
            m = re.match(r"(?:[ \t\n\x0b\f\r]*>)+", line)
            out.append((m[0].count(">"), re.sub(r"^[ \t\n\x0b\f\r]", "", line[m.end() :], count=1)) if m else (0, line))
        return out

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quotes.parsed(F.col("t")).alias("p"), quotes.tidy(F.col("t")).alias("tidy"))
    for r in df.collect():
        assert [(x["level"], x["said"]) for x in r["p"]] == slow(r["t"])
        assert r["tidy"] == re.sub(r"\A(?:[ \t]*\n)+", "", r["t"]).rstrip(" \t\n\x0b\f\r")
