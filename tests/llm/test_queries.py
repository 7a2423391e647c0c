"""The operators' queries on the driver's smallest tables: SQL where there is some, else the contract's invariants."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from granary.llm import common, queries

from ..compare import FOLDER, oracle, same

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, FOLDER), oracle(), queries.ORACLE_SQL[name])


def rows(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


def test_sharding(spark, texts):
    got = rows(spark, "op2_sharding")
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_decontamination(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in rows(spark, "op1_decontamination")}
    assert {(d, i) for d, t in texts.items() for i, b in items.items() if b in t} <= got


def test_pii(spark, texts):
    from .test_fingerprints_pii import brute

    for r in rows(spark, "op4_pii"):
        spans = brute(texts[r["doc_id"]])
        base = [f"{k}:{s}:{e}" for k, own in zip(("email", "ip", "card", "phone"), spans) for s, e in own]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and [len(s) for s in spans] == [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]]
        assert set(base) <= set(r["spans"].split(","))


def test_fingerprints(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, "op5_fingerprints")}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(t) // 4
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > mean("near_next") + 0.1


def test_packing_padding(spark, texts):
    got = rows(spark, "op7_packing")
    full = defaultdict(int)
    for r in got:
        full[r["sequence_id"]] += r["length"]
    assert sum(full.values()) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values()) and max(full.values()) <= 4096
    assert sum(full.values()) / (4096 * len(full)) > 0.9


def test_quality_and_quotes(spark, texts):
    got = rows(spark, "op9_quality")
    assert {r["doc_id"] for r in got} == set(texts) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    chat = rows(spark, "op10_chat_quotes")
    assert len({(r["conv_id"], r["position"]) for r in chat}) == len(chat)


def test_pipeline_stage_by_stage(spark, texts):
    docs = common.table(spark, FOLDER, "documents")
    names = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = dict(texts)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.stored(stage(spark, docs, FOLDER))
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        now = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == names and set(now) <= set(before)
        gone = set(before) - set(now)
        if name == "quality":
            kept_good = [i for i in before if labels.get(i) == 1 and i in now]
            assert len(kept_good) >= 0.9 * sum(v == 1 for v in labels.values())
        elif name == "line_dedup":
            assert not gone and all(r["n_chars"] == len(r["text"]) for r in now.values())
        elif name == "near_duplicates":
            w = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in before.items()}
            sets = {i: {tuple(x[j : j + 5]) for j in range(len(x) - 4)} or {tuple(x)} for i, x in w.items()}
            for i in gone:
                assert any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in before if j != i)
        else:
            assert {i for i, t in before.items() if any(b in t for b in items)} <= gone
        before = {i: r["text"] for i, r in now.items()}
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == set(before) and all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in pieces)


def test_pipeline_with_other_columns_nulls_and_no_rows(spark, tmp_path):
    """Columns called as the stages call their own change nothing; null ids and texts, empty, long and repeated rows pass."""
    import random

    from pyspark.sql import functions as F

    from .conftest import prose

    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(40, 200))) for i in range(60)] + [(None, prose(rng, 80)) for _ in range(20)]
    rows += [(70, None), (71, ""), (72, " \n "), (73, prose(rng, 20000)), (5, rows[5][1]), (5, rows[5][1])]
    plain = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("predicted", "score", "_id", "_tie", "_range", "_text", "_rest", "class_id", "node", "item_id", "removed", "n_removed", "id", "mark")
    more = plain.select("*", *[F.lit("x").alias(n) for n in names])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(rng, 30)), (2, " ".join(rows[9][1].split()[:35]))], "item_id long, text string")
    out = []
    for k, docs in enumerate((plain, more, plain.limit(0))):
        folder = str(tmp_path / str(k))
        for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            df.write.parquet(f"{folder}/{name}.parquet")
        got = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg(F.count_distinct("start").alias("n"), F.sum("length").alias("ids")).collect()
        out.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n"], r["ids"]) for r in got))
    assert out[0] == out[1] and out[2] == []
    ids = {r[1] for r in out[0] if not r[0]}
    assert ids >= set(range(60)) - {9} | {70, 73} and not ids & {9, 71, 72} and any(r[0] for r in out[0])
