"""Packing and sharding by exact round trips."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import common, packing, sharding, tokens


def test_pieces_hold_every_id_once(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    got = packing.pack(docs).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for i, text in rows:
        own = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        ids = [x for p in pieces for x in np.frombuffer(p["ids"], "<u4").tolist()]
        copies = len(ids) // len(own)
        assert Counter(ids) == Counter(own * copies)
        if copies == 1:
            assert ids == own and [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces]])[:-1].tolist()
        assert all(p["doc_tokens"] == len(own) and p["length"] * 4 == len(p["ids"]) for p in pieces)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1024), min_size=1, max_size=150))
def test_differencing_fits_and_is_near_equal(sizes):
    s = np.array(sizes)
    window = packing.windows_for(s, 4096)
    loads = np.bincount(window, weights=s)
    assert loads.max() <= 4096 and len(window) == len(s)
    assert len(loads) <= -(-int(s.sum()) // 4096) + 2


def test_differencing_tracks_loads():
    s = np.array([8, 7, 6, 5, 4])
    window, loads = packing.difference(s, 2)
    assert sorted(np.bincount(window, weights=s).astype(int).tolist()) == sorted(loads.tolist()) == [14, 16]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abcZÉéßñ×÷ '’.,!?-12 \t\n\x1ćﬁ日|<>")), max_size=25), max_size=4))
def test_unit_cache_equals_tokenizer(texts):
    e = tokens.encoder(packing.vocabulary())
    data, starts = common.utf8(pa.array(texts, pa.string()))
    ids, at = e.encode(data, starts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_cache_overflow_keeps_results():
    e = tokens.Encoder(packing.vocabulary(), capacity=3)
    data, starts = common.utf8(pa.array(["one two three", "four five six seven"]))
    for _ in range(2):
        ids, at = e.encode(data, starts)
        assert ids[at[1] : at[2]].tolist() == e.tokenizer.encode("four five six seven", add_special_tokens=False).ids


def test_cache_holds_few_bytes_a_unit():
    import tracemalloc

    e = tokens.Encoder(packing.vocabulary())
    n = 20_000
    units = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(n)]
    data, starts = common.utf8(pa.array([" ".join(units)]))
    held = []
    for own in (tokens.Encoder(packing.vocabulary()), e):  # the first has what the code keeps by itself
        tracemalloc.start()
        own.encode(data, starts)
        held.append(tracemalloc.get_traced_memory()[0])
        tracemalloc.stop()
    assert held[1] < 80 * n


def test_a_worker_gives_its_memory_back():
    import os

    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    pins = []

    def work(batches):
        for b in batches:
            held = [np.ones(12_000, np.int8) for _ in range(16_000)]
            pins.append(np.ones(12_000, np.int8))  # what stays lies above what goes
            del held
            yield b

    before = resident()
    assert list(common.light(work)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 60 << 20


def test_shards_hold_every_row_once(docs, rows):
    got = sharding.shuffle_into_shards(docs, 4, seed=3, bucket_bytes=1 << 16)
    found = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(rows)
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    again = sharding.shuffle_into_shards(docs.repartition(2), 4, seed=3, bucket_bytes=1 << 16).collect()
    assert Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in again if r["doc_id"] != 308) == Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in found if r["doc_id"] != 308)
    other = sharding.shuffle_into_shards(docs, 4, seed=4, bucket_bytes=1 << 16).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in other} != {(r["doc_id"], r["shard"], r["slot"]) for r in found}


def test_one_hot_id_scatters(spark):
    df = spark.createDataFrame([(7, "same")] * 400 + [(i, str(i)) for i in range(100)], "doc_id long, text string")
    got = sharding.shuffle_into_shards(df, 5).collect()
    hot = Counter(r["shard"] for r in got if r["doc_id"] == 7)
    assert len(got) == 500 and len(hot) == 5 and max(hot.values()) < 100


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, s).tolist()) for s in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850


def test_written_shards(docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 2)
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_empty_tables(empty):
    assert packing.pack(empty).count() == 0
    assert sharding.shuffle_into_shards(empty, 8).count() == 0


def test_rows_of_one_id_scatter(spark):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(4000)] + [(1, "x")] * 500, "doc_id long, text string")
    got = sharding.shuffle_into_shards(df, 8, bucket_bytes=1 << 12).collect()
    for hot in (None, 1):
        n = Counter(r["shard"] for r in got if r["doc_id"] == hot)
        assert len(n) == 8 and max(n.values()) < 1.6 * min(n.values())


def test_several_buckets_in_a_partition(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i}" * 9) for i in range(3000)], "doc_id long, text string")
    one = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(df, 3, bucket_bytes=1 << 12).collect()}
    monkeypatch.setattr(common, "MOST_PARTITIONS", 5)
    assert one == {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(df, 3, bucket_bytes=1 << 12).collect()}


def test_many_small_partitions_pack_as_one(spark):
    from .conftest import prose
    import random

    rng = random.Random(8)
    df = spark.createDataFrame([(i, prose(rng, rng.randrange(20, 1500))) for i in range(900)], "doc_id long, text string")
    for n in (1, 200):
        got = packing.pack(df.repartition(n)).groupBy("sequence_id").sum("length").collect()
        assert sum(r[1] for r in got) / (4096 * len(got)) > 0.97
