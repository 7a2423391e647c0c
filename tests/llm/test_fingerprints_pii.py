"""Fingerprints and personal data against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import common, fingerprints, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        own = []
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            own.append(m.span())
        out.append(own)
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from(list("ab1259.@-_+% ()\né")), max_size=60))
def test_patterns_match_brute_force(text):
    assert pii.base_spans(text) == brute(text)


def test_cards_and_code_points():
    text = "née 4111 1111 1111 1111, 4111-1111-1111-1112, 1.2.3.4.5.6.7.8 300.1.1.1 a@b.c@d.e"
    assert pii.base_spans(text) == brute(text)
    assert len(pii.base_spans(text)[2]) == 1 and len(pii.base_spans(text)[1]) == 2


def test_spans_of_a_table(docs, rows, spark):
    df = spark.createDataFrame([(1, "Write a.b@c.org or +49 151 2345678 now."), (2, None), (3, ""), (3, "x 10.0.0.1 y"), (None, "4111111111111111")], "doc_id long, text string")
    got = {(r["doc_id"], r["spans"]): r for r in pii.find(df).collect()}
    assert (1, "email:6:15,phone:19:34") in got and (2, "") in got and (3, "ip:2:10") in got and (None, "card:0:16") in got
    assert pii.find(docs).count() == len(rows)


def trained():
    rng = random.Random(2)
    texts = []
    for k in range(120):
        d = "".join(rng.choice("0123456789") for _ in range(7))
        texts.append(f"Call +1 (826) 555-{d[:4]} or 10.{k}.0.7 at a.b{k}@c.org now, 4111111111111111 paid {d[:2]} in 2019, order {d} or {d[:3]}-{d[3:]}-{d}.")
    got = [pii.lesson(t, rng) for t in texts]
    at = np.cumsum([0, *[len(g[1]) for g in got]])
    return pii.fit(*(np.concatenate([g[c] + (a if c in (2, 3) else 0) for g, a in zip(got, at)]) if c in (2, 3) else np.concatenate([g[c] for g in got]) for c in range(5)))


def found(text, field):
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["t"])
    (_, _, spans, t), = pii._marked_rows(batch, 0)
    base = pii.labels_of(t, spans)
    return [[text[s:e] for s, e in own] for own in pii.added_spans(t, base, pii.label(t, base, field), text)]


def test_kinds_of_repeats():
    field = trained()
    assert found("Write to jane.roe7@mail.example.org. Later: jane.roe7(at)mail.example.org, or jane.roe7 alone, not june.", field) == [["jane.roe7(at)mail.example.org", "jane.roe7"], [], [], []]
    assert found("Card 4111 1111 1111 1111 was charged. Again 4111/1111/1111/1111 but 1111 and 4111/2222/3333/4444 not.", field) == [[], [], ["4111/1111/1111/1111"], []]
    assert found("Host 10.20.30.40 is down, see log 10-20-30-40 and 10-20-30-41.", field) == [[], ["10-20-30-40"], [], []]


def test_planted_repeats_in_a_table(spark):
    """Recall and precision of the production settings, fitted on the table itself: altered repeats are planted with the
    values they repeat, and as many altered values that repeat nothing."""
    from .conftest import prose

    rng = random.Random(17)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    make = {"email": lambda: f"{rng.choice(['anna', 'ben', 'cem'])}.{number(3)}@mail{number(2)}.example.org", "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), "phone": lambda: f"+{rng.randrange(1, 99)} {number(3)} {number(3)}-{number(4)}"}
    rows, planted, strangers = [], [], []
    for k in range(500):
        text = prose(rng, 60) + f" order {number(8)} of {number(3)}"
        if k % 2:
            kind = rng.choice(sorted(make))
            value = make[kind]()
            while not pii.base_spans(value)[pii.KINDS.index(kind)]:
                value = make[kind]()
            text += f" reach {value} " + prose(rng, 25)
            for _ in range(2):
                w, other = pii.altered(kind, value, rng), pii.altered(kind, make[kind](), rng)
                for x, to in ((w, planted), (other, strangers)):
                    text += " " + prose(rng, 8) + " "
                    to.append((k, f"{kind}:{len(text)}:{len(text) + len(x)}"))
                    text += x
        rows.append((k, text))
    got = {r["doc_id"]: set(r["spans"].split(",")) - set(r["base_spans"].split(",")) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = sum(map(len, got.values()))
    hit = sum(s in got[k] for k, s in planted)
    wrong = sum(s in got[k] for k, s in strangers)
    assert hit >= 0.9 * len(planted) and wrong <= 0.02 * len(strangers) and hit >= 0.95 * added, (hit, len(planted), wrong, len(strangers), added)


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 30)
    seen = []
    real = pii.fit
    monkeypatch.setattr(pii, "fit", lambda x, *rest: (seen.append(len(x)), real(x, *rest))[1])
    df = spark.createDataFrame([(None, "card 4111111111111111 and 7")] * 500 + [(i, f"n {i}") for i in range(400)], "doc_id long, text string")
    assert pii.find(df).count() == 900 and 10 <= seen[0] <= 90


def test_skip_edges_carry_labels_to_repeats():
    field = trained()
    assert found("Call +1 (826) 555-4081 today. Long after that, ring 826-555-4081 again, or visit room 12.", field) == [[], [], [], ["826-555-4081"]]
    assert not any(found("Just 826-555-4081 and room 12.", field))


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(1)
    unary, pair = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    edges = np.array([[0, 1], [1, 2], [2, 3]])
    joint = np.zeros((3,) * 4)
    for idx in np.ndindex(*joint.shape):
        joint[idx] = np.exp(sum(unary[k, v] for k, v in enumerate(idx)) + sum(pair[idx[a], idx[b]] for a, b in edges))
    joint /= joint.sum()
    got = pii.marginals(unary, [(edges, pair)], rounds=60)
    for k in range(4):
        assert np.allclose(got[k], joint.sum(tuple(a for a in range(4) if a != k)), atol=1e-5)


def test_labels_reach_every_repeat():
    n, size = 31, 5
    unary = np.zeros((n, size))
    unary[0, 1:] = unary[0, 0] = -50.0
    unary[0, 4] = 0.0
    edges = np.stack([np.arange(n - 1), np.arange(1, n)], 1)
    for lean in (0.0, -0.4):
        unary[1:, 4] = lean
        pair = np.eye(size) * np.log(200)
        ahead, behind = [np.exp(unary[0])], [np.ones(size)]
        for k in range(1, n):
            ahead.append(ahead[-1] @ np.exp(pair) * np.exp(unary[k]))
            behind.append(np.exp(pair) @ (behind[-1] * np.exp(unary[n - k])))
        exact = np.array(ahead) * np.array(behind[::-1])
        exact /= exact.sum(1, keepdims=True)
        assert np.allclose(pii.marginals(unary, [(edges, pair)]), exact, atol=1e-4)


def test_a_text_with_thirty_repeats():
    field = trained()
    full, again = "Call +1 (826) 555-4081 today.", " Long after that, ring 826-555-4081 again, or visit room 12."
    for n in (1, 2, 5, 10, 30):
        for text in (full + again * n, again * n + " " + full):
            assert found(text, field) == [[], [], [], ["826-555-4081"] * n]


def test_edited_texts_match_brute_force(docs, rows):
    check_edited(docs, rows)


def check_edited(docs, rows):
    got = sorted(fingerprints.edited_likeness(docs).collect(), key=lambda r: (-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited"]))
    hashes = {r["text"] or "": r["h"] for r in docs.select("text", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 33).alias("h")).collect()}
    order = [(i, t) for i, _, t in sorted((-(2**63) if i is None else i, hashes[t or ""], t or "") for i, t in rows)]
    expected = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        expected.append((i, len(t), edited, fingerprints.fingerprint(t.encode()), fingerprints.fingerprint(edited.encode()), fingerprints.compare(fingerprints.fingerprint(t.encode()), fingerprints.fingerprint(after.encode()))))
    expected.sort(key=lambda r: r[:3])
    found = [(-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited"], r["fingerprint"], r["edited_fingerprint"], r["near_next"]) for r in got]
    assert sorted(found) == sorted(expected)


def test_rows_of_one_id_follow_one_another(spark, monkeypatch):
    monkeypatch.setattr(common, "RANGE_BYTES", 1 << 10)
    rows = [(None, f"text number {i} of none") for i in range(300)] + [(9, f"nine {i}") for i in range(200)] + [(None, "same")] * 100 + [(i, f"own {i} {'x' * i}") for i in range(60)] + [(3, None), (3, "")]
    check_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_short_texts_differ():
    for a, b in (("ab", "xy"), ("ab", "ba"), ("a", "b"), ("", "a"), ("aa", "a")):
        assert fingerprints.fingerprint(a.encode()) != fingerprints.fingerprint(b.encode())


def test_likeness_separates():
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 105, 4000, dtype=np.uint8))
    other = bytes(rng.integers(97, 117, 4000, dtype=np.uint8))
    same = fingerprints.compare(fingerprints.fingerprint(text), fingerprints.fingerprint(text))
    near = fingerprints.compare(fingerprints.fingerprint(text), fingerprints.fingerprint(text[:3600] + other[:400]))
    far = fingerprints.compare(fingerprints.fingerprint(text), fingerprints.fingerprint(other))
    assert same == 1.0 and 0 <= far < near < 1
    for t in (b"", b"a", b"ab", b"abc"):
        assert fingerprints.compare(fingerprints.fingerprint(t), fingerprints.fingerprint(t)) == 1.0


def test_with_fingerprint_and_empty(spark, empty):
    df = spark.createDataFrame([("x", "old"), (None, "old")], "text string, fingerprint string")
    got = fingerprints.with_fingerprint(df).collect()
    assert got[1]["fingerprint_"] == fingerprints.fingerprint(b"") and got[0]["fingerprint"] == "old"
    assert fingerprints.edited_likeness(empty).count() == 0 and pii.find(empty).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
