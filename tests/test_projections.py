"""Projections, model answers, made data and name matching on small tables."""

import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from granary.operators import monitoring, similarity
from granary.plans import matching, projections, receipts_v1, recommend, silver


def test_answers_of_models(spark):
    rows = [
        ("a", '<think>[1]</think> ```json\n[{"product_name": " 두부 ", "amount_krw": "1,200", "notes": "x"}, {"product_name": "두부", "amount_krw": 1200}, {"product_name": "비닐봉투"}, {"product_name": ""}, {"product_name": "콩", "amount_krw": "1.5"}]\n```'),
        ("b", "no list at all"), ("c", None), ("d", '[{"product_name": "쌀"}]'),
    ]
    got = projections.answered_items(spark.createDataFrame(rows, "receipt_id string, text string")).collect()
    assert {(r["receipt_id"], r["product_name"], r["amount_krw"], r["notes"]) for r in got} == {("a", "두부", 1200, "x"), ("a", "콩", None, ""), ("d", "쌀", None, "")}
    row = spark.createDataFrame([('x {"a": {"b": 1}} y', "}{")], "t string, u string").select(projections.json_object(F.col("t")), projections.json_object(F.col("u"))).first()
    assert tuple(row) == ('{"a": {"b": 1}}', None)


def test_fallbacks_and_providers(spark):
    items = spark.createDataFrame([("r", 0, "두부", None, "1,000", None), ("r", 1, None, "두부", "1000", "n"), ("r", 2, "", "", "5", "")], "receipt_id string, pos int, product_name string, name string, amount_krw string, notes string")
    assert [(r["product_name"], r["amount_krw"]) for r in projections.fallback_items(items).collect()] == [("두부", 1000)]
    known = spark.createDataFrame([(1, "rule", ["a"]), (2, "rule", ["b"])], "recipe_id int, reason string, substitutes array<string>")
    said = spark.createDataFrame([(1, "said", None), (3, "lost", None)], "recipe_id int, reason string, substitutes array<string>")
    got = {r["recipe_id"]: (r["reason"], r["substitutes"], r["reason_source"]) for r in projections.enriched(known, said).collect()}
    assert got == {1: ("said", ["a"], "provider"), 2: ("rule", ["b"], "rules")}


def test_boxes_and_responses(spark):
    df = spark.createDataFrame([(1,)], "a int").select(projections.box_union(F.array(projections.box_of_sides(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))), projections.box_of_sides(F.array(*map(F.lit, (0.0, 3.0, 2.0, 9.0)))))).alias("b")).first()
    assert [(p["x"], p["y"]) for p in df["b"]] == [(0.0, 2.0), (3.0, 2.0), (3.0, 9.0), (0.0, 9.0)]
    receipts = spark.createDataFrame([("r", "shop")], "receipt_id string, vendor_name string")
    lines = spark.createDataFrame([("r", 1, "b", 0.5), ("r", 0, "a", 0.5)], "receipt_id string, line_id int, text string, confidence double")
    body = projections.response(receipts, lines, F.lit("t")).first()["body"]
    assert '"trace_id":"t"' in body and body.index('"text":"a"') < body.index('"text":"b"') and '"vendor_name":"shop"' in body


def test_arguments_are_checked(spark):
    df = spark.createDataFrame([(1, "a", "볶기", "STIRFRY", 0.5, 0.5)], "recipe_id int, category string, method string, method_code string, score double, match_rate double")
    assert recommend.recommended(df, method="stirfry").count() == recommend.recommended(df, method="볶기").count() == 1 and recommend.recommended(df, category="b").count() == 0
    for wrong in ({"top_k": 0}, {"top_k": 101}, {"min_score": 1.5}, {"min_match_rate": -0.1}):
        with pytest.raises(ValueError):
            recommend.recommended(df, **wrong)


def test_report_text(spark):
    items = spark.createDataFrame([(k, f"f{k % 7}", "우유1", "우유", 0.5, "p") for k in range(40)] + [(99, "f", "에누리", "에누리", 0.9, "p")], "pos int, file_name string, raw_name string, normalized_name string, confidence double, parse_pattern string")
    none = spark.createDataFrame([], "product_name string, ingredientName string, mapping_source string, similarity double")
    text = matching.markdown_report(matching.mining_groups(items, none), {"receipt_count": 7})
    assert "- `우유1` -> `우유` (count=40, avg_conf=0.5, files=f0, f1, f2, f3, f4)" in text and text.index("Unmapped") < text.index("False Positive") and "- `에누리`" in text and "## Weak Match Products\n\n- none" in text


def test_made_receipts_repeat(spark):
    goods = [(f"p{i}", 100 * i, "c") for i in range(1, 21)]
    one, two = (silver.synthetic(spark, 50, ["a", "b"], goods, seed=3).orderBy("receipt_id").collect() for _ in range(2))
    assert one == two and all(3 <= len(r["items"]) <= 15 and r["total"] == sum(i["unit_price"] * i["quantity"] for i in r["items"]) and len({i["product_name"] for i in r["items"]}) == len(r["items"]) for r in one)
    assert {i["quantity"] for r in one for i in r["items"]} <= {1, 2, 3, 4} and len({len(r["items"]) for r in one}) > 5


def test_labels_meet_names_both_ways(spark):
    df = spark.createDataFrame([("두부 조림",), ("콩",), ("사과",), ("",)], "n string")
    labels = spark.createDataFrame([("두부",), ("콩나물",), ("",)], "name string")
    got = {r["n"]: r["known"] for r in receipts_v1.known_label(F.col("n"), labels, df).collect()}
    assert got == {"두부 조림": True, "콩": True, "사과": False, "": True}


def test_best_text_for_a_name(spark):
    names = spark.createDataFrame([(1, 0, "서울 우유"), (1, 1, "두부"), (2, 0, "콩")], "k int, pos int, name string")
    texts = spark.createDataFrame([(1, 0, "서울우유 1L"), (1, 1, "두브"), (1, 2, "x")], "k int, pos int, text string")
    got = {r["name"]: (r["best"], r["sim"], r["hit"]) for r in similarity.best_in_texts(names, texts, "k").collect()}
    assert got["서울 우유"] == ("서울우유 1L", 0.9, True) and got["두부"] == ("두브", SequenceMatcher(None, "두부", "두브").ratio(), True) and got["콩"] == ("", 0.0, False)


def test_short_and_long_passages(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "xa b"), (3, "b c d e f"), (4, None)], "doc_id int, text string")
    items = spark.createDataFrame([(10, "b c d e f"), (11, "a b"), (12, "zz"), (13, ""), (14, "g")], "item_id int, passage string")
    got = {(r["doc_id"], r["item_id"]) for r in similarity.first_contained(docs, "text", items, "passage").collect()}
    assert got == {(1, 10), (1, 11), (2, 11), (3, 10), (1, 14)}


def test_composed_names(spark):
    loose = unicodedata.normalize("NFD", "두부é")
    got = [r["n"] for r in similarity.composed_rows(spark.createDataFrame([(loose,), ("abc",), (None,)], "n string"), "n").collect()]
    assert set(got) == {"두부é", "abc", None}


def test_exact_rank_of_skewed_values(spark):
    import random

    rng = random.Random(1)
    rows = [(k, float(rng.choice([1, 1, 1, 5, rng.randrange(10**6)]))) for k in range(3) for _ in range(4000 if k else 3)]
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r["k"]: r["v"] for r in monitoring.ranked_value(spark.createDataFrame(rows, "k int, x double"), ["k"], "x", share, "v").collect()}
        for k in range(3):
            own = sorted(x for i, x in rows if i == k)
            assert got[k] == own[min(int(len(own) * share), len(own) - 1)]
    assert monitoring.ranked_value(spark.createDataFrame(rows, "k int, x double"), [], "x", 0.5, "v").count() == 1
    assert monitoring.thresholds(expiry_alert_days=5)["expiry_alert_days"] == 5 and monitoring.fallback("none") is None
