"""Generic operators and text functions on small tables, with the traps of their semantics."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import evaluation, merging, monitoring, ranking, recommendation, similarity
from granary.plans import matching, shelf


def test_best_of_equal_rows_is_the_first(spark):
    df = spark.createDataFrame([("a", 2, 5), ("a", 1, 5), ("a", 3, 4), ("b", 9, 1)], "k string, pos int, rich int").repartition(3)
    assert {(r["k"], r["pos"]) for r in merging.richest(df, ["k"], "rich", "pos").collect()} == {("a", 1), ("b", 9)}
    assert {(r["k"], r["pos"]) for r in merging.last_wins(df, ["k"], "pos").collect()} == {("a", 3), ("b", 9)}


def test_sources_merge_field_by_field(spark):
    rows = [("k", 1, "", ["x"], ["s1"], {"a": "1", "b": "1"}), ("k", 2, "t2", ["y", "z"], ["s2"], {"a": "2"}), ("k", 3, "t3", ["p", "q"], ["s1", "s3"], {"a": "3", "c": "3", "d": "3"})]
    df = spark.createDataFrame(rows, "key string, rank int, title string, steps array<string>, sources array<string>, n map<string, string>").repartition(3)
    got = merging.merge_sources(df, "key", "rank", ["title"], ["steps"], ["sources"], ["n"]).first()
    assert got["title"] == "t2" and got["steps"] == ["y", "z"] and got["sources"] == ["s1", "s2", "s3"]
    assert got["n"] == {"a": "3", "b": "1", "c": "3", "d": "3"}


def test_quota_equals_the_greedy_walk(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), round(rng.random(), 2)) for i in range(60)]
    got = [r["i"] for r in ranking.quota_top(spark.createDataFrame(rows, "i int, g string, s double"), "g", 12, 3, F.desc("s"), F.col("i")).collect()]
    order, taken, rest, used = sorted(rows, key=lambda r: (-r[2], r[0])), [], [], {}
    for r in order:
        if used.get(r[1], 0) < 3:
            used[r[1]] = used.get(r[1], 0) + 1
            taken.append(r)
        else:
            rest.append(r)
    assert set(got) == {r[0] for r in (taken + rest)[:12]}


def test_numbers_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    got = ranking.numbered(df, "n", F.col("v")).collect()
    assert all(r["n"] == r["v"] + 1 for r in got)


def test_numbers_of_a_million_wide_rows_are_gapless(spark):
    df = spark.range(0, 1_000_000, 1, 16).select(F.xxhash64("id").alias("v"), F.col("id").cast("string").alias("w"), F.array("id").alias("x"), F.struct("id").alias("_at"))
    got = ranking.numbered(df, "n", F.col("v")).agg(F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("w")).first()
    assert tuple(got) == (1_000_000, 1, 1_000_000, 1_000_000)
    low = ranking.numbered(df, "n", F.col("v")).where("n in (500000, 500001)").orderBy("n").select("v").collect()
    assert low[0][0] < low[1][0]


def test_numbers_of_no_rows(spark):
    assert ranking.numbered(spark.createDataFrame([], "v int, w string"), "n", F.col("v")).count() == 0


def test_repeated_owned_ids_count_once(spark):
    bridge = spark.createDataFrame([(1, 1), (1, 2)], "recipe_id long, ingredient_id long")
    ingr = spark.createDataFrame([(1,), (2,)], "ingredient_id long")
    owned = spark.createDataFrame([(1,), (1,)], "ingredient_id long")
    got = recommendation.match_rates(bridge, ingr, owned).first()
    assert (got["total"], got["matched"], got["match_rate"]) == (2, 1, 0.5)


def test_steps_and_lists(spark):
    row = spark.createDataFrame([(["1. 썰기", " ", "2) 볶기"], "①씻고 ②썬다", "양파(국산) 1개, 돼지고기 200g, 소금", "그냥 하나")], "s array<string>, c string, l string, o string").select(
        merging.dense_steps(F.col("s")).alias("s"), merging.circled_steps(F.col("c")).alias("c"), merging.listed_names(F.col("l")).alias("l"), merging.circled_steps(F.col("o")).alias("o")
    ).first()
    assert [(x["step"], x["description"]) for x in row["s"]] == [(1, "썰기"), (2, "볶기")]
    assert [x["description"] for x in row["c"]] == ["씻고", "썬다"] and len(row["o"]) == 1
    assert row["l"] == ["양파", "돼지고기", "소금"]


def test_ratio_is_not_symmetric():
    for a, b in (("tide", "diet"), ("diet", "tide"), ("우유", "저지방우유")):
        assert similarity.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
    assert similarity.score("우유", "저지방우유") == 0.9 and similarity.ratio("abc", "xyz", 0.5) == 0.0


def test_large_dimension_goes_in_parts(spark, monkeypatch):
    names = spark.createDataFrame([("apple",), ("pear",), ("",)], "name string")
    dim = spark.createDataFrame([(i, n) for i, n in enumerate(["apples", "pears", "peach", "apple", "grape", "pear"])], "pos long, name string")
    whole = {r["name"]: [(m["pos"], m["score"]) for m in r["matches"]] for r in similarity.ranked(names, dim, 2, 0.3).collect()}
    monkeypatch.setattr(similarity, "PART", 2)
    parts = {r["name"]: [(m["pos"], m["score"]) for m in r["matches"]] for r in similarity.ranked(names, dim, 2, 0.3).collect()}
    assert whole == parts and whole["apple"][0] == (3, 1.0) and whole[""] == []


def test_tiers_prefer_containment_to_similarity(spark):
    dim = spark.createDataFrame([(0, "돼지고기목살"), (1, "목살"), (2, "삼겹살")], "pos long, name string")
    got = {r["name"]: (r["pos"], r["phase"]) for r in similarity.tiers(spark.createDataFrame([("목살",), ("고기목살",), ("삼겹",), ("삼결살",), ("",)], "name string"), dim, 0.5).collect()}
    assert got == {"목살": (1, 0), "고기목살": (0, 1), "삼겹": (2, 1), "삼결살": (2, 2), "": (0, 1)}


def test_whole_passages_are_found(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "xone two three four five sixy"), (3, "short bit here"), (4, None)], "d int, text string")
    passages = spark.createDataFrame([(1, "one two three four five six"), (2, "short bit"), (3, "")], "p int, passage string")
    got = {(r["d"], r["p"]) for r in similarity.first_contained(docs, "text", passages, "passage").collect()}
    assert got == {(1, 1), (2, 1), (3, 2)}


RULES = matching.Rules(non_items=[("discount", ["에누리"], []), ("packaging", [], [r"^\s*\*?종량\d+[A-Z]?$"])], aliases=[("테스트오타", "테스트표준"), ("투썸딸기피지", "투썸딸기피치")], mappings=[("호가든캔330ml", "맥주"), ("없는상품", "없는재료")])


def test_products_find_their_ingredients(spark):
    ingredients = spark.createDataFrame([(0, "i0", "맥주", "음료"), (1, "i1", "두부", "콩"), (2, "i2", "돼지고기", "육류"), (3, "i3", "국산두부", "콩")], "pos long, ingredientId string, ingredientName string, category string")
    products = spark.createDataFrame([(p,) for p in ("호가든캔330ML", "두부", "부침 두부", "가공에누리 -2,500", "초코 쿠키", "zzz", "abc테스트오타xyz", "돼지고가")], "product_name string")
    got = {r["product_name"]: r for r in matching.predict(products, ingredients, RULES).collect()}
    assert (got["호가든캔330ML"]["ingredientName"], got["호가든캔330ML"]["mapping_source"], got["호가든캔330ML"]["similarity"]) == ("맥주", "receipt_rule_product_mapping", 1.0)
    assert (got["두부"]["ingredientId"], got["두부"]["mapping_source"]) == ("i1", "normalized_exact_match")
    assert (got["부침 두부"]["ingredientId"], got["부침 두부"]["similarity"], got["부침 두부"]["mapping_source"]) == ("i1", 0.9, "fuzzy_similarity")
    assert got["가공에누리 -2,500"]["mapping_status"] == "EXCLUDED" and got["가공에누리 -2,500"]["suggestions"] == []
    assert got["초코 쿠키"]["item_type"] == "SNACK" and got["zzz"]["mapping_status"] == "UNMAPPED"
    assert got["abc테스트오타xyz"]["standard_product_name"] == "abc테스트표준xyz"
    assert got["돼지고가"]["ingredientName"] == "돼지고기" and got["돼지고가"]["item_type"] == "INGREDIENT"


def test_mining_routes_items(spark):
    items = spark.createDataFrame([(1, "f1", "투썸알밀크티", "투썸로얄밀크티", 0.9, "a"), (2, "f1", "아몬드빼빼로", None, None, ""), (3, "f2", "호가든캔330ml", "호가든캔330ml", 0.8, "b"), (4, "f3", "호가든캔330ml", "", 0.6, "b")], "pos int, file_name string, raw_name string, normalized_name string, confidence double, parse_pattern string")
    matches = spark.createDataFrame([("호가든캔330ml", "맥주", "fuzzy_similarity", 0.72), ("투썸로얄밀크티", "투썸로얄밀크티", "normalized_exact_match", 1.0)], "product_name string, ingredientName string, mapping_source string, similarity double")
    got = {(r["kind"], r["key"]): r for r in matching.mining_groups(items, matches, F.col("product") == "").collect()}
    assert set(got) == {("alias", "투썸알밀크티"), ("unmapped", "아몬드빼빼로"), ("weak", "호가든캔330ml")}
    weak = got["weak", "호가든캔330ml"]
    assert (weak["other"], weak["count"], weak["avg_confidence"], weak["sample_files"], weak["patterns"]) == ("맥주", 2, 0.7, ["f2", "f3"], ["b:2"])
    assert got["unmapped", "아몬드빼빼로"]["avg_confidence"] is None


@pytest.mark.parametrize("text, amount, unit", [("1/2개", 0.5, "개"), ("200g", 200.0, "g"), ("½컵", 0.5, "컵"), ("약간", 0.0, "약간"), ("", 0.0, "")])
def test_amounts(spark, text, amount, unit):
    got = spark.range(1).select(X.amount_and_unit(F.lit(text)).alias("p")).first()["p"]
    assert (got["amount"], got["unit"]) == (amount, unit)


def test_numbers_and_dates(spark):
    row = spark.range(1).select(X.last_number(F.lit("2 1.234.567")).alias("a"), X.number(F.lit("1_000")).alias("b"), X.number(F.lit("1.0f")).alias("c"), X.number(F.lit("1,200.5")).alias("d"), X.iso_date(F.lit("24"), F.lit("2"), F.lit("31")).alias("e"), X.iso_date(F.lit("2024"), F.lit("13"), F.lit("1")).alias("f")).first()
    assert tuple(row) == (1234567.0, None, None, 1200.5, "2024-02-31", None)


def test_rules_in_order(spark):
    df = spark.createDataFrame([("돼지고기 국",), ("café",)], "t string")
    assert [r[0] for r in df.select(X.first_match(F.col("t"), [("국", "a"), ("돼지", "b")], "z")).collect()] == ["a", "z"]
    assert df.select(similarity.normalized(F.col("t"))).collect()[1][0] == "café"
    words = [("돼지", "p"), ("돼지고기", "q"), ("고기 국", "r")]
    assert df.select(X.longest_keyword(F.col("t"), words, None)).first()[0] == "q"


def test_shelf_life_quirks(spark):
    rows = [("바나나", "냉장", None), ("계란 30구", "냉장", None), ("계란", "냉동", None), ("무언가", "냉동", "유제품"), ("무언가", "상온", "없음"), ("김치만두", "냉동", None)]
    df = spark.createDataFrame(rows, "item_name string, storage_method string, category string").withColumn("purchase_date", F.lit("2024-01-01"))
    now = F.lit("2024-01-04 12:00:00").cast("timestamp")
    got = {r["item_name"] + r["storage_method"]: r for r in shelf.expiry(df, now).collect()}
    assert {k: r["shelf_days"] for k, r in got.items()} == {"바나나냉장": 7, "계란 30구냉장": 21, "계란냉동": 21, "무언가냉동": 30, "무언가상온": 7, "김치만두냉동": 90}
    same_day = shelf.expiry(spark.createDataFrame([("시금치", "냉장", None, "2024-01-01")], "item_name string, storage_method string, category string, purchase_date string"), now).first()
    assert same_day["d_day"] == -1 and same_day["risk"] == "expired"
    bad = shelf.expiry(spark.createDataFrame([("쌀", "상온", None, "nonsense")], "item_name string, storage_method string, category string, purchase_date string"), now).first()
    assert bad["d_day"] == 179


def test_inventory_risk(spark):
    rows = [("2024-01-10",), ("2024-01-05",), ("2024-01-04",), ("2024-01-03",), ("2024-01-02",)]
    df = spark.createDataFrame(rows, "purchased_at string").withColumns({"category": F.lit("dairy"), "storage_type": F.lit("refrigerated")})
    got = [(r["risk_level"], r["is_expired"], r["cta"]) for r in shelf.inventory_risk(df, F.lit("2024-01-10").cast("date")).orderBy(F.desc("purchased_at")).collect()]
    assert got == [("safe", False, "보관"), ("consume_soon", False, "오늘 소비"), ("share_now", False, "나눔 등록 권장"), ("urgent", False, "오늘 소비 우선"), ("urgent", True, "폐기 검토")]


def test_sharing(spark):
    df = spark.createDataFrame([("국수",), ("수제 쿠키",), ("쌀 10kg",), ("통조림 참치",), ("개봉우유",)], "n string")
    got = {r["n"]: (r["status"], r["category"]) for r in shelf.sharing_status(df, "n").collect()}
    assert got["국수"] == ("blocked", "개봉 반찬/조리 음식") and got["통조림 참치"][0] == "blocked" and got["수제 쿠키"] == ("review_required", None) and got["쌀 10kg"] == ("allowed", None) and got["개봉우유"] == ("blocked", "유제품(개봉)")
    assert tuple(shelf.sharing_counts(shelf.sharing_status(df, "n")).first()) == (5, 3, 1, 1)


def test_p95_is_by_position(spark):
    df = spark.createDataFrame([("e", float(i)) for i in range(1, 21)], "k string, v double")
    assert monitoring.ranked_value(df, ["k"], "v", 0.95, "p").first()["p"] == 20.0
    assert df.groupBy("k").agg(monitoring.nearest_rank(F.collect_list("v"), 0.95).alias("p")).first()["p"] == 20.0
    assert [monitoring.seconds(w) for w in ("30s", "5m", "1h", "7d", "d", "x")] == [30, 300, 3600, 604800, 86400, 3600]


def test_weights_and_composite(spark):
    ingr = spark.createDataFrame([(1, "정육", False), (2, "채소", False), (3, "소스", True)], "ingredient_id int, category string, staple boolean")
    bridge = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 3), (2, 2)], "recipe_id int, ingredient_id int")
    freq = recommendation.frequencies(bridge)
    assert {r["ingredient_id"]: r["frequency"] for r in freq.collect()} == {1: 2, 2: 2, 3: 1}
    w = recommendation.weights(ingr, freq, 2, {"정육": 3.0, "채소": 2.0}, {"정육", "채소"})
    assert {r["ingredient_id"]: r["weight"] for r in w.collect()} == {1: 1.5, 2: 1.0, 3: 0.3}
    owned = spark.createDataFrame([(2,)], "ingredient_id int")
    got = {r["recipe_id"]: r for r in recommendation.composite(bridge, w, owned).collect()}
    assert got[2]["score"] == 1.0 and got[1]["weighted_rate"] == round(1 / 2.8, 4) and got[1]["core_coverage"] == 0.5
    subs = spark.createDataFrame([(1, 0.6)], "ingredient_id int, credit double")
    assert recommendation.composite(bridge, w, owned, subs).where("recipe_id = 1").first()["weighted_rate"] == round(1.9 / 2.8, 4)
    assert recommendation.weights(ingr, freq, 1, {}, set()).where("ingredient_id = 1").first()["weight"] == 1.5


def test_urgency(spark):
    bridge = spark.createDataFrame([(1, "우유"), (1, "계란"), (1, "버터")], "recipe_id int, ingredient_id string")
    stock = spark.createDataFrame([("우유", "urgent", False), ("계란", "safe", False), ("버터", "safe", True)], "ingredient_id string, risk_level string, is_expired boolean")
    assert recommendation.urgency_scores(bridge, stock).first()["score"] == 4.75


@pytest.mark.parametrize("expected, actual, counts", [([["a"], ["b"]], [["a"], ["c"]], (1, 1, 1, 0.5)), ([["x"], ["y"]], [["x", "n"], ["y", "m"]], (2, 0, 0, 1.0)), ([["s"], ["s"]], [["s"]], (1, 0, 1, 0.6667)), ([["a"]], [], (0, 0, 1, 0.0))])
def test_f1(spark, expected, actual, counts):
    make = lambda rows: spark.createDataFrame([("f", i, n) for i, n in enumerate(rows)], "file string, pos int, names array<string>")
    got = evaluation.greedy_f1(make(expected), make(actual), "file", "pos", "names").first()
    assert (got["tp"], got["fp"], got["fn"], got["f1"]) == counts


def test_char_accuracy(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("", ""), ("", "x"), ("a", "zzzz")], "r string, h string")
    assert [r[0] for r in df.select(similarity.char_accuracy(F.col("r"), F.col("h"))).collect()] == [0.75, 1.0, 0.0, 0.0]
