"""The first receipt engine, file sources and streams."""

import json

from pyspark.sql import functions as F

from granary.plans import receipts_v1 as V
from granary.plans import shelf
from granary.sources import files
from granary.streaming import monitor

KEYWORDS = [("양파", "농산물/채소"), ("파", "농산물/채소"), ("대파", "농산물/채소"), ("삼겹살", "축산물/돼지고기"), ("쌀", "곡류"), ("두부", "두부·콩류")]


def lines(spark, *texts):
    return spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "receipt_id string, line_idx int, text string")


def test_prices_by_look_ahead(spark):
    df = lines(spark, "행복마트", "2024-03-05", "양파", "8801234567890", "3,980", "대파 2,500", "쌀 2 x 1,500", "삼겹", "국산두부 300g 1,200원", "비닐봉투 50", "양 파", None)
    got = {r["product_name"]: r["amount_krw"] for r in V.items(df, KEYWORDS).collect()}
    assert got == {"양파": 3980, "대파": 2500, "삼겹살": None, "국산두부": 1200}


def test_types_and_corrections(spark):
    df = lines(spark, "=====", "8801234567890", "1,200 #", "합계 2024-01-02", "합계 100", "2024.1.2", "양파", "12", "abc")
    assert [r[0] for r in df.select(V.line_type(F.col("text"))).collect()] == ["separator", "barcode", "price", "date", "header", "date", "product", "price", "unknown"]
    fixed = lines(spark, "깨잎", "밀까루", "깨입배츄", "부채쌀").select(V.corrected(F.col("text"), [("깨잎", "깻잎"), ("깨입", "깻잎")])).collect()
    assert [r[0] for r in fixed] == ["깻잎", "밀가루", "깻잎배츄", "부채살"]


def test_head_and_old_engine(spark):
    df = lines(spark, "(주)하나로마트", "20240305", "대표: 홍길동", "01 양파 1.5kg", "양파", "미지의것")
    assert tuple(V.head(df).first()) == ("r", "하나로마트", "2024-03-05")
    labels = spark.createDataFrame([("미지",)], "name string")
    got = {(r["product_name"], r["category_major"]) for r in V.old_items(df, KEYWORDS, labels).collect()}
    assert ("미지의것", "미분류 식품") in got and ("대표: 홍길동", "기타") not in got


def test_rule_files(spark, tmp_path):
    (tmp_path / "non_item_exclusions.json").write_text(json.dumps({"categories": {"bag": {"contains": ["봉투"]}}}), "utf-8")
    (tmp_path / "product_aliases.json").write_text(json.dumps({"aliases": [{"source": "가", "target": "나"}, {"raw": "다", "standard": "라"}]}), "utf-8")
    assert files.read_rules(spark, str(tmp_path)) == ([("bag", ["봉투"], [])], [("가", "나"), ("다", "라")], [])


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("양파", None), ("대파", "x")], "a string, b string")
    for _ in range(2):
        files.append_csv(df, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "a string, b string").count() == 4
    (tmp_path / "k.csv").write_bytes("이름,양\n양파,1개\n".encode("euc-kr"))
    assert files.read_csv_sniffed(spark, str(tmp_path / "k.csv")).first()["row"] == {"이름": "양파", "양": "1개"}
    assert files.read_json_or_empty(spark, str(tmp_path / "none"), "a string").count() == 0
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "one.json").write_text(json.dumps([{"name": "양파"}, {"name": "x"}]), "utf-8")
    assert [tuple(r) for r in files.label_files(spark, str(tmp_path / "labels")).select("source", "name").collect()] == [("one", "양파")]
    for n in ("b.JPG", "a.png", "a_items-crop.png", "c.txt"):
        (tmp_path / n).write_bytes(b"1")
    assert [r["name"] for r in files.image_files(spark, str(tmp_path / "*.*")).collect()][:2] == ["a.png", "b.JPG"]
    assert [r[0] for r in spark.createDataFrame([("영수증 1.jpg",), ("가.png",)], "n string").select(files.safe_stem(F.col("n"))).collect()] == ["1", "receipt"]


def test_streams(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(minutes=m), "/a" if m % 2 else "/b", 500 if m == 3 else 200, 10.0 * m) for m in range(10)]
    spark.createDataFrame(rows, "ts timestamp, endpoint string, status_code int, elapsed_ms double").write.parquet(str(tmp_path / "log.parquet"))
    log = monitor.file_stream(spark, str(tmp_path), "log")
    got = monitor.run_to_end(monitor.windowed_metrics(log, "5 minutes", watermark="1 day"), "complete").collect()
    assert sum(r["n"] for r in got) == 10 and sum(r["errors"] for r in got) == 1 and len(got) == 4
    jobs = [(1, "pending", 0), (1, "running", 1), (1, "completed", 2), (2, "pending", 3), (1, "running", -5)]
    spark.createDataFrame(jobs, "trace_id long, status string, seq long").write.parquet(str(tmp_path / "jobs.parquet"))
    last = {r["trace_id"]: (r["status"], r["updates"]) for r in monitor.run_to_end(monitor.job_states(monitor.file_stream(spark, str(tmp_path), "jobs")), "update").collect()}
    assert last == {1: ("completed", 3), 2: ("pending", 0)}
    spark.createDataFrame([("시금치", "냉장", None, "2024-01-01"), ("쌀", "상온", None, "2024-01-01")], "item_name string, storage_method string, category string, purchase_date string").write.parquet(str(tmp_path / "stock.parquet"))
    due = monitor.run_to_end(monitor.alert_stream(monitor.file_stream(spark, str(tmp_path), "stock"), F.lit("2024-01-02").cast("timestamp")), "append")
    assert [r["item_name"] for r in due.collect()] == ["시금치"]
    assert shelf.alerts(spark.createDataFrame([("a", None)], "item_name string, d_day int")).count() == 0
