"""Review queue, proposals and the end result of receipts."""

from granary.plans import receipt_review as R

ITEMS = "receipt_id string, item_idx int, raw_name string, normalized_name string, quantity double, unit string, amount double, needs_review boolean, review_reason array<string>, source_line_ids array<int>, purchased_at string"


def items(spark):
    rows = [
        ("r", 0, "우유", "우유", 1.0, "개", 2000.0, False, [], [1], "2024-01-01"),
        ("r", 1, "오이L", None, 1.0, "개", 1000.0, True, ["low_confidence", "unknown_item"], [2, 3], "2024-01-01"),
        ("r", 2, "두부", "두부", None, None, None, True, ["missing_quantity_or_unit"], [5], "2024-01-01"),
        ("r", 3, "양파 한망", None, 1.0, "개", 500.0, True, ["unknown_item"], [6], "2024-01-01"),
    ]
    return spark.createDataFrame(rows, ITEMS)


def test_queue_and_context(spark):
    got = [(r["item_idx"], r["priority"]) for r in R.review_queue(items(spark)).orderBy("place").collect()]
    assert got == [(2, 180), (1, 110)]
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(["머리", "우유", "오이L", "1,000", "1,000", "두부", "양파"])], "receipt_id string, line_id int, text string")
    near = {r["item_idx"]: r["context"] for r in R.context(items(spark), lines).collect()}
    assert near[1] == ["우유", "오이L", "1,000"] and near[0] == ["머리", "우유", "오이L"] and near[3] == ["두부", "양파"]


def test_proposals_fill_gaps(spark):
    proposals = spark.createDataFrame([("r", 1, "오이", None, None, None), ("r", 2, "tofu_x", "2", "모", "1,500"), ("r", 0, "저지방우유", "9", None, "1")], "receipt_id string, item_idx int, normalized_name string, quantity string, unit string, amount string")
    got = {r["item_idx"]: r for r in R.with_proposals(items(spark), proposals).collect()}
    assert (got[1]["normalized_name"], got[1]["review_reason"], got[1]["needs_review"]) == ("오이", [], False)
    assert (got[2]["normalized_name"], got[2]["quantity"], got[2]["unit"], got[2]["amount"], got[2]["needs_review"]) == ("두부", 2.0, "모", 1500.0, False)
    assert (got[0]["normalized_name"], got[0]["amount"]) == ("우유", 2000.0) and got[3]["review_reason"] == ["unknown_item"]
    again = {r["item_idx"]: r["review_reason"] for r in R.rechecked(items(spark)).collect()}
    assert again[2] == ["missing_quantity_or_unit", "missing_amount"]


def test_end_result(spark):
    receipts = spark.createDataFrame([("r", None, None, {"total": 5000.0}, ["missing_purchased_at", "old"], 0.9, 0.5, ["blurry"])], "receipt_id string, vendor_name string, purchased_at string, totals map<string, double>, review_reasons array<string>, confidence double, quality_score double, low_quality_reasons array<string>")
    got = R.finished(receipts, items(spark)).first()
    assert got["review_reasons"] == ["old", "missing_purchased_at", "unresolved_items", "blurry", "total_mismatch"] and got["review_required"] and got["unresolved_groups"] == 3 and got["confidence"] == 0.78
    head = spark.createDataFrame([("r", "행복마트", "2024.01.05")], "receipt_id string, vendor_name string, purchased_at string")
    filled = R.with_header(receipts, head).first()
    assert (filled["vendor_name"], filled["purchased_at"]) == ("행복마트", "2024-01-05")
