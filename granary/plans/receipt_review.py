"""What comes after a receipt is parsed: which items to review, proposals merged into them, reasons checked anew, the end result.

Items are rows (receipt_id, item_idx, and the fields of `receipts.flat_items`); proposals come from any provider, or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import receipt_values as V

#: How urgent each reason is, and how many items of a receipt are asked about.
URGENCY = {"missing_amount": 200, "missing_quantity_or_unit": 180, "low_confidence": 70}
SUSPICIOUS_UNKNOWN, ASKED = 40, 4


def suspicious(name: Column) -> Column:
    """Whether a name looks misread: two characters at most, brackets or bars in it, or an ending that stands for one."""
    t = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(F.regexp_replace(t, r"(?U)\s+", "")) <= 2) | t.rlike(r"[\[\]{}|]") | t.rlike(r"[LI\]]$")


def plausible(raw: Column, name: Column) -> Column:
    """Whether a proposed name may stand for a raw one: no underscore, and Hangul if the raw one has any."""
    return ~F.contains(name, F.lit("_")) & (~raw.rlike("[가-힣]") | name.rlike("[가-힣]"))


def review_queue(items: DataFrame) -> DataFrame:
    """Up to ASKED items of each receipt to ask about, with priority; the most urgent first, earlier items on a tie."""
    has = lambda r: F.array_contains("review_reason", r)
    odd = has("unknown_item") & suspicious(F.col("raw_name"))
    points = sum((F.when(has(r), p).otherwise(0) for r, p in URGENCY.items()), F.when(odd, SUSPICIOUS_UNKNOWN).otherwise(0))
    due = items.where(F.col("needs_review")).withColumn("priority", points).where("priority > 0")
    return due.withColumn("place", F.row_number().over(W.partitionBy("receipt_id").orderBy(F.desc("priority"), "item_idx"))).where(F.col("place") <= ASKED)


def context(items: DataFrame, lines: DataFrame) -> DataFrame:
    """receipt_id, item_idx and context: the texts from a line before an item's first line to one after its last, each once.

    lines: receipt_id, line_id, text. Blank texts are left out, and so are items whose lines aren't there.
    """
    placed = lines.withColumn("at", F.row_number().over(W.partitionBy("receipt_id").orderBy("line_id")))
    own = items.select("receipt_id", "item_idx", F.explode("source_line_ids").alias("line_id")).join(placed.select("receipt_id", "line_id", "at"), ["receipt_id", "line_id"])
    span = own.groupBy("receipt_id", "item_idx").agg((F.min("at") - 1).alias("lo"), (F.max("at") + 1).alias("hi"))
    near = span.join(placed.select("receipt_id", "at", F.trim("text").alias("text")), "receipt_id").where(F.col("at").between(F.col("lo"), F.col("hi")) & (F.col("text") != ""))
    texts = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]))
    return near.groupBy("receipt_id", "item_idx").agg(texts.alias("context"))


def rechecked(items: DataFrame, purchased_at: str = "purchased_at") -> DataFrame:
    """items with review_reason as their fields stand: reasons that no longer hold go, new ones are added at the end."""
    holds = [("missing_purchased_at", F.col(purchased_at).isNull()), ("unknown_item", F.col("normalized_name").isNull()), ("missing_quantity_or_unit", F.col("quantity").isNull() | F.col("unit").isNull()), ("missing_amount", F.col("amount").isNull())]
    reasons = F.col("review_reason")
    for name, on in holds:
        reasons = F.when(on, F.when(F.array_contains(reasons, name), reasons).otherwise(F.array_append(reasons, F.lit(name)))).otherwise(F.array_remove(reasons, name))
    return items.withColumn("review_reason", reasons).withColumn("needs_review", F.size("review_reason") > 0)


def with_proposals(items: DataFrame, proposals: DataFrame) -> DataFrame:
    """items with what proposals (receipt_id, item_idx, normalized_name, quantity, unit, amount as text or null) may fill in.

    Quantity, unit and amount are filled where they are missing. A plausible name replaces none, or a different one of
    an item in doubt. An item that took anything is no longer of low confidence. Reasons are checked anew.
    """
    p = proposals.select("receipt_id", "item_idx", F.nullif(F.trim("normalized_name"), F.lit("")).alias("p_name"), X.number(F.col("quantity")).alias("p_q"), F.nullif(F.trim("unit"), F.lit("")).alias("p_unit"), X.number(F.col("amount")).alias("p_amount"), F.lit(True).alias("asked"))
    met = items.join(p, ["receipt_id", "item_idx"], "left")
    doubt = F.arrays_overlap("review_reason", F.array(F.lit("low_confidence"), F.lit("unknown_item")))
    rename = F.coalesce(plausible(F.col("raw_name"), F.col("p_name")) & (F.col("normalized_name").isNull() | ((F.col("normalized_name") != F.col("p_name")) & doubt)), F.lit(False))
    fills = {"quantity": "p_q", "unit": "p_unit", "amount": "p_amount"}
    took = rename
    for c, x in fills.items():
        took = took | (F.col(c).isNull() & F.col(x).isNotNull())
    changed = met.withColumn("took", took).withColumns({"normalized_name": F.when(rename, F.col("p_name")).otherwise(F.col("normalized_name")), **{c: F.coalesce(c, x) for c, x in fills.items()}, "review_reason": F.when(took, F.array_remove("review_reason", "low_confidence")).otherwise(F.col("review_reason"))})
    checked = rechecked(changed)
    return changed.where("asked is null").select(*items.columns).unionByName(checked.where("asked").select(*items.columns))


def with_header(receipts: DataFrame, proposals: DataFrame) -> DataFrame:
    """receipts whose missing vendor or date is filled from proposals (receipt_id, vendor_name, purchased_at), if plausible."""
    vendor = F.trim("p_vendor")
    good = (F.length(F.regexp_replace(vendor, r"(?U)\s+", "")) >= 2) & ~vendor.rlike("|".join(V.VENDOR_BLOCK)) & ~vendor.rlike(r"^[\d,.\s]+$")
    met = receipts.join(proposals.select("receipt_id", F.col("vendor_name").alias("p_vendor"), F.col("purchased_at").alias("p_date")), "receipt_id", "left")
    return met.withColumns({"vendor_name": F.coalesce("vendor_name", F.when(good, vendor)), "purchased_at": F.coalesce("purchased_at", X.find_date(F.col("p_date"), list(V.DATES)))}).drop("p_vendor", "p_date")


def finished(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """receipts with reasons, need for review, open items and confidence as the final items and image quality make them.

    receipts: receipt_id, purchased_at, totals, review_reasons, confidence, quality_score, low_quality_reasons.
    """
    sums = items.groupBy("receipt_id").agg(F.sum("amount").alias("spent"), F.count_if("needs_review").cast("int").alias("open"))
    met = receipts.drop("unresolved_groups").join(sums, "receipt_id", "left").withColumn("open", F.coalesce("open", F.lit(0)))
    known = F.coalesce(F.nullif(F.try_element_at("totals", F.lit("payment_amount")), F.lit(0.0)), F.try_element_at("totals", F.lit("total")))
    kept = F.array_except("review_reasons", F.array(*[F.lit(r) for r in ("missing_purchased_at", "unresolved_items", "total_mismatch")]))
    maybe = lambda name, on: F.when(on, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    off = F.coalesce((F.col("spent") > 0) & (F.abs(known - F.col("spent")) > V.TOTAL_TOLERANCE), F.lit(False))
    quality = F.coalesce("low_quality_reasons", F.array().cast("array<string>"))
    reasons = F.array_distinct(F.concat(kept, maybe("missing_purchased_at", F.col("purchased_at").isNull()), maybe("unresolved_items", F.col("open") > 0), quality, maybe("total_mismatch", off)))
    done = met.withColumns({"review_reasons": reasons, "confidence": F.round(0.7 * F.col("confidence") + 0.3 * F.coalesce("quality_score", F.lit(1.0)), 4)})
    return done.withColumn("review_required", F.size("review_reasons") > 0).withColumnRenamed("open", "unresolved_groups").drop("spent")
