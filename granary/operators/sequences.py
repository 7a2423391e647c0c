"""Ordered-sequence operators: look-ahead pairing, windows between marks, and anchored grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def look_ahead(df: DataFrame, group: str, pos: str, kind: str, value: str, wanted: str, stop: str, reach: int = 3) -> DataFrame:
    """df with found: the value of the first of the next `reach` rows of kind `wanted`, unless one of kind `stop` comes first."""
    w = W.partitionBy(group).orderBy(pos)
    out = F.lit(None)
    for k in range(reach, 0, -1):
        ahead = F.lead(kind, k).over(w)
        out = F.when(ahead == wanted, F.lead(value, k).over(w)).when(ahead == stop, F.lit(None)).otherwise(out)
    return df.withColumn("found", out)


def first_position(flag: Column, pos: str) -> Column:
    """An aggregate: the first position where the flag holds."""
    return F.min(F.when(flag, F.col(pos)))


def between_marks(df: DataFrame, group: str, pos: str, opens: Column, closes: Column) -> DataFrame:
    """df with block_start (after the first opening mark, else 0), block_end (first closing mark from there, else null) and inside."""
    starts = df.groupBy(group).agg(F.coalesce(first_position(opens, pos) + 1, F.lit(0)).alias("block_start"))
    marked = df.join(starts, group)
    ends = marked.groupBy(group).agg(first_position(closes & (F.col(pos) >= F.col("block_start")), pos).alias("block_end"))
    got = marked.join(ends, group)
    return got.withColumn("inside", (F.col(pos) >= F.col("block_start")) & (F.col("block_end").isNull() | (F.col(pos) < F.col("block_end"))))


def anchored_rows(tokens: Column, tolerance: float) -> Column:
    """A list of tokens (y, x, ...) as rows: sorted by y, a token joins the row while it is within `tolerance` of the row's first.

    Not a gap rule: the distance is to the row's first token, not to the one before. A row's tokens come out by x.
    """
    ordered = F.array_sort(F.transform(tokens, lambda t: F.struct(F.round(t["y"], 3).alias("ky"), F.round(t["x"], 3).alias("kx"), t.alias("t"))))
    one = F.transform(F.slice(ordered, 1, 0), lambda t: F.struct(t["t"]["y"].alias("anchor"), F.array(t["t"]).alias("own")))

    def join(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = last.isNotNull() & (F.abs(t["t"]["y"] - last["anchor"]) <= tolerance)
        grown = F.struct(last["anchor"].alias("anchor"), F.concat(last["own"], F.array(t["t"])).alias("own"))
        fresh = F.struct(t["t"]["y"].alias("anchor"), F.array(t["t"]).alias("own"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    rows = F.aggregate(ordered, one, join)
    return F.transform(rows, lambda r: F.struct(r["anchor"].alias("y"), F.array_sort(F.transform(r["own"], lambda t: F.struct(t["x"].alias("kx"), t.alias("t")))).alias("own")))
