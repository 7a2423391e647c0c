"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Into how many parts the edges of one node are dealt, where some node has over HUB edges and a hundredth of all.
SPREAD, HUB = 64, 10_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _has_hubs(edges: DataFrame, total: int) -> bool:
    """Whether some node has an unfair share of the edges."""
    return not _both(edges).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > max(HUB, total // 100)).isEmpty()


def _with_least(edges: DataFrame, hubs: bool) -> DataFrame:
    """edges with m, the least of a and its neighbours. Where there are hubs, edges are dealt to SPREAD keys for each node."""
    if not hubs:
        return edges.join(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "a")
    salted = edges.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SPREAD)))
    parts = salted.groupBy("a", "s").agg(F.min("b").alias("low"))
    whole = parts.groupBy("a").agg(F.least(F.min("low"), F.col("a")).alias("m"))
    return salted.join(parts.select("a", "s").join(whole, "a"), ["a", "s"]).drop("s")


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame, hubs: bool) -> DataFrame:
    """Every neighbour above a node moves to the least of the node and its neighbours."""
    return _with_least(_both(edges), hubs).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame, hubs: bool) -> DataFrame:
    """Every neighbour below a node, and the node, move to the least of them."""
    moved = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), hubs)
    up = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return up.unionByName(moved.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of the edges (a, b). An empty table gives no rows.

    Each round is written to the shared folder, and the one before it removed. Nothing but two numbers a round reaches
    the driver; the edges of a node with very many are dealt to several tasks.
    """
    now = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    hubs = _has_hubs(now, state[0])
    while state[0]:
        before, now = now, common.stored(_small(_large(now, hubs), hubs).distinct())
        common.discard(before)
        if (after := _state(now)) == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
