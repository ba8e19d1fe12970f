"""Connected components of an edge table, by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is a grouped minimum
(combined before the shuffle) and a join, and its edges are written to the shared folder. Nodes with more than
``HOT`` neighbours get their minimum by a broadcast, so their neighbours stay where they are; such nodes are at most
a ``HOT``-th of the edges' ends, and where that many may be too many to broadcast, Spark chooses the join. No other node's neighbours are more than ``HOT`` rows of one task. The driver sees one count and
checksum for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, staged


#: Neighbours up to which a node's edges may meet in one task.
HOT = 50_000


def _with_least(rows: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """``rows`` (a, b), no more than ``count``, with ``m`` of their node ``a``; ``least`` has a, m and the node's number of rows, ``n``."""
    hot = small(least.where(F.col("n") > HOT).select("a", F.col("m").alias("hot")), count // HOT)
    tried = rows.join(hot, "a", "left")
    cold = tried.where("hot is null").join(least.where(F.col("n") <= HOT).select("a", "m"), "a").select("a", "b", "m")
    return cold.union(tried.where("hot is not null").select("a", "b", F.col("hot").alias("m")))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Each larger neighbour of a node is joined to the node's least neighbour, or to the node itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.where("b > a"), least, 2 * count).select(F.col("b").alias("x"), F.col("m").alias("y"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are joined to the least of them."""
    down = edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(down, least, count).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for every node of an edge (columns a, b) but the
    least ones of their components. Loops and repeated edges do no harm; an error if ``rounds`` don't suffice."""
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
        now = staged(_small_star(_large_star(now, state[0]), state[0]).distinct())
    raise RuntimeError(f"components still change after {rounds} rounds")
