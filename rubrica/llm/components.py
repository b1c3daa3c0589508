"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step joins nothing larger than the edges and writes them to the shared folder. Minima are partly aggregated before
the shuffle, and the join that hands them back is one whose skewed partitions Spark splits, so a node with very
many links costs no more than its links. Ends in about log(longest path) rounds, as soon as the edges are stars around the least
nodes; edges that are (components found before, say) cost no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, staged

BROADCAST_ROWS = 500_000


def _star(both: DataFrame, large: bool) -> DataFrame:
    """both: u, v. Each u hands the least of its neighbours and itself to its neighbours (above it; or below it and itself)."""
    side = both if large else both.filter("v < u")
    least = side.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("m", "u").alias("m"))
    least = staged(least, "least")  # written, so that Spark can split a node's many links in the join
    handed = side.join(F.broadcast(least) if small(least, BROADCAST_ROWS) else least, "u")
    if large:
        return handed.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _is_done(now: DataFrame) -> bool:
    """Whether every u has one edge, to a node that is no u."""
    ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(now.select("v", F.lit(0), F.lit(1)))
    return small(ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up + root > 1"), 0)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """edges: pairs of longs. Returns node, component (the least node reachable) of every node with a link."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = staged(now, "links")
    for _ in range(rounds):
        if _is_done(now):
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # no distinct between the steps: the second one takes minima and has at most a row for each of the first one's
        now = _star(both, True).filter("u <> v")
        now = staged(_star(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False).filter("u <> v").distinct(), "links")
    else:
        if not _is_done(now):
            raise RuntimeError(f"components have not converged in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
