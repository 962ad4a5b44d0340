"""Connected components of an edge list, by alternating large-star and small-star rounds.

Edges stay distributed; each round is two aggregations with map-side partial minima, and the only value the driver sees is a count.
Each round is written as Parquet, so a lost executor costs one round at most. A checkpoint would do for that, but it carries Spark's size
estimates on, which joins multiply: their digits grow fourfold in a round, and the driver's memory with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def fresh_key(key: str) -> Column:
    """The same value by an expression that hides its partitioning, so that a join deals both sides anew and AQE can split a hot key."""
    return F.bitwise_not(F.bitwise_not(F.col(key))).alias(key)


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least.select(fresh_key("a"), "m"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least.select(fresh_key("a"), "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) to (node, root): root is the least node reachable. Nodes that no edge names have no row.

    Self-links, repeated edges and both directions are allowed; null ends are dropped; no edges give no rows."""
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        now = stored(_small_star(_large_star(now)).filter("a <> b").distinct())
        # A set of edges that a round leaves as it is has the same count and the same sums of hashes.
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
