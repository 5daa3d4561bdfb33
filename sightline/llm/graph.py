"""Connected components by alternating large-star and small-star rounds.

Each round is a pair of min-aggregations and equi-joins over edges, so no node's neighbourhood is
gathered in one place: minima combine before the shuffle, and a hub's rows in a join are ordinary rows
that adaptive execution splits. The number of rounds grows with the logarithm of the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node moves to the least node of that neighbourhood."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``: the least node that each node can reach.

    Nodes without an edge to another node are absent. Null ends and loops are ignored; an empty input gives
    an empty output. Rounds go on until the edges no longer change; each is staged in the shared folder.
    """
    spark = edges.sparkSession
    now = staged(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.col("lo").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or tuple(seen) == mark:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
        mark = tuple(seen)
        following = staged(_small_star(_large_star(now)), "edges")
        discard(spark, now)
        now = following
