"""Connected components of an edge table, in Spark, by alternating stars.

Each round hangs every node's larger neighbours, then its smaller ones, on the
smallest node that it sees, until nothing changes.  Rounds grow with the
logarithm of the longest chain, and each is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import materialise


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang the neighbours of each node (all larger ones, or all smaller ones and itself) on the smallest."""
    up = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        sides = up.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = sides.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        sides = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = sides.groupBy("u").agg(F.min("v").alias("m"))
        moved = sides.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.where("a < b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge table (a, b) of longs; the root is the component's smallest node."""
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    mark = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(now) or not now[0]:
            break
        mark = tuple(now)
        edges = materialise(_star(_star(edges, True), False))
    else:
        raise RuntimeError("the components have not settled")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
