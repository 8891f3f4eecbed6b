"""Connected components by alternating large-star and small-star steps.

Each step is two aggregates and two joins on node ids, so a hub's edges are pre-aggregated and can be split by adaptive skew
joins; edges are written to the shared folder after each round, which keeps lineage short and survives lost executors, and those of the
round before are let go. Edges that are stars already, as those of an earlier call are, take no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, written


def _uneven(edges: DataFrame) -> int:
    """How many nodes are no centre and no end of a star: they have two edges up, or one up and others down."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 0 AND n > 1").count()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)`` for each node with an edge; root is the smallest node that it reaches."""
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = written(cur, name)
    while _uneven(cur):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        was, cur = cur, written(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), name)
        let_go(was.sparkSession, was)
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
