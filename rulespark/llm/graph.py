"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm.common import drop_shared, shared_checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood (links may repeat)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node points to one node at most, and none that points is pointed to."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    degrees = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return degrees.where("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The component of every node that has an edge: (node, component), component the smallest node.

    ``edges`` has long columns ``u`` and ``v``; nulls, loops and repeats are
    ignored, an empty table gives an empty one.  Each round is written to the
    shared folder and the one before it deleted; the links are never collected.
    The rounds end when every edge points from a node to the root of a star,
    which takes about the logarithm of the longest chain.
    """
    now = shared_checkpoint(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        if _all_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        last, now = now, shared_checkpoint(_small_star(_large_star(now)))
        drop_shared(last)
    raise RuntimeError("the components did not settle")
