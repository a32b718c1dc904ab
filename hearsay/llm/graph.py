"""Connected components by alternating star contraction, every round a distributed join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import remove, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    edges: (u, v) of longs, in any direction, loops and repeats allowed; rows with a null are ignored.
    Returns (node, component). No edges: no rows. Groups are contracted by per-key minima joined back to
    the edges, so a node with very many neighbours is combined before its shuffle and its join can be split.
    """
    spark = edges.sparkSession
    start = edges.where("u is not null and v is not null and u <> v")
    now, path = written(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    old = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == old or not sums[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        old = sums
        after, new_path = written(_small_star(_large_star(now)), "edges")
        remove(spark, path)
        now, path = after, new_path
