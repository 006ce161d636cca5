"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the smallest one around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    hung = both.join(least, "u").filter("v > u")
    return hung.select(F.col("v").alias("a"), F.least("u", "least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    hung = edges.join(least, "a").filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return hung.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` of every node in ``links`` (a, b); the root is the smallest node reachable.

    Each round is written to the shared folder.  The number of rounds grows with the
    logarithm of the longest path; the driver sees two numbers of each.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = scratch.keep(edges, "edges")
    mark = None
    while True:
        after = scratch.keep(_small_star(_large_star(edges)), "edges")
        scratch.drop(edges)
        edges = after
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
