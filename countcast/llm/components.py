"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countcast.workspace import stored


def _stars(edges: DataFrame) -> DataFrame:
    """Large star: every larger neighbour of a node is linked to the node's smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return both.where("b > a").join(least, "a").select(F.col("root").alias("a"), "b")


def _small_stars(edges: DataFrame) -> DataFrame:
    """Small star: every smaller neighbour of a node, and the node, are linked to the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    linked = down.join(least, "a")
    return linked.select(F.col("root").alias("a"), "b").unionByName(least.select(F.col("root").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b): root is the component's smallest.

    Rounds grow with the logarithm of the longest path; each ends in a stored table, so a lost
    executor costs one round. Partial aggregates and joins that split hot keys keep a node with
    very many neighbours from filling one task.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        large = _stars(edges).where("a <> b").distinct()
        small = stored(_small_stars(large).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        # a forest of stars: nothing that has a smaller neighbour has another one, or is one
        moved = small.exceptAll(edges).isEmpty() and small.count() == edges.count()
        edges = small
        if moved:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
