"""Connected components of a table of links, by rounds of joins with written results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.staging import stage


def _to_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the least neighbour of ``a``, itself included, as ``low``.

    A group-by that combines map-side and a join, so that a node with very many edges is split.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return edges.join(low, "a")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b); the component is its smallest node.

    Alternates two steps until nothing moves: every larger neighbour of a node is linked to the
    node's least neighbour, then every smaller one is. Both keep what is connected and shorten
    paths, so the rounds grow with the logarithm of the longest path.
    """
    edges = stage(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = _to_least(large)
        small = least.select("a", F.col("low").alias("b")).union(
            least.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        after = stage(small.distinct(), "edges")
        # Done when every node points at a root: no second pointer of a node, no pointer from a target.
        inner = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        if inner.isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty():
            break
        edges = after
    roots = after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
