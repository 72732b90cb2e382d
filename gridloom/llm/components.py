"""Connected components of a graph of links, in rounds of joins.

Each round lets every node point its larger neighbours, then its smaller ones, at its smallest neighbour ("large star, small
star"). Links shrink to stars around the smallest node of each component in a number of rounds that grows with the logarithm of
the size. Nothing but a count goes to the driver; hubs are aggregated partially before shuffling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, forget


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links u, v: pairs in both directions for a large star, u > v for a small one."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("m", "u"))
    joined = links.join(least, "u")
    moved = (joined.where("v > u") if large else joined).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if large:
        return moved.distinct()
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u > v").distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether each u has one v only, and no v is a u. As u > v, each v is then the smallest of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return seen.where("out > 1 or (out = 1 and least = 0)").count() == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for each node that has a link. Links from a node to itself and nulls don't count."""
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        before, edges = edges, cut(_star(_star(both, True), False))
        forget(before)
        if _only_stars(edges):
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
