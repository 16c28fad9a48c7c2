"""Connected components of a graph of links, by alternating large-star and small-star rounds.

A round is two groupings that pre-aggregate and two joins; every round's edges are written, so a lost
executor costs no earlier round. A node with very many links (the centre of a star) is a skewed join
key, which Spark splits. Only a count and a checksum of the edges come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (longs, any order, repeats and loops allowed). id and component (its least
    node) of every node with a link to another."""
    a, b = F.col("a"), F.col("b")
    edges = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(a != b).distinct())
    seen = None
    while (now := _mark(edges)) != seen:
        seen = now
        edges = written(_small_star(_large_star(edges)))
    stars = edges.select(a.alias("id"), b.alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component")).distinct()


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()
