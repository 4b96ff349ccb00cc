"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a, b) reaches.

    Each round rewrites the links as stars around smaller ids and is written to the shared folder;
    only a count and a hash reach the driver. The rounds grow with the logarithm of a path's length.
    Hot nodes are aggregated before the shuffle and joined, never gathered.
    """
    now = save(edges.select("a", "b").dropna().filter("a <> b").distinct(), "links")
    before = _mark(now)
    while before[0]:
        now = save(_small_star(_large_star(now)), "links")
        after = _mark(now)
        if after == before:
            break
        before = after
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return stars.unionByName(roots)
