"""Connected components by alternating large and small stars, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the least of its neighbours and itself to its larger neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    far = both.where(F.col("v") > F.col("u")).join(least, "u")
    return far.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands the least of its smaller neighbours to the others and to itself."""
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    near = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u")
    pairs = near.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return pairs.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all linked nodes, for links (a, b) of longs; component is the
    least node that can be reached. The number of rounds grows with the logarithm of the
    longest path, and the driver sees only two sums a round."""
    spark = links.sparkSession
    edges = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, path = materialize(edges, "cc-links")
    seen = None
    while True:
        edges2, path2 = materialize(_small_star(_large_star(edges)), "cc-round")
        drop_table(spark, path)
        now = edges2.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        edges, path = edges2, path2
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
