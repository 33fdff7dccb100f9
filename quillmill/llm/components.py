"""Connected components of a graph held as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import saved


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the smallest of u and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """u and its neighbours below are linked to the smallest of those."""
    least = links.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    below = links.join(least, F.col("u") == F.col("c"))
    moved = below.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    links has two long columns. Alternates large-star and small-star, which ends
    after about log(n) rounds with stars around the smallest nodes. Every round is
    cut by a checkpoint; only a count and a checksum come to the driver.
    """
    u, v = links.columns
    now = saved(links.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == mark or not seen["n"]:
            break
        mark = (seen["n"], seen["s"])
        now = saved(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
