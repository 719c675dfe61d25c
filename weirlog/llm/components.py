"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that links reach) of every node with a link.

    ``links`` has columns a and b; direction and repetition do not matter, links of
    a node with itself count for nothing. Alternates the large-star and small-star steps, each an
    aggregation with map-side combine and a join, until the links are stars around the
    smallest nodes. A node with very many links is a skewed join key, which adaptive
    execution splits.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, before = stored(pairs, "links"), None
    while (now := _fingerprint(stars)) != before:
        before = now
        stars = stored(_small_star(_large_star(stars)), "stars")
    roots = stars.select("v").distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )


def _fingerprint(stars: DataFrame) -> tuple:
    row = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(stars: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of the node and its neighbours."""
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("low"))
    linked = both.join(lowest, "u").where("v > u")
    return linked.select(F.col("v").alias("u"), F.least("low", "u").alias("v")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """A node and its neighbours below are linked to the smallest of them."""
    lowest = stars.groupBy("u").agg(F.min("v").alias("low"))
    below = stars.join(lowest, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return below.unionByName(lowest.select("u", F.col("low").alias("v"))).distinct()
