"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.session import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); the component is its smallest node.

    Alternating large and small stars: each round ties every node to the smallest node known around it, until all
    are stars, after a number of rounds that grows with the logarithm of the nodes. Minima are combined before the
    shuffle, and each round is written as a table.
    """
    edges = settle(_edges(links))
    while not _stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(_edges(large).select(F.col("v").alias("u"), F.col("u").alias("v")))  # u is the larger
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = settle(_edges(small))
    tied = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return tied.unionAll(tied.select(F.col("component").alias("node"), "component").distinct())


def _edges(links: DataFrame) -> DataFrame:
    """Each link once, u < v."""
    return links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a smallest node or tied to one of them only."""
    seen = edges.select(F.col("u").alias("node"), F.lit(0).alias("ties"), F.lit(1).alias("centre")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(1).alias("ties"), F.lit(0).alias("centre")))
    return seen.groupBy("node").agg(F.sum("ties").alias("ties"), F.max("centre").alias("centre")).where("ties + centre > 1").isEmpty()
