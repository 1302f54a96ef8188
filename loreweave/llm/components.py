"""Connected components of links, by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import dropped, written


def _stars(edges: DataFrame) -> bool:
    """Whether each node that points to another points to one alone, which points to none: then that is its root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("led")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("led")))
    met = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("led").alias("led"))
    return met.agg(F.coalesce(F.max((F.col("out") > 1) | (F.col("out") > 0) & (F.col("led") > 0)), F.lit(False)).alias("on")).collect()[0]["on"] is False


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), "large-star-least")
    out = written(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "large-star")
    dropped(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of these."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("least")), "small-star-least")
    moved = edges.join(least, "u").where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    out = written(moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), "small-star")
    dropped(least)
    return out


def connected_components(links: DataFrame) -> DataFrame:
    """(u, v) of any orderable type to (node, root): every node of a link with the least node that links reach from it.

    Nothing is gathered by component: a round takes minima (which Spark sums up before it shuffles) and joins two
    written tables, whose large keys adaptive execution splits. Rounds grow with the logarithm of the longest chain, and
    end when every component is one star: links always lead to smaller nodes, so its middle is the least.
    """
    edges = written(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(edges):
        large = _large_star(edges)
        dropped(edges)
        edges = _small_star(large)
        dropped(large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
