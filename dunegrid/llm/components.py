"""Connected components of a link table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunegrid.llm.common import stored


def _stars(edges: DataFrame) -> DataFrame:
    """Rows (u, v) with u > v, distinct."""
    return edges.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node is either one edge's child or a root."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root")).filter(
        (F.col("child") > 1) | ((F.col("child") == 1) & (F.col("root") == 1))).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``: root is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest neighbour
    (large star), then its smaller neighbours (small star); it ends when every
    edge leads to its component's smallest node, after O(log n) rounds in
    practice, and each round is written to the shared folder.  A hub's edges
    are never gathered: its smallest neighbour is a partial aggregate and comes
    back by a join.
    """
    first = _stars(links.select(F.col(a).alias("u"), F.col(b).alias("v")))
    edges = stored(first, "links", links.count())
    n = edges.count()
    while not _is_forest_of_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(_stars(large), "large-star", n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v")))
        edges = stored(_stars(small), "small-star", n)
        n = edges.count()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
