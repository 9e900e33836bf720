"""Connected components by distributed union-find: hook every node to its smallest neighbour, then jump pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import checkpointed, scratch, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node (a > b) sends its smaller neighbours, and itself, to the smallest one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hooked = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node of the edges (a > b) either has one edge down or any number up."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down")))
    each = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("all"))
    return not each.where("down > 1 or (down = 1 and all > 1)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b of one orderable type); root is the smallest node of its component.

    Alternates two star operations until the edges are stars. All steps are joins and aggregates; nothing but whether
    any node is left reaches the driver. Edges with a null end and loops are ignored; no edges give an empty table.
    """
    edges = edges.where("a is not null and b is not null and a != b")
    with scratch(edges.sparkSession):
        now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        while not _stars(now):
            now = checkpointed(_small_star(_large_star(now)))
        both = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        return written(both, "components", keep=True)
