"""Connected components of a link table, by joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.stored import materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; a component is its smallest node.

    Large-star and small-star steps: each turns the links of a node towards its smallest
    neighbour, until all links are stars. Their number never grows and no neighbour list is ever
    gathered, so a node with very many links is only a frequent key of a join and of a minimum.
    Self links and nulls are ignored. Every round is stored, which cuts the lineage.
    """
    links = links.filter("a <> b").select(
        F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")
    )
    links = materialize(links.distinct(), "links")
    while not _stars(links):
        both = links.unionByName(links.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        low = both.groupBy("child").agg(F.least(F.min("parent"), F.col("child")).alias("low"))
        # Large star: what is above a node hangs below the node's smallest neighbour instead.
        above = links.select(F.col("parent").alias("node"), "child")
        large = above.join(low.withColumnRenamed("child", "node"), "node").select("child", F.col("low").alias("parent"))
        links = materialize(large.filter("child <> parent").distinct(), "links")
        # Small star: a node and its parents hang below the smallest of them.
        low = links.groupBy("child").agg(F.min("parent").alias("low"))
        below = links.join(low, "child").select(F.col("parent").alias("child"), F.col("low").alias("parent"))
        own = low.select("child", F.col("low").alias("parent"))
        links = materialize(below.unionByName(own).filter("child <> parent").distinct(), "links")
    roots = links.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return links.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(roots)


def _stars(links: DataFrame) -> bool:
    """Whether every node has one parent and no parent has a parent."""
    nodes = links.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    odd = nodes.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return odd.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()
