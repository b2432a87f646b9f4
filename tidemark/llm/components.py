"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step over edges (u, v) with u > v: neighbours are tied to a node's minimum.

    The large star takes all neighbours of a node and moves the larger ones, the small
    star its smaller neighbours and the node itself.
    """
    if larger:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m")
    )
    joined = around.join(least, "u")
    if larger:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where(F.col("u") != F.col("v")).distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node without any: the components are there."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.agg(F.max(F.col("down") + F.col("up") > 1)).first()[0]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (u, v); a component is its least node.

    Each round is a table in the shared folder, so lineage stays short. Nothing but one
    truth value per round reaches the driver, no node's neighbours are gathered in one
    place, and no round is spent on finding that nothing changes any more.
    """
    edges = links.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = written(edges.distinct(), "links")
    while not _stars_only(edges):
        edges = written(_star(_star(edges, True), False), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
