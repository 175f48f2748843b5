"""Bounded breadth-first search from many roots at once, by joining frontiers with the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadgraph.storage import keep

#: From this level on every frontier is written out, so plans don't grow with the radius.
CUT_FROM = 3


def levels(edges: DataFrame, roots: DataFrame, radius: int) -> DataFrame:
    """``root, node, d, parent``: every vertex within the radius, its distance, and its smallest predecessor one step nearer.

    Parallel edges count once. The root itself is at distance 0. Distances follow the edges' direction.
    """
    step = edges.select("src", "dst").where("src <> dst").distinct()
    seen = roots.select(F.col("user_id").alias("root"), F.col("user_id").alias("node"), F.lit(0).alias("d"), F.lit(None).cast("long").alias("parent"))
    frontier = seen
    for d in range(1, radius + 1):
        reached = frontier.select("root", F.col("node").alias("src")).join(step, "src").groupBy("root", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = reached.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(d).alias("d"), "parent")
        if d >= CUT_FROM:
            frontier = keep(frontier, "frontier")
        seen = seen.unionByName(frontier)
    return seen


def ball(edges: DataFrame, roots: DataFrame, radius: int, include_center: bool = False) -> DataFrame:
    """``root, node`` at distances 1 to the radius; with the centre if asked for."""
    return levels(edges, roots, radius).where(F.col("d") >= (0 if include_center else 1)).select("root", "node")


def boundary(edges: DataFrame, roots: DataFrame, radius: int) -> DataFrame:
    """``root, node`` at exactly the radius; nothing for radius 0."""
    return levels(edges, roots, radius).where((F.col("d") == radius) & (F.col("d") > 0)).select("root", "node")


def bfs_tree(edges: DataFrame, roots: DataFrame, radius: int) -> DataFrame:
    """``root, src, dst``: the tree edges of each search; of several possible parents the smallest."""
    return levels(edges, roots, radius).where("d > 0").select("root", F.col("parent").alias("src"), F.col("node").alias("dst"))
