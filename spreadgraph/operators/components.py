"""Connected components by alternating large-star and small-star steps.

Both steps only compare a node with its neighbours' smallest id, so a hub's neighbours are never gathered in one row, and the number
of rounds grows with the logarithm of the graph's size rather than its diameter. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadgraph.storage import keep, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to the smallest node around it."""
    both = edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free hash: equal when a round changed nothing."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node that has an edge to another; the component is its smallest node.

    Self-loops and edges with a null end are ignored; nodes without other edges don't appear.
    """
    now = keep(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        last, now = now, keep(_small_star(_large_star(now)), "stars")
        before, mark = mark, _mark(now)
        release(last)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # every edge now leads from a node to the smallest of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
