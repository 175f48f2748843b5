"""Centralities by power iteration over the edges, and the largest component."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadgraph.operators.components import connected_components
from spreadgraph.operators.graph import SpreadGraph
from spreadgraph.storage import keep, release

#: Rounds between two lineage cuts.
CUT_EVERY = 5


def largest_component(graph: SpreadGraph) -> DataFrame:
    """``component, size, share`` of the largest weakly connected component; of equals the one with the smallest id."""
    found = connected_components(graph.edges)
    alone = graph.vertices.join(found.select(F.col("node").alias("user_id")), "user_id", "left_anti").select(F.col("user_id").alias("node"), F.col("user_id").alias("component"))
    sizes = found.unionByName(alone).groupBy("component").agg(F.count("*").alias("size"))
    total = graph.vertices.agg(F.count("*").alias("total"))
    return sizes.orderBy(F.desc("size"), "component").limit(1).join(F.broadcast(total)).select("component", "size", (F.col("size") / F.col("total")).alias("share"))


def _spread(edges: DataFrame, now: DataFrame, weight: F.Column) -> DataFrame:
    """What each vertex receives along its incoming edges."""
    return edges.join(now.select(F.col("user_id").alias("src"), weight.alias("w")), "src").groupBy(F.col("dst").alias("user_id")).agg(F.sum("w").alias("got"))


def _iterate(now: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, epsilon: float | None, name: str, cut: int = CUT_EVERY) -> DataFrame:
    """Up to ``rounds`` rounds on ``user_id, x`` (and more); with ``epsilon`` they end when the values change by no more in all."""
    for i in range(rounds):
        new = step(now)
        if epsilon is not None:
            new = keep(new, name)
            gap = new.join(now.select("user_id", F.col("x").alias("_was")), "user_id").agg(F.sum(F.abs(F.col("x") - F.col("_was")))).first()[0]
            release(now)
            now = new
            if (gap or 0.0) <= epsilon:
                break
        else:
            now = keep(new, name) if (i + 1) % cut == 0 and i + 1 < rounds else new
    return now


def katz(graph: SpreadGraph, alpha: float = 0.01, beta: float = 1.0, rounds: int = 5, normalise: bool = False, epsilon: float | None = None) -> DataFrame:
    """``user_id, katz``: ``x = alpha * A^T x + beta`` from zero; parallel edges count each.

    A fixed number of rounds, or with ``epsilon`` until the values change by no more in all, ``rounds`` at most. It converges for alpha
    below the inverse of the largest eigenvalue.
    """

    def step(now: DataFrame) -> DataFrame:
        return graph.vertices.join(_spread(graph.edges, now, F.col("x")), "user_id", "left").select("user_id", (F.lit(beta) + alpha * F.coalesce("got", F.lit(0.0))).alias("x"))

    now = _iterate(graph.vertices.select("user_id", F.lit(0.0).alias("x")), step, rounds, epsilon, "katz")
    if normalise:
        norm = now.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        now = now.join(F.broadcast(norm)).select("user_id", (F.col("x") / F.col("norm")).alias("x"))
    return now.withColumnRenamed("x", "katz")


def pagerank(graph: SpreadGraph, damping: float = 0.85, rounds: int = 5, epsilon: float | None = None) -> DataFrame:
    """``user_id, pagerank`` from the uniform vector; what vertices without outgoing edges hold is dealt to all. Rounds as in ``katz``."""
    n = graph.vertices.agg(F.count("*").alias("n"))
    degree = graph.edges.groupBy(F.col("src").alias("user_id")).agg(F.count("*").alias("k"))
    base = graph.vertices.join(degree, "user_id", "left").join(F.broadcast(n)).select("user_id", "k", "n")

    def step(now: DataFrame) -> DataFrame:
        lost = now.agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("x"))), F.lit(0.0)).alias("lost"))
        got = _spread(graph.edges, now, F.col("x") / F.col("k"))
        return base.join(got, "user_id", "left").join(F.broadcast(lost)).select("user_id", "k", "n", ((1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))).alias("x"))

    now = _iterate(base.select("user_id", "k", "n", (1 / F.col("n")).alias("x")), step, rounds, epsilon, "pagerank")
    return now.select("user_id", F.col("x").alias("pagerank"))


def eigenvector(graph: SpreadGraph, rounds: int = 5, epsilon: float | None = None) -> DataFrame:
    """``user_id, eigenvec``: power iteration of ``x = A^T x`` from ones, scaled to length 1 after every round. Rounds as in ``katz``."""

    def step(now: DataFrame) -> DataFrame:
        raw = graph.vertices.join(_spread(graph.edges, now, F.col("x")), "user_id", "left").select("user_id", F.coalesce("got", F.lit(0.0)).alias("x"))
        norm = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        return raw.join(F.broadcast(norm)).select("user_id", F.try_divide("x", F.col("norm")).alias("x"))

    return _iterate(graph.vertices.select("user_id", F.lit(1.0).alias("x")), step, rounds, epsilon, "eigenvector", 2).withColumnRenamed("x", "eigenvec")
