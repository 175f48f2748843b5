"""A directed multigraph as two frames, and its lazy views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SpreadGraph:
    """``vertices(user_id)`` and ``edges(src, dst, ...)``; edges run with the information, from who is responded to."""

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, edges: DataFrame) -> SpreadGraph:
        ends = edges.select(F.col("src").alias("user_id")).union(edges.select(F.col("dst").alias("user_id")))
        return cls(ends.distinct(), edges)

    def simple(self) -> SpreadGraph:
        """Without parallel edges and self-loops; the vertices stay, those with self-loops only too."""
        return SpreadGraph(self.vertices, self.edges.where("src <> dst").select("src", "dst").distinct())

    def reverse(self) -> SpreadGraph:
        other = [c for c in self.edges.columns if c not in ("src", "dst")]
        return SpreadGraph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *other))

    def undirected(self) -> SpreadGraph:
        """Every edge in both directions."""
        return SpreadGraph(self.vertices, self.edges.select("src", "dst").unionByName(self.reverse().edges.select("src", "dst")))

    def without(self, users: DataFrame) -> SpreadGraph:
        """The graph less some vertices and their edges."""
        gone = users.select("user_id")
        edges = self.edges.join(gone.select(F.col("user_id").alias("src")), "src", "left_anti").join(gone.select(F.col("user_id").alias("dst")), "dst", "left_anti")
        return SpreadGraph(self.vertices.join(gone, "user_id", "left_anti"), edges)

    def degrees(self) -> DataFrame:
        """``user_id, k_out, k_in`` with multiplicity, 0 where there is no edge: one aggregation over both ends."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("user_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("user_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
        return self.vertices.select("user_id", F.lit(0).alias("o"), F.lit(0).alias("i")).unionByName(ends).groupBy("user_id").agg(F.sum("o").alias("k_out"), F.sum("i").alias("k_in"))


def official_ratio(edges: DataFrame, direction: str) -> DataFrame:
    """``user_id, ratio``: the share of a vertex's edges that official clients made; ``edges`` carry ``is_official``."""
    end = {"in": "dst", "out": "src"}
    if direction not in end:
        raise ValueError("direction must be 'in' or 'out'")
    return edges.groupBy(F.col(end[direction]).alias("user_id")).agg(F.avg(F.col("is_official").cast("double")).alias("ratio"))


def main_client(vertices: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """``user_id, client``: the client of most of a vertex's edges, the first by name of equals, 'NA' without edges."""
    end = {"in": "dst", "out": "src"}
    if direction not in end:
        raise ValueError("direction must be 'in' or 'out'")
    n = edges.where("source_content is not null").groupBy(F.col(end[direction]).alias("user_id"), "source_content").agg(F.count("*").alias("n"))
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "source_content"))).where("r = 1")
    return vertices.join(best.select("user_id", "source_content"), "user_id", "left").select("user_id", F.coalesce("source_content", F.lit("NA")).alias("client"))


def network_stats(graph: SpreadGraph) -> DataFrame:
    """``n_nodes, n_edges, mean_k, max_k_out, max_k_in`` in one row."""
    d = graph.degrees()
    return d.agg(F.count("*").alias("n_nodes"), F.sum("k_out").alias("n_edges"), F.avg("k_out").alias("mean_k"), F.max("k_out").alias("max_k_out"), F.max("k_in").alias("max_k_in"))


def ccdf(values: DataFrame, column: str, normalise: bool = True) -> DataFrame:
    """``value, p``: the share (or number) of rows with at least each value. Aggregated first; the window runs over distinct values."""
    n = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    falling = Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    at_least = F.sum("n").over(falling)
    return n.select("value", (at_least / F.sum("n").over(Window.partitionBy()) if normalise else at_least).alias("p"))


def with_layout(vertices: DataFrame, positions: DataFrame, mirror_x: bool = False, mirror_y: bool = False) -> DataFrame:
    """Vertices with fixed places ``x, y`` from a table of positions by ``user_id``, mirrored if asked for; unplaced ones have nulls."""
    sign = lambda flip: F.lit(-1.0 if flip else 1.0)
    placed = positions.select("user_id", (F.col("x") * sign(mirror_x)).alias("x"), (F.col("y") * sign(mirror_y)).alias("y"))
    return vertices.join(placed, "user_id", "left")
