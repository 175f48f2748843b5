"""Collective Influence: a distributed static score and the adaptive ranking."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadgraph.operators.centrality import katz
from spreadgraph.operators.graph import SpreadGraph
from spreadgraph.operators.traverse import levels

DIRECTIONS = ("undir", "in", "out", "both")


def _view(graph: SpreadGraph, direction: str) -> SpreadGraph:
    return {"out": lambda: graph, "in": graph.reverse, "undir": graph.undirected}[direction]()


def static_ci(graph: SpreadGraph, radius: int = 2, direction: str = "out", clamp_zero: bool = True) -> DataFrame:
    """``user_id, ci`` of every vertex: ``(k - 1) * sum(k(u) - 1)`` over the vertices at exactly the radius, 0 where ``k <= 1``.

    k is the number of outgoing edges of the view, parallel ones included; vertices without any add nothing to a sum (or -1 without
    ``clamp_zero``). 'both' adds the scores of the two directions.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    if direction == "both":
        parts = static_ci(graph, radius, "out", clamp_zero).unionByName(static_ci(graph, radius, "in", clamp_zero))
        return parts.groupBy("user_id").agg(F.sum("ci").alias("ci"))
    view = _view(graph, direction)
    k = view.edges.groupBy(F.col("src").alias("user_id")).agg(F.count("*").alias("k"))
    rooted = levels(view.edges, k.where("k > 1").select("user_id"), radius).where((F.col("d") == radius) & (F.col("d") > 0))
    far = rooted.join(k.select(F.col("user_id").alias("node"), F.col("k").alias("far_k")), "node", "inner" if clamp_zero else "left")
    total = far.groupBy(F.col("root").alias("user_id")).agg(F.sum(F.coalesce("far_k", F.lit(0)) - 1).alias("total"))
    scored = total.join(k, "user_id").select("user_id", ((F.col("k") - 1) * F.col("total")).alias("ci"))
    return graph.vertices.join(scored, "user_id", "left").select("user_id", F.coalesce("ci", F.lit(0)).cast("long").alias("ci"))


class _Removal:
    """One graph in memory while its vertices are removed by falling score."""

    def __init__(self, vertices: Iterable[int], edges: Iterable[tuple[int, int]], radius: int, direction: str, update: str):
        self.radius, self.direction, self.update = radius, direction, update
        self.vertices = sorted(vertices)
        self.out: dict[int, set[int]] = defaultdict(set)
        self.into: dict[int, set[int]] = defaultdict(set)
        self.many: dict[tuple[int, int], int] = defaultdict(int)
        self.k_out: dict[int, int] = defaultdict(int)
        self.k_in: dict[int, int] = defaultdict(int)
        for s, t in edges:
            self.out[s].add(t)
            self.into[t].add(s)
            self.many[s, t] += 1
            self.k_out[s] += 1
            self.k_in[t] += 1
        self.around = {v: (self.out[v] | self.into[v]) - {v} for v in self.vertices}
        if direction == "undir":
            self.k_out = {v: self.k_out[v] + self.k_in[v] for v in self.vertices}
        self.alive = set(self.vertices)

    def _rings(self, v: int, radius: int, step: dict[int, set[int]]) -> tuple[set[int], set[int]]:
        """The vertices at exactly the radius, and all within it but the centre."""
        seen, ring = {v}, {v}
        for _ in range(radius):
            nxt: set[int] = set()
            for u in ring:
                nxt |= step[u]
            ring = (nxt & self.alive) - seen
            seen |= ring
        return (ring if radius else set()), seen - {v}

    def _one(self, v: int, step: dict[int, set[int]], k: dict[int, int]) -> int:
        if k[v] <= 1:
            return 0
        ring, _ = self._rings(v, self.radius, step)
        return (k[v] - 1) * sum(k[u] - 1 for u in ring if k[u] > 0)

    def score(self, v: int) -> int:
        if self.direction == "undir":
            return self._one(v, self.around, self.k_out)
        total = 0
        if self.direction in ("out", "both"):
            total += self._one(v, self.out, self.k_out)
        if self.direction in ("in", "both"):
            total += self._one(v, self.into, self.k_in)
        return total

    def near(self, v: int) -> set[int]:
        """Whose score may change when v goes: the ball one step wider, along the view's edges, or against them for 'full'."""
        if self.direction == "undir":
            return self._rings(v, self.radius + 1, self.around)[1]
        found: set[int] = set()
        if self.direction in ("out", "both") or self.update == "full":
            found |= self._rings(v, self.radius + 1, self.out)[1]
        if self.direction in ("in", "both") or self.update == "full":
            found |= self._rings(v, self.radius + 1, self.into)[1]
        return found

    def remove(self, v: int) -> None:
        self.alive.discard(v)
        self.k_out[v] = self.k_in[v] = 0
        if self.direction == "undir":
            for u in self.around[v] & self.alive:
                self.k_out[u] -= 1
            return
        ahead, back = (self.out, self.into) if self.direction != "in" else (self.into, self.out)
        k_back, k_ahead = (self.k_in, self.k_out) if self.direction != "in" else (self.k_out, self.k_in)
        for u in ahead[v] & self.alive:
            k_back[u] -= 1 if self.update == "reference" else self.many[(v, u) if self.direction != "in" else (u, v)]
        if self.update == "full":
            for u in back[v] & self.alive:
                k_ahead[u] -= self.many[(u, v) if self.direction != "in" else (v, u)]

    def largest_share(self) -> float:
        """The largest weakly connected component over all vertices of the graph."""
        left, best = set(self.alive), 0
        while left:
            stack, size = [left.pop()], 0
            while stack:
                size += 1
                more = self.around[stack.pop()] & left
                left -= more
                stack.extend(more)
            best = max(best, size)
        return best / max(len(self.vertices), 1)

    def run(self) -> list[tuple[int, int]]:
        """(vertex, score when removed) in order of removal."""
        n = len(self.vertices)
        cutoff, every = (0.01, int(0.01 * n)) if n > 1000 else (1 / max(n, 1), 10)
        heap = [(-self.score(v), v) for v in self.vertices]
        heapq.heapify(heap)
        order: list[tuple[int, int]] = []
        stale: set[int] = set()
        share, checked = 1.0, -1
        while heap and share > cutoff:
            negative, v = heapq.heappop(heap)
            if v in stale and heap:
                stale.discard(v)
                now = self.score(v)
                if -now > heap[0][0]:
                    heapq.heappush(heap, (-now, v))
                    continue
                negative = -now
            stale |= self.near(v)
            self.remove(v)
            order.append((v, -negative))
            if len(order) == 1 or len(heap) % every == 0 and len(heap) != checked:
                checked, share = len(heap), self.largest_share()
            if len(order) > 1 and -negative < 1:
                break
        return order


def adaptive_ranking(vertices: Iterable[int], edges: Iterable[tuple[int, int]], radius: int = 2, direction: str = "undir", update: str = "reference") -> list[tuple[int, int]]:
    """Remove the vertex of the highest score again and again; scores are refreshed when a vertex comes up whose surroundings changed.

    Equal scores go by id. ``update='reference'`` lowers only the degrees on the far side of the removed vertex's edges, as the study
    did; 'full' lowers those on both sides. 'both' always adds its two parts. Ends when the largest weakly connected component is
    small or a removed score is below 1.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    if update not in ("reference", "full"):
        raise ValueError("update must be 'reference' or 'full'")
    return _Removal(vertices, edges, radius, direction, update).run()


def adaptive_ci(graphs: DataFrame, radius: int = 2, direction: str = "out", update: str = "reference") -> DataFrame:
    """``graph_id, user_id, place, ci``: the adaptive ranking of every graph; ``graphs`` has ``graph_id, src, dst``.

    Removal is inherently one step after the other, so each graph is one task and graphs run beside each other; a vertex that is
    never removed has no row. A vertex without edges can be given as a row with a null ``dst``.
    """

    def rank(rows: pd.DataFrame) -> pd.DataFrame:
        linked = rows.dropna(subset=["dst"])
        vertices = set(rows["src"].astype("int64")) | set(linked["dst"].astype("int64"))
        order = adaptive_ranking(vertices, zip(linked["src"].astype("int64").tolist(), linked["dst"].astype("int64").tolist(), strict=True), radius, direction, update)
        return pd.DataFrame({"graph_id": rows["graph_id"].iat[0], "user_id": [int(v) for v, _ in order], "place": range(len(order)), "ci": [int(c) for _, c in order]}).astype({"user_id": "int64", "place": "int32", "ci": "int64"})

    return graphs.select("graph_id", "src", "dst").groupBy("graph_id").applyInPandas(rank, "graph_id string, user_id long, place int, ci long")


def static_vertices(graph: SpreadGraph, radius: int = 2, alpha: float = 0.01, rounds: int = 4) -> DataFrame:
    """``user_id, k_out, k_in, ci_out, ci_in, katz, katz_rev`` with the static scores: distributed throughout, for graphs of any size."""
    out = graph.degrees()
    for way in ("out", "in"):
        out = out.join(static_ci(graph, radius, way).withColumnRenamed("ci", f"ci_{way}"), "user_id")
    out = out.join(katz(graph, alpha, 1.0, rounds), "user_id")
    return out.join(katz(graph.reverse(), alpha, 1.0, rounds).withColumnRenamed("katz", "katz_rev"), "user_id")


def enriched_vertices(graph: SpreadGraph, radius: int = 2, alpha: float = 0.01, rounds: int = 100, epsilon: float | None = 1e-6) -> DataFrame:
    """What a saved graph's vertices carry: ``user_id, k_out, k_in, ci_out, place_out, ci_in, place_in, katz, katz_rev``.

    The scores are those at a vertex's removal in the adaptive ranking of each direction, and its place there (0 and null for what was
    never removed); both Katz centralities run until they change by ``epsilon`` in all. The ranking is one task a direction.
    """
    out = graph.degrees()
    linked = graph.edges.select("src", F.col("dst").cast("long").alias("dst"))
    alone = graph.vertices.join(graph.edges.select(F.explode(F.array("src", "dst")).alias("user_id")).distinct(), "user_id", "left_anti").select(F.col("user_id").alias("src"), F.lit(None).cast("long").alias("dst"))
    whole = linked.unionByName(alone).withColumn("graph_id", F.lit("one"))
    for way in ("out", "in"):
        ranked = adaptive_ci(whole, radius, way).select("user_id", F.col("ci").alias(f"ci_{way}"), F.col("place").alias(f"place_{way}"))
        out = out.join(ranked, "user_id", "left").fillna(0, [f"ci_{way}"])
    out = out.join(katz(graph, alpha, 1.0, rounds, epsilon=epsilon), "user_id")
    return out.join(katz(graph.reverse(), alpha, 1.0, rounds, epsilon=epsilon).withColumnRenamed("katz", "katz_rev"), "user_id")
