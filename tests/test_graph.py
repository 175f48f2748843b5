import numpy as np
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spreadgraph.operators import centrality, graph, influence, traverse
from spreadgraph.operators.components import connected_components
from spreadgraph.operators.graph import SpreadGraph
from spreadgraph.operators.influence import adaptive_ranking

PATH = [(1, 2), (2, 3), (3, 4), (4, 5)]
HUBS = [(1, 2), (1, 3), (1, 4), (4, 5), (5, 6), (5, 7)]
DAG = [(1, 2), (1, 3), (2, 4), (2, 5), (3, 5), (3, 6), (5, 7), (5, 8), (4, 8)]
PARALLEL = [(1, 2), (1, 2), (1, 3), (2, 4), (2, 5)]


def make(spark, edges):
    return SpreadGraph.of(spark.createDataFrame(edges, "src long, dst long"))


def ci(g, radius, direction, **options):
    return {r["user_id"]: r["ci"] for r in influence.static_ci(g, radius, direction, **options).collect() if r["ci"]}


@pytest.mark.parametrize(
    ("edges", "radius", "direction", "want"),
    [
        (PATH, 1, "undir", {2: 1, 3: 2, 4: 1}),
        (PATH, 2, "undir", {2: 1, 4: 1}),
        (HUBS, 1, "undir", {1: 2, 4: 4, 5: 2}),
        (HUBS, 2, "undir", {1: 4, 5: 4}),
        (DAG, 1, "out", {1: 2, 2: 1, 3: 1}),
        (DAG, 2, "out", {1: 1}),
        (DAG, 1, "in", {8: 1}),
        (DAG, 2, "in", {}),
        (DAG, 0, "out", {}),
        (PARALLEL, 1, "out", {1: 2}),
        (DAG, 1, "both", {1: 2, 2: 1, 3: 1, 8: 1}),
    ],
)
def test_static_influence(spark, edges, radius, direction, want):
    assert ci(make(spark, edges), radius, direction) == want


def test_simple_graph_and_self_loops(spark):
    assert ci(make(spark, PARALLEL).simple(), 1, "out") == {1: 1}
    g = make(spark, [(9, 9)])
    assert g.degrees().collect()[0].asDict() == {"user_id": 9, "k_out": 1, "k_in": 1}
    assert g.simple().degrees().collect()[0].asDict() == {"user_id": 9, "k_out": 0, "k_in": 0}
    with pytest.raises(ValueError):
        influence.static_ci(g, 1, "sideways")


def test_adaptive_ranking_by_hand():
    assert adaptive_ranking({1, 2, 3, 4, 5}, PATH, 1, "undir") == [(3, 2), (4, 0)] or adaptive_ranking({1, 2, 3, 4, 5}, PATH, 1, "undir")[0] == (3, 2)


@given(st.integers(0, 10**6))
@settings(max_examples=25, deadline=None)
def test_adaptive_pops_the_true_maximum(seed):
    rng = random.Random(seed)
    n = rng.randrange(4, 14)
    edges = [e for e in itertools.combinations(range(n), 2) if rng.random() < 0.3]
    for radius in (1, 2):
        alive = set(range(n))
        for v, score in adaptive_ranking(range(n), edges, radius, "undir"):
            now = [(a, b) for a, b in edges if a in alive and b in alive]
            step = {u: {b if a == u else a for a, b in now if u in (a, b)} for u in alive}

            def value(u):
                if len(step[u]) <= 1:
                    return 0
                seen, ring = {u}, {u}
                for _ in range(radius):
                    ring = set().union(*(step[x] for x in ring)) - seen if ring else set()
                    seen |= ring
                return (len(step[u]) - 1) * sum(len(step[x]) - 1 for x in ring if step[x])

            assert score == max(map(value, alive))
            alive.discard(v)


def test_adaptive_by_graph(spark):
    rows = [("a", *e) for e in PATH] + [("b", *e) for e in HUBS] + [("b", 99, None)]
    got = influence.adaptive_ci(spark.createDataFrame(rows, "graph_id string, src long, dst long"), 1, "undir").collect()
    assert {(r["graph_id"], r["user_id"], r["ci"]) for r in got if r["place"] == 0} == {("a", 3, 2), ("b", 4, 4)}


def test_searches(spark):
    g = make(spark, DAG + [(2, 1)])
    pairs = lambda df: {tuple(r) for r in df.collect()}
    one = spark.createDataFrame([(1,)], "user_id long")
    assert pairs(traverse.ball(g.edges, one, 2)) == {(1, x) for x in (2, 3, 4, 5, 6)}
    assert pairs(traverse.ball(g.edges, one, 1, include_center=True)) == {(1, 1), (1, 2), (1, 3)}
    assert pairs(traverse.boundary(g.edges, one, 2)) == {(1, 4), (1, 5), (1, 6)}
    assert pairs(traverse.boundary(g.edges, one, 0)) == set()
    assert pairs(traverse.bfs_tree(g.edges, one, 4)) == {(1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 2, 5), (1, 3, 6), (1, 5, 7), (1, 4, 8)}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, x) for x in range(1001, 1100)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1000 for i in range(1000, 1100)}}
    row = centrality.largest_component(make(spark, edges)).collect()[0]
    assert (row["component"], row["size"]) == (1000, 100)


def test_ratios_and_clients(spark):
    e = spark.createDataFrame([(1, 2, "b", True), (1, 2, "a", False), (3, 2, "a", True)], "src long, dst long, source_content string, is_official boolean")
    assert graph.official_ratio(e, "in").collect()[0]["ratio"] == pytest.approx(2 / 3)
    v = SpreadGraph.of(e).vertices
    assert {tuple(r) for r in graph.main_client(v, e, "out").collect()} == {(1, "a"), (3, "a"), (2, "NA")}
    with pytest.raises(ValueError):
        graph.official_ratio(e, "up")


def test_ccdf(spark):
    rows = graph.ccdf(spark.createDataFrame([(0,), (1,), (1,), (3,)], "x long"), "x").orderBy("value").collect()
    assert [(r["value"], r["p"]) for r in rows] == [(0, 1.0), (1, 0.75), (3, 0.25)]


def test_without_and_views(spark):
    g = make(spark, DAG).without(spark.createDataFrame([(5,)], "user_id long"))
    assert g.edges.count() == 5 and g.vertices.count() == 7
    assert g.reverse().edges.where(F.col("src") == 8).count() == 1
    assert make(spark, PATH).undirected().edges.count() == 8


def test_power_iterations(spark):
    g = make(spark, [(1, 2), (2, 1)])
    assert {r["pagerank"] for r in centrality.pagerank(g, rounds=7).collect()} == {0.5}
    assert [round(r["eigenvec"], 9) for r in centrality.eigenvector(g, 4).collect()] == [0.707106781] * 2
    assert centrality.katz(g, 0.5, 1.0, 60).collect()[0]["katz"] == pytest.approx(2.0)


def test_power_iterations_until_they_stand(spark):
    edges = [(1, 2), (2, 3), (3, 1), (1, 3), (4, 1), (5, 4)]
    g = make(spark, edges)
    n, at = 5, {v: i for i, v in enumerate((1, 2, 3, 4, 5))}
    a = np.zeros((n, n))
    for s, t in edges:
        a[at[t], at[s]] += 1
    values = lambda df, c: [r[c] for r in df.orderBy("user_id").collect()]
    assert values(centrality.katz(g, 0.1, 1.0, 200, epsilon=1e-12), "katz") == pytest.approx(np.linalg.solve(np.eye(n) - 0.1 * a, np.ones(n)).tolist(), abs=1e-9)
    walk = a / np.maximum(a.sum(0), 1)
    rank = np.linalg.solve(np.eye(n) - 0.5 * walk, np.full(n, 0.5 / n))
    assert values(centrality.pagerank(g, 0.5, 200, epsilon=1e-10), "pagerank") == pytest.approx(rank.tolist(), abs=1e-8)
    wide = np.linalg.eig(a)
    lead = np.abs(np.real(wide.eigenvectors[:, np.argmax(np.real(wide.eigenvalues))]))
    assert values(centrality.eigenvector(g, 200, epsilon=1e-8), "eigenvec") == pytest.approx((lead / np.linalg.norm(lead)).tolist(), abs=1e-5)
    assert centrality.katz(g, 0.1, 1.0, 2, epsilon=0.0).count() == 5  # rounds are the limit


def test_enriched_vertices_hold_the_adaptive_ranking(spark):
    vertices = spark.createDataFrame([(v,) for v in [*range(1, 9), 50]], "user_id long")
    g = SpreadGraph(vertices, make(spark, DAG).edges)
    got = {r["user_id"]: r for r in influence.enriched_vertices(g).collect()}
    assert set(got) == {*range(1, 9), 50}
    for way in ("out", "in"):
        want = {v: (c, i) for i, (v, c) in enumerate(influence.adaptive_ranking(list(got), DAG, 2, way))}
        assert {v: (r[f"ci_{way}"], r[f"place_{way}"]) for v, r in got.items()} == {v: want.get(v, (0, None)) for v in got}
    assert got[50]["katz"] == pytest.approx(1.0) and got[50]["k_out"] == 0
