import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spreadgraph.operators import association as assoc
from spreadgraph.operators.decompose import loess, stl, stl_components


def test_bh_by_hand(spark):
    rows = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,), (None,)], "p double")
    got = {r["p"]: r["q"] for r in assoc.benjamini_hochberg(rows).collect()}
    assert got[None] is None
    assert [got[p] for p in (0.01, 0.02, 0.03, 0.5)] == pytest.approx([0.04, 0.04, 0.04, 0.5])


def test_two_stage_is_not_larger_by_more_than_its_level(spark):
    rows = spark.createDataFrame([(float(p),) for p in np.linspace(0.001, 1, 30) ** 2], "p double")
    got = assoc.two_stage_bh(assoc.benjamini_hochberg(rows, name="one")).collect()
    assert all(r["q"] <= min(1, 1.05 * r["one"]) + 1e-12 for r in got)


def test_threshold_graph_collapses_pairs(spark):
    m = spark.createDataFrame([("a", "b", 0.8), ("b", "a", 0.8), ("a", "a", 1.0), ("a", "c", 0.4)], "i string, j string, corr double")
    assert [tuple(r) for r in assoc.threshold_graph(m, 0.5).collect()] == [("a", "b", 0.8, 1.0)]


def test_lagged_model_recovers_its_coefficients():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    for t in range(2, len(x)):
        x[t, 1] += 0.5 * x[t - 1, 0]
        x[t, 0] += 0.3 * x[t - 2, 0]
    phi = assoc.fit_lagged(x, {1: [(0, 1)], 0: [(0, 2)]}, 2)
    assert phi[1, 1, 0] == pytest.approx(0.5, abs=0.05) and phi[2, 0, 0] == pytest.approx(0.3, abs=0.05)
    psi = assoc.total_effects(phi)
    assert np.allclose(psi[0], np.eye(2)) and np.allclose(psi[2], phi[1] @ phi[1] + phi[2])
    assert assoc.residuals(x, phi).shape == (3998, 2)
    assert assoc.resample(x, phi, rng).shape == x.shape


def test_causal_graph(spark):
    e = spark.createDataFrame([("a", "b", 1, 0.4), ("a", "a", 1, 0.9), ("b", "a", 2, 0.01)], "i string, j string, tau int, ce_max double")
    got = assoc.causal_graph(e, 0.05).collect()
    assert [(r["i"], r["j"], r["width"], r["self_effect"]) for r in got] == [("a", "b", 1.0, 0.9)]


def test_bootstrap_of_degrees(spark):
    k = spark.createDataFrame([(2,)] * 50 + [(4,)] * 50, "k long")
    row = assoc.bootstrap_degrees(k, "k", 10_000, 50).collect()[0]
    assert row["mean"] == pytest.approx(3, abs=0.02) and row["cv"] == pytest.approx(1 / 3, abs=0.01)
    assert 0 < row["mean_std"] < 0.03
    assert assoc.bootstrap_degrees(k.limit(0), "k", 10, 5).collect()[0]["mean"] is None


@given(st.integers(0, 1000), st.integers(4, 9))
@settings(max_examples=10, deadline=None)
def test_stl_parts_add_up(seed, period):
    y = np.random.default_rng(seed).normal(size=8 * period) + np.sin(np.arange(8 * period) * 2 * np.pi / period) * 3
    t, s, r = stl(y, period)
    assert np.allclose(t + s + r, y)


def test_stl_finds_a_clean_season():
    x = np.arange(240)
    t, s, r = stl(0.01 * x + np.sin(x * 2 * np.pi / 24), 24)
    assert np.abs(r).max() < 0.05 and np.abs(t - 0.01 * x)[24:-24].max() < 0.05


def test_loess_of_a_line_is_the_line():
    y = 3 + 2.0 * np.arange(30)
    assert np.allclose(loess(y, 7, 1), y)
    assert np.allclose(loess(y, 7, 1, at=np.array([-1, 30])), [1, 63])


def test_short_series_have_null_parts(spark):
    rows = spark.sql("select 'a' as series, timestamp_ntz'2024-01-01 00:00:00' as bin, 1.0D as value")
    assert stl_components(rows, 24).where(F.col("trend").isNull() | F.isnan("trend")).count() == 1


def test_partial_correlations_and_their_test(spark):
    import math

    rng = np.random.default_rng(3)
    a = rng.normal(size=400)
    b = np.zeros(400)
    for t in range(1, 400):
        b[t] = 0.6 * b[t - 1] + 0.5 * a[t - 1] + 0.3 * rng.normal()
    long = spark.createDataFrame([(t, s, float(x[t])) for s, x in (("a", a), ("b", b)) for t in range(400)], "bin int, series string, value double")
    got = {(r["i"], r["j"], r["tau"]): r for r in assoc.independence_tests(assoc.partial_correlations(long, 2, "1")).collect()}
    for tau in (1, 2):
        x, y, z = a[: 400 - tau], b[tau:], b[tau - 1 : 399]
        left = lambda v: v - np.polyval(np.polyfit(z, v, 1), z)  # noqa: E731, B023
        r = np.corrcoef(left(x), left(y))[0, 1]
        row = got["a", "b", tau]
        assert row["value"] == pytest.approx(r, abs=1e-9) and row["n"] == 400 - tau
        assert row["p"] == pytest.approx(math.erfc(abs(math.atanh(r)) * math.sqrt(400 - tau - 4) / math.sqrt(2)), abs=1e-12)
    assert got["a", "b", 1]["p"] < 1e-6 < 0.01 < got["b", "a", 1]["p"]
    assert got["a", "a", 1]["value"] is None and got["a", "a", 1]["p"] is None
