"""How series move together: correlation graphs, adjusted p-values, lagged linear mediation with a bootstrap."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correlation_matrix(long: DataFrame, lag_col: str | None = None) -> DataFrame:
    """``i, j, corr``: Pearson correlation of every pair of series over the bins where both have a value."""
    a = long.where("value is not null").select("bin", F.col("series").alias("i"), F.col("value").alias("x"))
    b = long.where("value is not null").select("bin", F.col("series").alias("j"), F.col("value").alias("y"))
    return a.join(b, "bin").groupBy("i", "j").agg(F.corr("x", "y").alias("corr"))


def threshold_graph(matrix: DataFrame, threshold: float) -> DataFrame:
    """``i, j, corr, width``: undirected edges over the threshold once, and their widths: the correlation over the largest one."""
    kept = matrix.where((F.col("i") < F.col("j")) & (F.col("corr") > threshold))
    return kept.withColumn("width", F.col("corr") / F.max("corr").over(Window.partitionBy()))


def rescaled(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Min-max scaling by the range; 0 where all are equal."""
    w = Window.partitionBy()
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return rows.withColumn(name, F.coalesce(F.try_divide(F.col(column) - lo, hi - lo), F.lit(0.0)))


def benjamini_hochberg(rows: DataFrame, p: str = "p", name: str = "q") -> DataFrame:
    """Adds q-values: the smallest ``p * m / rank`` from each place on, at most 1. Null p-values get null and don't count."""
    tests = rows.where(F.col(p).isNotNull())
    up = Window.orderBy(p)
    ranked = tests.withColumn("_r", F.row_number().over(up)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    from_here = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(from_here))
    return ranked.withColumn(name, q).drop("_r", "_m").unionByName(rows.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def two_stage_bh(rows: DataFrame, alpha: float = 0.05, p: str = "p", name: str = "q") -> DataFrame:
    """Two-stage adaptive q-values: the share of true nulls is estimated from a first pass at ``alpha / (1 + alpha)``."""
    first = benjamini_hochberg(rows, p, "_q1")
    w = Window.partitionBy()
    level = alpha / (1 + alpha)
    m = F.count(p).over(w)
    nulls = m - F.sum(F.when(F.col("_q1") <= level, 1).otherwise(0)).over(w)
    return first.withColumn(name, F.least(F.lit(1.0), F.col("_q1") * F.try_divide(nulls, m) * (1 + alpha))).drop("_q1")


def significant_parents(tests: DataFrame, q0: float = 0.05) -> DataFrame:
    """``j, i, tau, value, q``: for each target the lagged drivers at or below the level, the strongest first in ``place``."""
    kept = tests.where((F.col("tau") >= 1) & (F.col("q") <= q0))
    strongest = Window.partitionBy("j").orderBy(F.desc(F.abs("value")), "i", "tau")
    return kept.withColumn("place", F.row_number().over(strongest) - 1)


# --------------------------------------------------------------------------- kernels on one window of a few series

Parents = Mapping[int, Sequence[tuple[int, int]]]  # target -> (driver, lag)


def standardise(x: np.ndarray) -> np.ndarray:
    spread = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1)


def fit_lagged(x: np.ndarray, parents: Parents, max_lag: int) -> np.ndarray:
    """``phi[lag, target, driver]``: each target regressed on its own lagged drivers by least squares."""
    t, n = x.shape
    phi = np.zeros((max_lag + 1, n, n))
    for j, chosen in parents.items():
        if chosen:
            design = np.stack([x[max_lag - lag : t - lag, i] for i, lag in chosen], axis=1)
            found = np.linalg.lstsq(design, x[max_lag:, j], rcond=None)[0]
            for (i, lag), c in zip(chosen, found, strict=True):
                phi[lag, j, i] = c
    return phi


def total_effects(phi: np.ndarray) -> np.ndarray:
    """``psi[lag, target, driver]``: psi(0) is the identity, psi(t) the sum over s of phi(s) psi(t - s)."""
    psi = np.zeros_like(phi)
    psi[0] = np.eye(phi.shape[1])
    for t in range(1, len(phi)):
        psi[t] = sum(phi[s] @ psi[t - s] for s in range(1, t + 1))
    return psi


def residuals(x: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """What the lagged model leaves of each row from the largest lag on."""
    lags = len(phi) - 1
    fit = sum(x[lags - s : len(x) - s] @ phi[s].T for s in range(1, lags + 1)) if lags else 0
    return x[lags:] - fit


def resample(x: np.ndarray, phi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A series of the same length that the model makes from residual rows drawn with replacement."""
    lags = len(phi) - 1
    noise = residuals(x, phi)
    out = noise[rng.integers(0, len(noise), len(x))].copy()
    for t in range(lags, len(x)):
        for s in range(1, lags + 1):
            out[t] += phi[s] @ out[t - s]
    return out


def causal_effects(wide: DataFrame, series: Sequence[str], parents: Mapping[str, Sequence[tuple[str, int]]], max_lag: int, replicates: int = 200, seed: int = 52) -> DataFrame:
    """``i, j, tau, ce_max, ce_mean, ce_std``: each total effect of largest size over lags from 1, with bootstrap mean and spread there.

    ``wide`` (one column a series, ordered by ``bin``) must be short: a few thousand bins of a few series are collected once and
    sent to the tasks, one replicate each; replicate r draws with seed + r.
    """
    x = standardise(wide.orderBy("bin").select(*series).dropna().toPandas().to_numpy(float))
    number = {s: i for i, s in enumerate(series)}
    chosen = {number[j]: [(number[i], lag) for i, lag in p] for j, p in parents.items()}
    phi = fit_lagged(x, chosen, max_lag)
    psi = total_effects(phi)
    names = list(series)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        r = int(rows["id"].iat[0])
        made = total_effects(fit_lagged(resample(x, phi, np.random.default_rng(seed + r)), chosen, max_lag))
        tau, j, i = np.indices(made.shape)
        return pd.DataFrame({"r": r, "tau": tau.ravel().astype("int32"), "j": np.array(names)[j.ravel()], "i": np.array(names)[i.ravel()], "psi": made.ravel()})

    spark = wide.sparkSession
    tau, j, i = np.indices(psi.shape)
    whole = spark.createDataFrame(pd.DataFrame({"tau": tau.ravel().astype("int32"), "j": np.array(names)[j.ravel()], "i": np.array(names)[i.ravel()], "psi": psi.ravel()}), "tau int, j string, i string, psi double")
    best = whole.where("tau >= 1").groupBy("i", "j").agg(F.max_by("tau", F.struct(F.abs("psi"), -F.col("tau"))).alias("tau"), F.max(F.abs("psi")).alias("ce_max")).where("ce_max > 0")
    drawn = spark.range(0, replicates, 1, min(replicates, 16)).groupBy("id").applyInPandas(one, "r int, tau int, j string, i string, psi double")
    spread = drawn.join(F.broadcast(best), ["i", "j", "tau"]).groupBy("i", "j", "tau", "ce_max").agg(F.abs(F.avg("psi")).alias("ce_mean"), F.stddev_pop("psi").alias("ce_std"))
    return spread.select("i", "j", "tau", "ce_max", "ce_mean", "ce_std")


def partial_correlations(long: DataFrame, max_lag: int, step: str) -> DataFrame:
    """``i, j, tau, value, n``: the correlation of series i with series j ``tau`` steps later, given j one step before.

    A linear conditional independence test's statistic. Bins without all three values are left out; null where the condition is the
    series itself (i = j, tau = 1) or leaves nothing to correlate. ``step`` is the interval between bins, as in SQL.
    """
    later = lambda name, value, lag: long.select(F.col("series").alias(name), (F.col("bin") + F.expr(f"{lag} * {step}")).alias("bin"), F.col("value").alias(value))
    x = reduce(DataFrame.unionByName, [later("i", "x", lag).withColumn("tau", F.lit(lag)) for lag in range(1, max_lag + 1)])
    y = long.select(F.col("series").alias("j"), "bin", F.col("value").alias("y")).join(later("j", "z", 1), ["j", "bin"])
    r = x.join(y, "bin").groupBy("i", "j", "tau").agg(F.corr("x", "y").alias("xy"), F.corr("x", "z").alias("xz"), F.corr("y", "z").alias("yz"), F.count("*").alias("n"))
    given = F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)))
    return r.select("i", "j", "tau", F.when((F.col("i") != F.col("j")) | (F.col("tau") != 1), given).alias("value"), "n")


def independence_tests(partial: DataFrame) -> DataFrame:
    """Partial correlations with their two-sided p-value ``p`` by Fisher's z (one condition): small where i tells more about j. Null in, null out."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else None).astype(float)

    bounded = F.greatest(F.least(F.col("value"), F.lit(1 - 1e-15)), F.lit(-1 + 1e-15))
    return partial.withColumn("p", F.when(F.col("value").isNotNull() & (F.col("n") > 4), tail(F.atanh(bounded) * F.sqrt(F.greatest(F.col("n") - 4, F.lit(0))))))


def causal_graph(effects: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Edges between different series over the threshold with ``width`` scaled by the range; ``self_effect`` of the driver as its node's size."""
    own = effects.where("i = j").select("i", F.col("ce_max").alias("self_effect"))
    between = rescaled(effects.where(F.col("ce_max").isNotNull() & (F.col("i") != F.col("j"))), "ce_max", "width")
    return between.where(F.col("ce_max") > threshold).join(own, "i", "left")


def bootstrap_degrees(degrees: DataFrame, column: str, sample_size: int, replicates: int, seed: int = 0) -> DataFrame:
    """``mean, mean_std, cv, cv_std``: a column's mean and coefficient of variation over samples with replacement.

    The column is first counted per value, and a sample is a multinomial draw over those counts: what the driver holds and sends is
    the distinct degrees, not the vertices.
    """
    counted = degrees.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n")).orderBy("k").toPandas()
    k, n = counted["k"].to_numpy(float), counted["n"].to_numpy(float)
    share = n / n.sum() if len(n) else n

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows["id"]:
            drawn = np.random.default_rng(seed + int(r)).multinomial(sample_size, share)
            mean = (drawn * k).sum() / sample_size
            out.append((mean, np.sqrt((drawn * (k - mean) ** 2).sum() / sample_size) / mean if mean else np.nan))
        return pd.DataFrame(out, columns=["mean", "cv"])

    draws = degrees.sparkSession.range(0, replicates if len(n) else 0, 1, min(replicates, 16)).mapInPandas(lambda it: (one(b) for b in it), "mean double, cv double")
    return draws.agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("mean_std"), F.avg("cv").alias("cv"), F.stddev_pop("cv").alias("cv_std"))
