"""Seasonal-trend decomposition by LOESS, one task a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def loess(y: np.ndarray, span: int, degree: int, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local regression of an evenly spaced series (x = 0, 1, ...) at the places ``at``: the ``span`` nearest points, tricube weights."""
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else np.asarray(at, float)
    weights = np.ones(n) if weights is None else weights
    q = min(span, n)
    left = np.clip(np.ceil(at - (q - 1) / 2 - 1e-9).astype(int), 0, n - q)
    idx = left[:, None] + np.arange(q)
    dist = np.abs(idx - at[:, None])
    reach = dist.max(axis=1) + max(0.0, (span - n) / 2)
    w = np.clip(1 - (dist / np.maximum(reach, 1e-12)[:, None] * 0.999) ** 3, 0, None) ** 3 * weights[idx]
    total = w.sum(axis=1)
    w = np.where(total[:, None] > 0, w / np.where(total > 0, total, 1)[:, None], 1 / q)
    values = y[idx]
    if degree == 0:
        return (w * values).sum(axis=1)
    mean = (w * idx).sum(axis=1)
    away = idx - mean[:, None]
    var = (w * away**2).sum(axis=1)
    flat = var <= 1e-9 * n
    slope = np.where(flat, 0, (w * away * values).sum(axis=1) / np.where(flat, 1, var))
    return (w * values).sum(axis=1) + slope * (at - mean)


def _moving_average(x: np.ndarray, width: int) -> np.ndarray:
    s = np.concatenate(([0.0], np.cumsum(x)))
    return (s[width:] - s[:-width]) / width


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n + (n % 2 == 0)


def stl(y: np.ndarray, period: int, seasonal: int | None = None, trend: int | None = None, low: int | None = None, degrees: tuple[int, int, int] = (1, 1, 1), inner: int = 1, outer: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, residual), which add up to the series.

    Windows default to: seasonal ``period - 1`` made odd, low-pass the next odd number from the period, trend the next odd number from
    ``1.5 * period / (1 - 1.5 / seasonal)``. ``outer`` rounds of robustness weights; 0 is the plain version.
    """
    y = np.asarray(y, float)
    n = len(y)
    seasonal = seasonal or _odd(max(period - 1, 7))
    low = low or _odd(period)
    trend = trend or _odd(1.5 * period / (1 - 1.5 / seasonal))
    if n < 2 * period:
        raise ValueError("the series must hold at least two periods")
    robust, t = np.ones(n), np.zeros(n)
    s = np.zeros(n)
    for round_ in range(outer + 1):
        for _ in range(inner):
            detrended = y - t
            cycle = np.empty(n + 2 * period)
            for phase in range(period):
                sub = detrended[phase::period]
                at = np.arange(-1, len(sub) + 1)
                cycle[phase :: period][: len(at)] = loess(sub, seasonal, degrees[0], robust[phase::period], at)
            smooth = _moving_average(_moving_average(_moving_average(cycle, period), period), 3)
            s = cycle[period : period + n] - loess(smooth, low, degrees[2])
            t = loess(y - s, trend, degrees[1], robust)
        if round_ < outer:
            r = np.abs(y - s - t)
            h = 6 * np.median(r)
            robust = np.ones(n) if h <= 0 else np.clip(1 - (r / h) ** 2, 0, None) ** 2
    return t, s, y - s - t


def stl_components(series: DataFrame, period: int, **options) -> DataFrame:
    """``series, bin, value, trend, seasonal, residual`` from the long form. Missing values are dropped first; a series shorter than two periods has null parts."""

    def parts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["value"]).sort_values("bin")
        y = rows["value"].to_numpy(float)
        t, s, r = stl(y, period, **options) if len(y) >= 2 * period else (np.full(len(y), np.nan),) * 3
        return rows.assign(trend=t, seasonal=s, residual=r)[["series", "bin", "value", "trend", "seasonal", "residual"]]

    return series.select("series", "bin", "value").groupBy("series").applyInPandas(parts, "series string, bin timestamp_ntz, value double, trend double, seasonal double, residual double")
