"""Statistical functions that Spark lacks, over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: float, b: float, x: np.ndarray, terms: int = 200) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, evaluated from its far end."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    f = np.ones_like(z)
    for m in range(terms, 0, -1):
        odd = -(p + m - 1 + 0.0) * (p + q + m - 1) * z / ((p + 2 * m - 2) * (p + 2 * m - 1))
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        f = 1 + odd / (1 + even / f)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(z) + q * np.log1p(-z)) / p
    out = np.where(z <= 0, 0.0, front / f)
    return np.where(flip, 1 - out, out)


def t_cdf(t: np.ndarray, dof: float) -> np.ndarray:
    tail = incomplete_beta(dof / 2, 0.5, dof / (dof + np.asarray(t, float) ** 2)) / 2
    return np.where(np.asarray(t) > 0, 1 - tail, tail)


def t_quantile(p: float, dof: float) -> float:
    """The t with that share of the distribution below it, by bisection."""
    lo, hi = -1.0, 1.0
    while t_cdf(np.array([hi]), dof)[0] < p:
        hi *= 2
    while t_cdf(np.array([lo]), dof)[0] > p:
        lo *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if t_cdf(np.array([mid]), dof)[0] < p else (lo, mid)
    return (lo + hi) / 2


def p_value(t: str | Column, dof: float) -> Column:
    """1 - CDF for t >= 1, CDF below, 0 for zero or what isn't finite."""

    @F.pandas_udf(T.DoubleType())
    def f(s: pd.Series) -> pd.Series:
        x = s.to_numpy(float, na_value=np.nan)
        use = np.isfinite(x) & (x != 0)
        c = t_cdf(np.where(use, x, 0.0), dof)
        return pd.Series(np.where(use, np.where(x >= 1, 1 - c, c), 0.0))

    return f(t)


def histogram(df: DataFrame, v: str, bins: int) -> tuple[float, float, list[int]]:
    """Least, greatest and counts of equal bins: two aggregations, at most ``bins`` rows."""
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    if lo is None:
        return 0.0, 0.0, [0] * bins
    k = F.least(F.floor((F.col(v) - lo) / max(hi - lo, 1e-300) * bins), F.lit(bins - 1)).cast("int")
    got = dict(df.groupBy(k).agg(F.count(F.lit(1))).collect())
    return float(lo), float(hi), [got.get(i, 0) for i in range(bins)]


def quantiles(df: DataFrame, v: str, shares: list[float], bins: int = 255) -> list[float]:
    """Quantiles interpolated in a histogram."""
    lo, hi, counts = histogram(df, v, bins)
    edges = np.linspace(lo, hi, bins + 1)
    cumulative = np.concatenate([[0], np.cumsum(counts)]) / max(1, sum(counts))
    return np.interp(shares, cumulative, edges).tolist()


def piecewise(v: str | Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation through points, constant outside; a projection."""
    x = F.col(v) if isinstance(v, str) else v
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 2, -1, -1):
        step = xs[i + 1] - xs[i]
        inside = F.lit(float(ys[i])) + (x - xs[i]) * ((ys[i + 1] - ys[i]) / step) if step > 0 else F.lit(float(ys[i + 1]))
        out = F.when(x < xs[i + 1], inside).otherwise(out)
    return F.when(x <= xs[0], F.lit(float(ys[0]))).otherwise(out)


def match_histogram(df: DataFrame, reference: DataFrame, points: int = 64, bins: int = 255, v: str = "v", out: str = "out") -> DataFrame:
    """v mapped so that its quantiles become the reference's."""
    shares = [i / (points + 1) for i in range(points + 2)]
    return df.withColumn(out, piecewise(v, quantiles(df, v, shares, bins), quantiles(reference, v, shares, bins)))


def equalize_histogram(df: DataFrame, bins: int = 255, v: str = "v", out: str = "out") -> DataFrame:
    """v mapped to its cumulative share, over its range."""
    lo, hi, counts = histogram(df, v, bins)
    edges = np.linspace(lo, hi, bins + 1).tolist()
    share = (np.concatenate([[0], np.cumsum(counts)]) / max(1, sum(counts)) * (hi - lo) + lo).tolist()
    return df.withColumn(out, piecewise(v, edges, share))
