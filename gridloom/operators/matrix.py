"""Sparse regressions and multi-view decompositions.

All work on moment matrices, which Spark sums over rows (models.moments); so the cost on the driver
depends on the number of columns only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.models import _sparse, covariance


@dataclass(frozen=True)
class Gram:
    """Centred moments of predictors (xx), of them with a response (xy) and of the response (yy), and the means."""

    n: int
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    x_mean: np.ndarray
    y_mean: float

    def error(self, b: np.ndarray) -> float:
        """Mean squared residual."""
        return float(self.yy - 2 * b @ self.xy + b @ self.xx @ b)

    def constant(self, b: np.ndarray) -> float:
        return float(self.y_mean - b @ self.x_mean)


def gram(df: DataFrame, x: str, y: str) -> Gram:
    n, mean, cov = covariance(df.select(F.concat(x, F.array(F.col(y).cast("double"))).alias("values")))
    return Gram(n, cov[:-1, :-1], cov[:-1, -1], float(cov[-1, -1]), mean[:-1], float(mean[-1]))


def conjugate_gradient(g: Gram, penalty: float = 0.0, rounds: int = 200, tolerance: float = 1e-24) -> np.ndarray:
    """Ridge regression without a factorisation."""
    a = g.xx + penalty * np.eye(len(g.xy))
    b, r = np.zeros(len(g.xy)), g.xy.copy()
    p, s = r.copy(), r @ r
    for _ in range(rounds):
        if s < tolerance * (g.xy @ g.xy):
            break
        q = a @ p
        step = s / (p @ q)
        b, r = b + step * p, r - step * q
        new = r @ r
        p, s = r + new / s * p, new
    return b


def lasso(g: Gram, penalty: float, rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """Coordinate descent for mean squared error / 2 + penalty * |b|."""
    b = np.zeros(len(g.xy))
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(b)):
            if g.xx[j, j] <= 0:
                continue
            rho = g.xy[j] - g.xx[j] @ b + g.xx[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - penalty, 0) / g.xx[j, j]
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved < tolerance:
            break
    return b


def hard_threshold(g: Gram, keep: int, rounds: int = 500) -> np.ndarray:
    """Iterative hard thresholding, then least squares on what is kept."""
    step = 1 / max(np.linalg.eigvalsh(g.xx)[-1], 1e-300)
    b = np.zeros(len(g.xy))
    for _ in range(rounds):
        b = b + step * (g.xy - g.xx @ b)
        b[np.argsort(-np.abs(b), kind="stable")[keep:]] = 0
    return _refit(g, np.flatnonzero(b))


def matching_pursuit(g: Gram, keep: int) -> np.ndarray:
    """Greedy: each step adds the predictor most correlated with what is left, then refits."""
    chosen: list[int] = []
    b = np.zeros(len(g.xy))
    scale = np.sqrt(np.maximum(np.diag(g.xx), 1e-300))
    for _ in range(keep):
        left = np.abs(g.xy - g.xx @ b) / scale
        left[chosen] = -1
        chosen.append(int(left.argmax()))
        b = _refit(g, np.array(sorted(chosen)))
    return b


def _refit(g: Gram, at: np.ndarray) -> np.ndarray:
    b = np.zeros(len(g.xy))
    if len(at):
        b[at] = np.linalg.lstsq(g.xx[np.ix_(at, at)], g.xy[at], rcond=None)[0]
    return b


def predict(df: DataFrame, x: str, b: np.ndarray, constant: float, out: str = "prediction") -> DataFrame:
    dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in b]), lambda p, q: p * q), F.lit(float(constant)), lambda s, v: s + v)
    return df.withColumn(out, dot)


def cross_validate(df: DataFrame, x: str, y: str, key: str, fit, folds: int = 5) -> float:
    """Mean squared error on folds dealt by a hash of the key; fit takes a Gram and returns coefficients."""
    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    total, n = 0.0, 0
    for k in range(folds):
        g = gram(df.filter(fold != k), x, y)
        b = fit(g)
        e = predict(df.filter(fold == k), x, b, g.constant(b)).agg(F.sum((F.col(y) - F.col("prediction")) ** 2), F.count(F.lit(1))).first()
        total, n = total + (e[0] or 0.0), n + e[1]
    return total / max(1, n)


def whitener(cov: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """W with W cov W' = I, nearly."""
    w, v = np.linalg.eigh(cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov)))
    return (v / np.sqrt(w)) @ v.T


def whiten(df: DataFrame, values: str = "values") -> DataFrame:
    """Rows minus their mean, times the whitener."""
    _, mean, cov = covariance(df, values)
    w = whitener(cov)
    centred = F.zip_with(values, F.array(*map(F.lit, mean.tolist())), lambda a, m: a - m)
    dot = lambda row: F.aggregate(F.zip_with("_c", F.array(*map(F.lit, row.tolist())), lambda a, q: a * q), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn("_c", centred).withColumn("white", F.array(*[dot(r) for r in w])).drop("_c")


def multi_view(df: DataFrame, views: list[str], share: float = 1.0, rounds: int = 50) -> tuple[list[np.ndarray], float]:
    """Sparse canonical directions of several array columns, which maximise the sum of their scores' covariances after whitening, and the mean correlation."""
    sizes = [df.select(F.size(v)).first()[0] for v in views]
    _, _, cov = covariance(df.select(F.concat(*views).alias("values")))
    at = np.concatenate([[0], np.cumsum(sizes)])
    block = lambda i, j: cov[at[i] : at[i + 1], at[j] : at[j + 1]]
    white = [whitener(block(i, i)) for i in range(len(views))]
    core = {(i, j): white[i] @ block(i, j) @ white[j].T for i in range(len(views)) for j in range(len(views)) if i != j}
    u = [np.linalg.svd(np.hstack([core[i, j] for j in range(len(views)) if j != i]))[0][:, 0] for i in range(len(views))]
    for _ in range(rounds):
        for i in range(len(views)):
            u[i] = _sparse(sum(core[i, j] @ u[j] for j in range(len(views)) if j != i), share)
    pairs = [float(u[i] @ core[i, j] @ u[j]) for i, j in core if i < j]
    return [w.T @ d for w, d in zip(white, u, strict=True)], float(np.mean(pairs))


def partial_cca(df: DataFrame, a: str, b: str, given: str, ridge: float = 1e-6) -> float:
    """The leading canonical correlation of two array columns after a third is regressed out of both."""
    p, q = (df.select(F.size(v)).first()[0] for v in (a, b))
    _, _, cov = covariance(df.select(F.concat(a, b, given).alias("values")))
    m, z = p + q, cov[p + q :, p + q :]
    left = cov[:m, :m] - cov[:m, m:] @ np.linalg.solve(z + ridge * np.trace(z) / len(z) * np.eye(len(z)), cov[m:, :m])
    core = whitener(left[:p, :p], ridge) @ left[:p, p:] @ whitener(left[p:, p:], ridge).T
    return float(np.linalg.svd(core, compute_uv=False)[0])


def permutation_p_value(df: DataFrame, a: str, b: str, key: str, rounds: int, seed: int = 0) -> tuple[float, float]:
    """The leading canonical correlation, and the share of pairings by a seeded hash order that reach it; each pairing is one sort and one aggregation."""
    from pyspark.sql import Window

    from gridloom.operators.models import sparse_cca

    true = sparse_cca(df, a, b)[0]
    hits = 0
    for k in range(rounds):
        # ranks by two hash orders pair the rows; ranks within buckets of the hash keep windows small
        bucket = F.pmod(F.xxhash64(key), F.lit(64))
        rank = lambda s: F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(s), key), key))
        left = df.select(a, key, bucket.alias("_b")).withColumn("_r", rank(seed + 2 * k)).select(a, "_b", "_r")
        right = df.select(b, key, bucket.alias("_b")).withColumn("_r", rank(seed + 2 * k + 1)).select(b, "_b", "_r")
        hits += sparse_cca(left.join(right, ["_b", "_r"]), a, b)[0] >= true
    return true, (hits + 1) / (rounds + 1)


def reconstruction_error(df: DataFrame, components: DataFrame, values: str = "values") -> float:
    """The share of the total variance that the components' span leaves."""
    _, _, cov = covariance(df, values)
    v = np.array([r["loadings"] for r in components.orderBy("component").collect()]).T
    q, _ = np.linalg.qr(v)
    return float(1 - np.trace(q.T @ cov @ q) / np.trace(cov))


def spatial_smooth(loadings: np.ndarray, shape: tuple[int, ...], weight: float = 0.5) -> np.ndarray:
    """A component laid out on its grid, mixed with the mean of its face neighbours."""
    x = loadings.reshape(shape)
    total, count = np.zeros_like(x), np.zeros_like(x)
    for axis in range(x.ndim):
        for d in (-1, 1):
            there = np.ones(shape)
            index = [slice(None)] * x.ndim
            index[axis] = 0 if d == 1 else -1
            there[tuple(index)] = 0
            total += np.roll(x, d, axis) * there
            count += there
    return ((1 - weight) * x + weight * total / np.maximum(count, 1)).ravel()
