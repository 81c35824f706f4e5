"""Sparse decompositions on covariance matrices (see models.covariance): power iterations, hard thresholds, reconstructions, canonical pairs.

Spark sums the covariance over rows; what is left depends on the number of columns only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.matrix import Gram, whitener
from gridloom.operators.models import _signed, _sparse


def unit(v: np.ndarray, cov: np.ndarray | None = None) -> np.ndarray:
    """v of length 1, or with v' cov v = 1."""
    size = np.sqrt(v @ (cov @ v if cov is not None else v))
    return v / size if size > 0 else v


def initial(p: int, seed: int = 0, positive: bool = False) -> np.ndarray:
    v = np.random.default_rng(seed).normal(size=p)
    return unit(np.abs(v) if positive else v)


def pseudo_inverse(m: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """By singular values, those under a share of the greatest left out."""
    u, s, v = np.linalg.svd(m)
    keep = s > tolerance * s[0]
    return (v[keep].T / s[keep]) @ u[:, keep].T


def hard(v: np.ndarray, keep: int, positive: bool = False) -> np.ndarray:
    """Only the ``keep`` entries of greatest size, of equals the first."""
    w = np.maximum(v, 0) if positive else v
    out = np.zeros_like(w)
    at = np.argsort(-np.abs(w), kind="stable")[:keep]
    out[at] = w[at]
    return out


def mass(v: np.ndarray, share: float) -> np.ndarray:
    """The greatest entries that together hold a share of the absolute sum."""
    order = np.argsort(-np.abs(v), kind="stable")
    so_far = np.cumsum(np.abs(v)[order])
    keep = int(np.searchsorted(so_far, share * so_far[-1] - 1e-12) + 1) if so_far[-1] > 0 else 0
    return hard(v, keep)


def clusters(v: np.ndarray, shape: tuple[int, ...], least: int) -> np.ndarray:
    """v laid out on its grid, zeroed in face-connected clusters of fewer than ``least`` nonzero cells."""
    x = v.reshape(shape).copy()
    seen = np.zeros(shape, bool)
    for start in zip(*np.nonzero(x), strict=True):
        if seen[start]:
            continue
        held, todo = [], [start]
        seen[start] = True
        while todo:
            p = todo.pop()
            held.append(p)
            for axis in range(len(shape)):
                for d in (-1, 1):
                    q = (*p[:axis], p[axis] + d, *p[axis + 1 :])
                    if 0 <= q[axis] < shape[axis] and not seen[q] and x[q] != 0:
                        seen[q] = True
                        todo.append(q)
        if len(held) < least:
            x[tuple(np.transpose(held))] = 0
    return x.ravel()


def laplacian(v: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Second differences of a component on its grid; the border repeats its cell."""
    x = np.pad(v.reshape(shape), 1, mode="edge")
    inner = (slice(1, -1),) * len(shape)
    out = np.zeros(shape)
    for axis in range(len(shape)):
        for d in (-1, 1):
            out += np.roll(x, d, axis)[inner] - x[inner]
    return out.ravel()


def gradient_magnitude(v: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    g = np.gradient(v.reshape(shape))
    return np.sqrt(sum(q * q for q in (g if isinstance(g, (list, tuple)) else [g]))).ravel()


def curvature_sparse(v: np.ndarray, shape: tuple[int, ...], share: float, rounds: int = 10, step: float = 0.1) -> np.ndarray:
    """Sparsity by smoothing: each round moves by the Laplacian and then thresholds."""
    for _ in range(rounds):
        v = _sparse(v + step * laplacian(v, shape), share)
    return v


def golden_section(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-10) -> float:
    """Where f is least between a and b."""
    r = (np.sqrt(5) - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = f(d)
    return (a + b) / 2


def energy(cov: np.ndarray, v: np.ndarray) -> float:
    """Minus the share of the variance along v."""
    return -float(v @ cov @ v / max(v @ v, 1e-300))


def power(cov: np.ndarray, rounds: int = 100, v: np.ndarray | None = None) -> np.ndarray:
    v = unit(cov @ np.ones(len(cov))) if v is None else v
    for _ in range(rounds):
        v = unit(cov @ v)
    return v


def power_sparse(cov: np.ndarray, keep: int, rounds: int = 50, prior: np.ndarray | None = None, pull: float = 0.0, positive: bool = False) -> np.ndarray:
    """Power iterations with a hard threshold; prior pulls each step towards a given direction."""
    v = _signed(np.linalg.eigh(cov)[1][:, -1:])[:, 0] if prior is None else unit(prior)
    for _ in range(rounds):
        w = unit(cov @ v)
        if prior is not None:
            w = unit((1 - pull) * w + pull * unit(prior))
        v = unit(hard(w, keep, positive))
    return v


def conjugate(cov: np.ndarray, share: float = 1.0, rounds: int = 60, v: np.ndarray | None = None, precondition: bool = False) -> np.ndarray:
    """The leading direction by nonlinear conjugate gradients on the energy with a line search, thresholded each round."""
    v = unit(cov @ np.ones(len(cov))) if v is None else unit(v)
    scale = 1 / np.maximum(np.diag(cov), 1e-12) if precondition else np.ones(len(cov))
    before, d = None, None
    for _ in range(rounds):
        g = 2 * (cov @ v - (v @ cov @ v) * v) * scale
        if np.linalg.norm(g) < 1e-14:
            break
        beta = max(0.0, float(g @ (g - before) / (before @ before))) if before is not None else 0.0
        d = g if d is None or beta == 0 else g + beta * d
        step = golden_section(lambda t, d=d, v=v: energy(cov, _sparse(v + t * d, share)), 0.0, 2 / max(np.trace(cov), 1e-300) * len(cov), 1e-6)
        new = _sparse(v + step * d, share)
        if energy(cov, new) > energy(cov, v):
            break
        before, v = g, new
    return v


def deflated(cov: np.ndarray, k: int, one: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """k directions (columns) found one after the other, each taken out of the covariance, and their variances."""
    now, rows, variances = cov.copy(), [], []
    for _ in range(k):
        v = one(now)
        w = float(v @ now @ v)
        rows.append(v)
        variances.append(w)
        now = now - w * np.outer(v, v)
    return np.array(rows).T, np.array(variances)


def greedy(cov: np.ndarray, keep: int) -> np.ndarray:
    """The direction on ``keep`` columns that are added one by one for the greatest variance."""
    chosen: list[int] = []
    for _ in range(keep):
        tops = [(-np.inf if j in chosen else np.linalg.eigvalsh(cov[np.ix_([*chosen, j], [*chosen, j])])[-1], -j) for j in range(len(cov))]
        chosen.append(-max(tops)[1])
    v = np.zeros(len(cov))
    v[chosen] = np.linalg.eigh(cov[np.ix_(chosen, chosen)])[1][:, -1]
    return _signed(v[:, None])[:, 0]


def explained(cov: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Variances of correlated components, each less what those before it explain."""
    _, r = np.linalg.qr(np.linalg.cholesky(cov + 1e-12 * np.trace(cov) * np.eye(len(cov))).T @ v)
    return np.diag(r) ** 2


def sorted_components(cov: np.ndarray, v: np.ndarray) -> np.ndarray:
    return v[:, np.argsort(-np.einsum("ij,ik,kj->j", v, cov, v), kind="stable")]


def reconstruct(cov: np.ndarray, k: int, share: float = 1.0, rounds: int = 50, prior: np.ndarray | None = None, pull: float = 0.5) -> tuple[np.ndarray, np.ndarray, float]:
    """(directions, weights, left): X is rebuilt as X V W; in turn W by least squares and V by a thresholded gradient step, or pulled to a prior's columns. left: the share of the variance not rebuilt."""
    p = len(cov)
    v = _signed(np.linalg.eigh(cov)[1][:, ::-1][:, :k]) if prior is None else np.array([unit(c) for c in prior.T]).T
    total = np.trace(cov)
    weights = lambda v: pseudo_inverse(v.T @ cov @ v) @ v.T @ cov
    left = lambda v, w: float(np.trace((np.eye(p) - v @ w).T @ cov @ (np.eye(p) - v @ w)) / total)
    w = weights(v)
    best = (v, w, left(v, w))
    step = 1 / max(np.linalg.eigvalsh(cov)[-1], 1e-300)
    for _ in range(rounds):
        v = v + step * (cov @ (np.eye(p) - v @ w) @ w.T) / max(np.linalg.norm(w, 2) ** 2, 1e-300)
        if prior is not None:
            v = (1 - pull) * v + pull * prior / np.maximum(np.linalg.norm(prior, axis=0), 1e-300)
        v = np.array([_sparse(c, share) for c in v.T]).T
        w = weights(v)
        now = left(v, w)
        if now >= best[2] - 1e-12 and share >= 1:
            break
        if now < best[2] or share < 1:
            best = (v, w, now)
    return best


def canonical(cov: np.ndarray, p: int, k: int = 1, keep: tuple[int, int] | None = None, rounds: int = 50, given: int = 0) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """k pairs (correlation, x, y) of the first p columns with the next; keep: hard thresholds of the whitened directions; the last ``given`` columns are regressed out of both first."""
    if given:
        m = len(cov) - given
        z = cov[m:, m:]
        cov = cov[:m, :m] - cov[:m, m:] @ np.linalg.solve(z + 1e-9 * np.trace(z) * np.eye(given), cov[m:, :m])
    wx, wy = whitener(cov[:p, :p]), whitener(cov[p:, p:])
    core, out = wx @ cov[:p, p:] @ wy.T, []
    for _ in range(k):
        u = _signed(np.linalg.svd(core)[0][:, :1])[:, 0]
        v = unit(core.T @ u)
        for _ in range(rounds if keep else 0):
            v = unit(hard(core.T @ u, keep[1]))
            u = unit(hard(core @ v, keep[0]))
        r = float(u @ core @ v)
        out.append((r, wx.T @ u, wy.T @ v))
        core = core - r * np.outer(u, v)
    return out


def network(g: Gram, k: int, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(directions, coefficients, mean squared error): sparse directions of the predictors that follow the response, each from what those before left, refitted together."""
    rows: list[np.ndarray] = []
    left = g.xy.copy()
    b = np.zeros(0)
    for _ in range(k):
        rows.append(_sparse(left, share))
        v = np.array(rows).T
        b = pseudo_inverse(v.T @ g.xx @ v) @ v.T @ g.xy
        left = g.xy - g.xx @ v @ b
        if np.linalg.norm(left) < 1e-12:
            break
    v = np.array(rows).T
    return v, b, g.error(v @ b)


def random_field(loadings: np.ndarray, shape: tuple[int, ...], smoothing: float = 1.0, rounds: int = 5) -> np.ndarray:
    """Of components over a grid (cells by components) the number, from 1, of each cell's component, smoothed by its neighbours' (0 where all are 0)."""
    k = loadings.shape[1]
    like = np.abs(loadings) / np.maximum(np.abs(loadings).sum(1, keepdims=True), 1e-300)
    post = like.copy()
    for _ in range(rounds):
        near = np.stack([laplacian(post[:, c], shape) + 2 * len(shape) * post[:, c] for c in range(k)], axis=1) / (2 * len(shape))
        post = like * np.exp(smoothing * near)
        post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
    return np.where(np.abs(loadings).sum(1) > 0, post.argmax(1) + 1, 0)


def diagnostics(df: DataFrame, score: str, columns: list[str]) -> DataFrame:
    """(name, r): the correlation of a component's scores with other columns; one aggregation."""
    got = df.agg(*[F.corr(score, c).alias(c) for c in columns])
    return got.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("r")) for c in columns])).alias("x")).select("x.*")


def without_row(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) != value)
