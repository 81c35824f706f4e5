"""Whitening of embeddings: leading eigenvectors of a covariance that is never formed.

Entries become whole numbers, x = floor(1024 * c) + 100000, so that sums are exact. One Spark pass gives
the count, the sums and the total of squares; each further pass computes X'(XQ) on the centred
rows for a block Q of directions, summed in every partition before anything is shuffled. On the driver
stand only the number of columns times WIDTH directions: the block is made orthogonal to the directions
of earlier passes (QR), Rayleigh-Ritz takes the best vectors of all of them, and the residuals of those give the
next block; beyond WIDTH directions the best are kept. A last pass on the vectors found alone certifies their
true residuals.

Edge cases: a null vector, or one with a null, NaN or infinite entry or an entry of 2^43 or more, is
dropped, as is a vector whose length isn't the most frequent one (of equals the greater); a null key
stays null; repeated rows count each; directions without variance give no components, so that equal
vectors, a single one or an empty table give no rows; a deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, SHIFT, LARGEST = 1024, 100000, 2.0**43
#: Directions a pass, and directions held on the driver before the best are kept.
BLOCK, WIDTH = 16, 96
#: Residuals that certify, relative to the greatest eigenvalue; the second where rounding stops the first.
CERTIFIED, ROUNDED = 1e-13, 1e-11
#: Passes without a halved residual after which rounding is taken to be the limit.
STALLED = 6
MAX_PASSES = 2000
_SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def explained(self) -> np.ndarray:
        return self.values / self.trace


def _block(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of d entries, and their whole numbers."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), d), False)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    m = pc.list_flatten(column.filter(right)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    good = (np.abs(m) < LARGEST).all(axis=1)
    return at[good], np.floor(SCALE * m[good]).astype(np.int64) + SHIFT


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact; as Python numbers where 64 bits might not hold them."""
    if x.size == 0 or n * int(np.abs(x).max()) < _SAFE and max(map(abs, sums)) < _SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.col(vector).cast("array<double>").alias("v"))


def _length(df: DataFrame, vector: str) -> int:
    top = df.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def moments(df: DataFrame, vector: str, d: int) -> tuple[int, list[int], int]:
    """Number of usable vectors, sum of each entry, and the sum of all squares; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 2)
        for b in batches:
            _, x = _block(b.column("v"), d)
            if len(x) == 0:
                continue
            most = int(np.abs(x).max())
            one = x if most * len(x) < _SAFE else x.astype(object)
            two = x if most * most * x.size < _SAFE else x.astype(object)
            for i, s in enumerate([*one.sum(axis=0).tolist(), len(x), int((two * two).sum())]):
                total[i] += int(s)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 2), pa.int32()), pa.array([str(t) for t in total])], ["i", "s"])

    parts = _vectors(df, vector).mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = {r["i"]: int(r["s"]) for r in parts.collect()}
    return got.get(d, 0), [got.get(i, 0) for i in range(d)], got.get(d + 1, 0)


def product(df: DataFrame, vector: str, n: int, sums: list[int], q: np.ndarray) -> np.ndarray:
    """The covariance times the columns of q, in one pass."""
    d, width = q.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, width))
        for b in batches:
            _, x = _block(b.column("v"), d)
            c = _deviations(x, n, sums).astype(np.float64) / n
            total += c.T @ (c @ q)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), *(pa.array(total[:, j]) for j in range(width))], ["i", *(f"c{j}" for j in range(width))])

    schema = "i int, " + ", ".join(f"c{j} double" for j in range(width))
    rows = _vectors(df, vector).mapInArrow(run, schema).groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)]).collect()
    out = np.zeros((d, width))
    for r in rows:
        out[r["i"]] = r[1:]
    return out / n


def _ritz(q: np.ndarray, aq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of the covariance seen from q, falling."""
    t = q.T @ aq
    values, y = np.linalg.eigh((t + t.T) / 2)
    return values[::-1], y[:, ::-1]


def _fresh(block: np.ndarray, q: np.ndarray, noise: np.random.Generator) -> np.ndarray:
    """Unit directions of block orthogonal to q and each other; those that vanish are replaced by random ones."""
    d, room = block.shape[0], min(block.shape[1], block.shape[0] - q.shape[1])
    size = np.linalg.norm(block, axis=0)
    block = np.where(size > 0, block / np.where(size > 0, size, 1), 0)[:, :room]
    for _ in range(3):
        block = block - q @ (q.T @ block)
        weak = np.linalg.norm(block, axis=0) < 1e-8
        block[:, weak] = noise.standard_normal((d, int(weak.sum())))
        block = block - q @ (q.T @ block)
        block, r = np.linalg.qr(block)
        weak = np.abs(np.diag(r)) < 1e-8
        block[:, weak] = noise.standard_normal((d, int(weak.sum())))
    block = block - q @ (q.T @ block)
    return np.linalg.qr(block)[0]


def subspace(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, int]:
    """The k greatest eigenvalues, falling, their unit eigenvectors, and the passes taken; ``apply`` is a pass."""
    noise, k = np.random.default_rng(7), min(k, d)
    block = max(block, k)
    q = aq = np.zeros((d, 0))
    new, best, since = _fresh(noise.standard_normal((d, block)), q, noise), np.inf, 0
    for passes in range(1, MAX_PASSES):
        q, aq = np.hstack([q, new]), np.hstack([aq, apply(new)])
        values, y = _ritz(q, aq)
        keep = min(block + k, q.shape[1])
        x, ax = q @ y[:, :keep], aq @ y[:, :keep]
        left = ax - x * values[:keep]
        top, size = max(values[0], np.finfo(float).tiny), np.linalg.norm(left, axis=0)
        worst = size[:k].max() / top
        best, since = (worst, 0) if worst < best / 2 else (best, since + 1)
        full = q.shape[1] == d
        if full or worst < CERTIFIED or (worst < ROUNDED and since >= STALLED):
            # the certifying pass: the residuals of the k vectors alone
            found = np.linalg.qr(x[:, :k])[0]
            image = apply(found)
            values, turn = _ritz(found, image)
            found, image = found @ turn, image @ turn
            if np.linalg.norm(image - found * values, axis=0).max() / top < ROUNDED:
                return values, found, passes + 1
        if full:
            q, aq, left = np.zeros((d, 0)), np.zeros((d, 0)), x
        elif q.shape[1] + block > max(width, keep + block):
            q, r = np.linalg.qr(x)
            aq = ax @ np.linalg.inv(r)
        new = _fresh(left[:, :block], q, noise)
    raise RuntimeError(f"residuals of {best:g} after {MAX_PASSES} passes")


def fit(df: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> Whitening | None:
    """The mean and the leading components of the usable vectors; None without variance."""
    d = _length(df, vector)
    n, sums, squares = moments(df, vector, d) if d else (0, [], 0)
    spread = n * squares - sum(s * s for s in sums)
    if spread <= 0:
        return None
    values, vectors, passes = subspace(lambda q: product(df, vector, n, sums, q), d, k)
    kept = values > values[0] * d * 1e-14
    vectors = vectors[:, kept]
    turn = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitening(n, sums, vectors * turn, values[kept], spread / (n * n), passes)


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, in one pass."""
    n, sums, p = model.n, model.sums, model.vectors / np.sqrt(model.values)
    d, k = p.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            w = _deviations(_block(b.column("v"), d)[1], n, sums).astype(np.float64) / n @ p
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) * k), pa.int32()), pa.array(total.ravel())], ["i", "s"])

    rows = _vectors(df, vector).mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((k + 1) * k)
    for r in rows:
        total[r["i"]] = r["s"]
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def transform(df: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    n, sums, p, share = model.n, model.sums, model.vectors / np.sqrt(model.values), model.explained()
    error, (d, k) = identity_error(df, model, vector), p.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _block(b.column("v"), d)
            far = _deviations(x, n, sums)
            wide = far.dtype == object or (len(far) and d * int(np.abs(far).max()) ** 2 >= _SAFE)
            square = (far.astype(object) ** 2).sum(axis=1) if wide else (far * far).sum(axis=1)
            deviation = pa.array([int(s) if s < 1 << 63 else None for s in square], pa.int64()) if wide else pa.array(square)
            each, row = np.tile(np.arange(k), len(at)), np.repeat(np.arange(len(at)), k)
            keys = b.column("key").take(pa.array(at[row]))
            whitened = (far.astype(np.float64) / n @ p).ravel()
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(each + 1, pa.int32()), pa.array(np.full(len(row), n)), deviation.take(pa.array(row)), pa.array(whitened), pa.array(share[each]), pa.array(np.full(len(row), error))],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    return transform(df, fit(df, vector, k), key, vector)
