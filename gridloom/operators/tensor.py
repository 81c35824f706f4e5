"""Diffusion tensors as arrays xx, xy, xz, yy, yz, zz.

Measures that need eigenvectors run over Arrow batches of tensors at once; those with a closed form
stay projections. Purely diagonal tensors give 0 for single-eigenvalue measures.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())  # a type, not its name: workers import this module without a session
COMPONENTS = ("xx", "xy", "xz", "yy", "yz", "zz")


def component(t: str | Column, name: str) -> Column:
    return (F.col(t) if isinstance(t, str) else t)[COMPONENTS.index(name)]


def from_components(*columns: str) -> Column:
    return F.array(*columns)


def mean_diffusion(t: str) -> Column:
    """A third of the trace; not-a-number is 0."""
    return F.coalesce(F.nanvl((F.col(t)[0] + F.col(t)[3] + F.col(t)[5]) / 3, F.lit(0.0)), F.lit(0.0))


def eigenvalues(t: str) -> Column:
    """The three eigenvalues of a symmetric 3 x 3 tensor, ascending, in closed form."""
    a, b, c, d, e, f = (F.col(t)[i] for i in range(6))
    q = (a + d + f) / 3
    p1 = b**2 + c**2 + e**2
    p = F.sqrt(((a - q) ** 2 + (d - q) ** 2 + (f - q) ** 2 + 2 * p1) / 6)
    det = (a - q) * ((d - q) * (f - q) - e**2) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(p > 0, det / p**3 / 2).otherwise(0.0)))) / 3
    high, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2.0943951023931953)
    return F.array(low, 3 * q - high - low, high)


def is_diagonal(t: str) -> Column:
    return (F.col(t)[1] == 0) & (F.col(t)[2] == 0) & (F.col(t)[4] == 0)


def with_eigenvalues(df: DataFrame, t: str = "t") -> DataFrame:
    """Adds e0, e1, e2, ascending."""
    out = df.withColumn("_e", eigenvalues(t))
    return out.withColumns({f"e{k}": F.col("_e")[k] for k in range(3)}).drop("_e")


def eigenvalue(df: DataFrame, k: int, t: str = "t") -> DataFrame:
    return with_eigenvalues(df, t).withColumn("out", F.when(is_diagonal(t), 0.0).otherwise(F.col(f"e{k}"))).drop("e0", "e1", "e2")


def axial(df: DataFrame, t: str = "t") -> DataFrame:
    return eigenvalue(df, 2, t)


def radial(df: DataFrame, t: str = "t") -> DataFrame:
    return with_eigenvalues(df, t).withColumn("out", F.when(is_diagonal(t), 0.0).otherwise((F.col("e0") + F.col("e1")) / 2)).drop("e0", "e1", "e2")


def fa(df: DataFrame, t: str = "t") -> DataFrame:
    """Fractional anisotropy fa with its numerator and denominator; a negative smallest or greatest eigenvalue counts as the middle one, a trace near 0 gives 0."""
    e = with_eigenvalues(df, t)
    lo, mid, hi = F.when(F.col("e0") < 0, F.col("e1")).otherwise(F.col("e0")), F.col("e1"), F.when(F.col("e2") < 0, F.col("e1")).otherwise(F.col("e2"))
    m = (lo + mid + hi) / 3
    num = F.sqrt((lo - m) ** 2 + (mid - m) ** 2 + (hi - m) ** 2)
    den = F.sqrt(lo**2 + mid**2 + hi**2)
    trace = F.abs(F.col("e0") + F.col("e1") + F.col("e2"))
    return e.withColumns({"numerator": num, "denominator": den, "fa": F.when((trace > 1e-9) & (den > 0), F.sqrt(F.lit(1.5)) * num / den).otherwise(0.0)}).drop("e0", "e1", "e2")


def reflect(t: str, det: float) -> Column:
    """Component order kept; where the direction's determinant is positive, x is reflected: xy and xz change sign."""
    x = F.col(t)
    return F.array(x[0], -x[1], -x[2], x[3], x[4], x[5]) if det > 0 else x


def from_volumes(df: DataFrame, v: str = "v") -> DataFrame:
    """(axes, t): tensors of a series of six component volumes, or of seven, whose first is left out."""
    cells = [a for a in ("x", "y", "z") if a in df.columns]
    got = df.groupBy(*cells).agg(F.array_sort(F.collect_list(F.struct("t", F.col(v).cast("double").alias("v")))).alias("a"))  # six or seven values
    return got.select(*cells, F.slice(F.col("a.v"), F.size("a") - 5, 6).alias("t"))


def to_volumes(df: DataFrame, t: str = "t") -> DataFrame:
    """(the other columns, t, v): six component volumes."""
    rest = [c for c in df.columns if c != t]
    return df.select(*rest, F.posexplode(t).alias("t", "v")).withColumn("t", F.col("t").cast("bigint"))


def valid(df: DataFrame, t: str = "t") -> DataFrame:
    """Adds valid: whether the tensor is finite and its eigenvalues are positive."""
    finite = F.forall(t, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return with_eigenvalues(df, t).withColumn("valid", F.coalesce(finite & (F.col("e0") > 0), F.lit(False))).drop("e0", "e1", "e2")


def mask(df: DataFrame, m: str, t: str = "t", isotropic: float | None = None) -> DataFrame:
    background = [isotropic or 0.0 if i in (0, 3, 5) else 0.0 for i in range(6)]
    return df.withColumn("out", F.when(F.col(m) > 0, F.col(t)).otherwise(F.array(*map(F.lit, background))))


def _matrices(series: pd.Series):
    import numpy as np

    t = np.stack([np.asarray(x, float) for x in series])
    return t[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)


def _flat(m):
    return pd.Series(list(m[:, [0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2]]))


@F.pandas_udf(VECTOR)
def principal_direction(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The eigenvector of the greatest eigenvalue, its greatest entry positive."""
    import numpy as np

    for s in batches:
        _, vectors = np.linalg.eigh(_matrices(s))
        v = vectors[:, :, 2]
        sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])
        yield pd.Series(list(v * np.where(sign == 0, 1, sign)[:, None]))


@F.pandas_udf(VECTOR)
def log_tensor(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The matrix logarithm, eigenvalues floored at 1e-12."""
    import numpy as np

    for s in batches:
        w, v = np.linalg.eigh(_matrices(s))
        yield _flat(np.einsum("nij,nj,nkj->nik", v, np.log(np.maximum(w, 1e-12)), v))


@F.pandas_udf(VECTOR)
def exp_tensor(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import numpy as np

    for s in batches:
        w, v = np.linalg.eigh(_matrices(s))
        yield _flat(np.einsum("nij,nj,nkj->nik", v, np.exp(w), v))


def rotate(df: DataFrame, rotation: list[list[float]], t: str = "t") -> DataFrame:
    """R T R' with a constant rotation, as a projection."""
    x = F.col(t)
    index = [[0, 1, 2], [1, 3, 4], [2, 4, 5]]
    entry = lambda i, j: sum((F.lit(float(rotation[i][k] * rotation[j][m])) * x[index[k][m]] for k in range(3) for m in range(3)), F.lit(0.0))
    return df.withColumn("out", F.array(*[entry(i, j) for i in range(3) for j in range(i, 3)]))


def average_log_euclidean(df: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """Per group the exponential of the mean logarithm of the tensors."""
    logs = df.withColumn("_l", log_tensor(t)).groupBy(*by).agg(*[F.avg(F.col("_l")[i]).alias(f"_{i}") for i in range(6)])
    return logs.select(*by, exp_tensor(F.array(*[f"_{i}" for i in range(6)])).alias(t))


def smooth(df: DataFrame, sigma: float, t: str = "t") -> DataFrame:
    """Gaussian smoothing of the tensors' logarithms."""
    from gridloom.grid import axes_of, scattered
    from gridloom.operators.neighborhood import _kernel

    axes = [a for a in axes_of(df) if a != t]
    out = df.select(*axes, log_tensor(t).alias("_l"))
    for a in axes:
        weights = _kernel(sigma)
        offsets = [tuple(d if b == a else 0 for b in axes) for d, _ in weights]
        rows = scattered(out, offsets, axes, {"_k": [w for _, w in weights]})
        mixed = F.array(*[F.sum(F.col("_l")[i] * F.col("_k")) / F.sum("_k") for i in range(6)])
        out = rows.groupBy(*axes).agg(mixed.alias("_l"), F.max("_self").alias("_in")).filter("_in").drop("_in")
    return out.select(*axes, exp_tensor("_l").alias(t))


@F.pandas_udf(VECTOR)
def reorient(tensors: pd.Series, jacobians: pd.Series) -> pd.Series:
    """Tensors turned so that the principal direction goes where a map's jacobian (row-major) takes it, and the second as near as can be; their eigenvalues stay."""
    import numpy as np

    w, v = np.linalg.eigh(_matrices(tensors))
    j = np.stack([np.asarray(x, float) for x in jacobians]).reshape(-1, 3, 3)
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    first = unit(np.einsum("nij,nj->ni", j, v[:, :, 2]))
    second = np.einsum("nij,nj->ni", j, v[:, :, 1])
    second = unit(second - first * np.sum(first * second, 1, keepdims=True))
    turned = np.stack([np.cross(first, second), second, first], axis=2)
    return _flat(np.einsum("nij,nj,nkj->nik", turned, w, turned))


def rotation_between(a: str, b: str) -> Column:
    """The rotation (nine numbers, row-major) that turns one vector's direction into another's by the shorter way; opposite ones turn about an axis at right angles."""
    size = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, q: s + q * q))
    p, q = [F.col(a)[i] / size(a) for i in range(3)], [F.col(b)[i] / size(b) for i in range(3)]
    k = [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    c = sum((x * y for x, y in zip(p, q, strict=True)), F.lit(0.0))
    cross = [[F.lit(0.0), -k[2], k[1]], [k[2], F.lit(0.0), -k[0]], [-k[1], k[0], F.lit(0.0)]]
    square = lambda i, j: k[i] * k[j] - (k[0] ** 2 + k[1] ** 2 + k[2] ** 2 if i == j else 0)
    turn = [F.lit(float(i == j)) + cross[i][j] + square(i, j) / (1 + c) for i in range(3) for j in range(3)]
    # a half turn about the axis across p in the plane of its two smaller entries
    alone = F.abs(p[0]) < 0.9
    m = [F.when(alone, 1.0 if i == 0 else 0.0).otherwise(1.0 if i == 1 else 0.0) for i in range(3)]
    dot = sum((x * y for x, y in zip(m, p, strict=True)), F.lit(0.0))
    n = [x - dot * y for x, y in zip(m, p, strict=True)]
    n2 = n[0] ** 2 + n[1] ** 2 + n[2] ** 2
    half = [2 * n[i] * n[j] / n2 - float(i == j) for i in range(3) for j in range(3)]
    return F.when(c < -1 + 1e-12, F.array(*half)).otherwise(F.array(*turn))


def color(df: DataFrame, t: str = "t") -> DataFrame:
    """r, g, b: |principal direction| times anisotropy times 255, as integers; 0 for diagonal tensors."""
    out = fa(df, t).withColumn("_v", principal_direction(t))
    byte = lambda i: F.when(is_diagonal(t), 0).otherwise(F.floor(F.abs(F.col("_v")[i]) * F.col("fa") * 255)).cast("bigint")
    return out.withColumns({c: byte(i) for i, c in enumerate("rgb")}).drop("_v", "numerator", "denominator")


def strain(df: DataFrame, mode: str = "l") -> DataFrame:
    """Strain of a 2-D displacement field ux, uy by central differences: d (deformation gradient F), l (Lagrangian, (F'F - I) / 2), e (Eulerian, (I - (F F')^-1) / 2), rc (F'F), lc (F F'); columns a, b, c, d row-major."""
    from gridloom.operators.neighborhood import central_differences

    g = df
    for u in ("ux", "uy"):
        d = central_differences(df.select("x", "y", F.col(u).alias("v"))).select("x", "y", F.col("gx").alias(f"{u}_x"), F.col("gy").alias(f"{u}_y"))
        g = g.join(d, ["x", "y"])
    a, b, c, d = 1 + F.col("ux_x"), F.col("ux_y"), F.col("uy_x"), 1 + F.col("uy_y")
    right, left = (a * a + c * c, a * b + c * d, b * b + d * d), (a * a + b * b, a * c + b * d, c * c + d * d)
    if mode == "d":
        out = (a, b, c, d)
    elif mode in ("rc", "lc"):
        m = right if mode == "rc" else left
        out = (m[0], m[1], m[1], m[2])
    elif mode == "l":
        out = ((right[0] - 1) / 2, right[1] / 2, right[1] / 2, (right[2] - 1) / 2)
    else:
        det = left[0] * left[2] - left[1] ** 2
        out = ((1 - left[2] / det) / 2, left[1] / det / 2, left[1] / det / 2, (1 - left[0] / det) / 2)
    return g.select("x", "y", *[m.alias(n) for m, n in zip(out, "abcd", strict=True)])
