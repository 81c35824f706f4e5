"""Decompositions, mixtures, fusion, denoising, bias correction and alignment.

Spark reduces the cells to statistics whose size depends on columns, classes or parameters, never on
cells; small dense algebra runs on those on the driver, or per cell in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import axes_of, box, faces, scattered, unbroadcast
from gridloom.operators import transforms
from gridloom.plans.lineage import checkpointed

#: Columns of a matrix whose moments may come to the driver (columns squared values).
MAX_COLUMNS = 2000


def moments(df: DataFrame, values: str = "values") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, column sums and the matrix of products of an array column, summed in Arrow batches and then over partitions."""
    p = df.select(F.max(F.size(values))).first()[0] or 0
    if p > MAX_COLUMNS:
        raise ValueError(f"{p} columns; at most {MAX_COLUMNS} have their moments on the driver")

    def part(batches):
        out = np.zeros((p + 2, p))
        for b in batches:
            if len(b):
                x = np.stack([np.asarray(v, float) for v in b["values"]])
                out[0, 0] += len(x)
                out[1] += x.sum(0)
                out[2:] += x.T @ x
        yield pd.DataFrame({"sums": [out.tobytes()]})

    def together(batches):
        out = np.zeros((p + 2, p))
        for b in batches:
            for s in b["sums"]:
                out += np.frombuffer(s).reshape(p + 2, p)
        yield pd.DataFrame({"sums": [out.tobytes()]})

    # one array a partition; sixteen tasks add them up as they stream by, so the driver holds a few at a time
    rows = df.select(F.col(values).cast("array<double>").alias("values")).mapInPandas(part, "sums binary").repartition(16).mapInPandas(together, "sums binary")
    out = sum((np.frombuffer(r["sums"]).reshape(p + 2, p) for r in rows.toLocalIterator()), np.zeros((p + 2, p)))
    return int(out[0, 0]) if p else 0, out[1], out[2:]


def covariance(df: DataFrame, values: str = "values") -> tuple[int, np.ndarray, np.ndarray]:
    n, total, outer = moments(df, values)
    mean = total / max(n, 1)
    return n, mean, outer / max(n, 1) - np.outer(mean, mean)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their greatest entry positive."""
    return vectors * np.where(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])] < 0, -1, 1)


def principal_components(df: DataFrame, k: int, values: str = "values") -> DataFrame:
    """(component, variance, loadings) of the leading k."""
    _, _, cov = covariance(df, values)
    w, v = np.linalg.eigh(cov)
    v = _signed(v[:, ::-1][:, :k])
    return df.sparkSession.createDataFrame([(i, float(w[::-1][i]), v[:, i].tolist()) for i in range(v.shape[1])], "component int, variance double, loadings array<double>")


def project(df: DataFrame, components: DataFrame, values: str = "values") -> DataFrame:
    """Adds scores, the products of each row with the loadings; the components are a bounded table."""
    rows = [r["loadings"] for r in components.orderBy("component").collect()]
    dot = lambda load: F.aggregate(F.zip_with(values, F.array(*map(F.lit, load)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("scores", F.array(*[dot(r) for r in rows]))


def _sparse(v: np.ndarray, share: float) -> np.ndarray:
    """Soft-thresholded so that about a share of the entries stays; of length 1."""
    keep = max(1, round(share * len(v)))
    cut = np.sort(np.abs(v))[::-1][keep] if keep < len(v) else 0.0
    out = np.sign(v) * np.maximum(np.abs(v) - cut, 0)
    size = np.linalg.norm(out)
    return out / size if size else out


def sparse_svd(df: DataFrame, k: int, share: float, rounds: int = 50, values: str = "values") -> DataFrame:
    """Sparse leading components by thresholded power iterations with deflation."""
    _, _, cov = covariance(df, values)
    rows = []
    for i in range(k):
        v = _signed(np.linalg.eigh(cov)[1][:, -1:])[:, 0]
        for _ in range(rounds):
            v = _sparse(cov @ v, share)
        w = float(v @ cov @ v)
        rows.append((i, w, v.tolist()))
        cov = cov - w * np.outer(v, v)
    return df.sparkSession.createDataFrame(rows, "component int, variance double, loadings array<double>")


def sparse_cca(df: DataFrame, a: str, b: str, share: float = 1.0, rounds: int = 20) -> tuple[float, np.ndarray, np.ndarray]:
    """The leading pair of sparse canonical directions of two array columns and their correlation."""
    p = df.select(F.size(a)).first()[0]
    _, _, cov = covariance(df.select(F.concat(a, b).alias("values")))
    xx, xy, yy = cov[:p, :p], cov[:p, p:], cov[p:, p:]
    whiten = lambda m: np.linalg.inv(np.linalg.cholesky(m + 1e-6 * np.trace(m) / len(m) * np.eye(len(m))))
    wx, wy = whiten(xx), whiten(yy)
    core = wx @ xy @ wy.T
    u = _signed(np.linalg.svd(core)[0][:, :1])[:, 0]
    v = core.T @ u
    for _ in range(rounds):
        v = _sparse(core.T @ u, share)
        u = _sparse(core @ v, share)
    x, y = wx.T @ u, wy.T @ v
    r = float(x @ xy @ y / math.sqrt(max(1e-300, (x @ xx @ x) * (y @ yy @ y))))
    return r, x, y


def ridge(df: DataFrame, a: str, y: str, penalty: float = 0.0) -> np.ndarray:
    """Coefficients, the last for the constant, of a regression on an array column."""
    n, total, outer = moments(df.select(F.concat(a, F.array(F.lit(1.0)), F.array(F.col(y).cast("double"))).alias("values")))
    del n, total
    q = len(outer) - 1
    return np.linalg.solve(outer[:q, :q] + penalty * np.diag([1.0] * (q - 1) + [0.0]), outer[:q, q])


def mixture(df: DataFrame, k: int, rounds: int = 5, smooth: float = 0.0, v: str = "v") -> tuple[DataFrame, list[tuple[float, float, float]]]:
    """Gaussian mixture segmentation with a Markov random field: (axes, label, p) and (weight, mean, sd) of the classes.

    A round is one projection, one aggregation by class, and with smooth one neighbourhood sum of
    the face neighbours' labels; classes start from evenly spaced means.
    """
    axes = axes_of(df)
    base = df.select(*axes, F.col(v).cast("double").alias("v"))
    lo, hi, sd = base.agg(F.min("v"), F.max("v"), F.stddev_pop("v")).first()
    classes = [(1.0 / k, lo + (hi - lo) * (i + 1) / (k + 1), sd / k) for i in range(k)]
    fields = None

    def posterior(fields: DataFrame | None) -> DataFrame:
        x = F.col("v")
        like = [F.lit(w) * F.exp(-((x - m) ** 2) / (2 * s * s)) / s for w, m, s in classes]
        rows = base
        if fields is not None:
            rows = base.join(fields, axes)
            like = [q * F.exp(smooth * F.col("near")[i]) for i, q in enumerate(like)]
        total = sum(like, F.lit(0.0))
        return rows.select(*axes, "v", F.array(*[F.when(total > 0, q / total).otherwise(1.0 / k) for q in like]).alias("p"))

    for _ in range(rounds):
        post = checkpointed(posterior(fields)) if smooth else posterior(fields)
        sums = post.agg(*[f.alias(f"{n}{i}") for i in range(k) for n, f in (("w", F.sum(F.col("p")[i])), ("m", F.sum(F.col("p")[i] * F.col("v"))), ("s", F.sum(F.col("p")[i] * F.col("v") ** 2)))], F.count(F.lit(1)).alias("n")).first()
        new = []
        for i in range(k):
            w = max(sums[f"w{i}"], 1e-9)
            m = sums[f"m{i}"] / w
            new.append((w / sums["n"], m, math.sqrt(max(sums[f"s{i}"] / w - m * m, 1e-6 * sd * sd))))
        classes = new
        if smooth:
            near = scattered(post.select(*axes, F.col("p").alias("_p")), faces(axes), axes).groupBy(*axes).agg(*[F.sum(F.col("_p")[i]).alias(f"_{i}") for i in range(k)])
            full = post.select(*axes).join(near, axes, "left").select(*axes, F.array(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in range(k)]).alias("near"))
            fields = checkpointed(full)
    out = posterior(fields)
    return out.select(*axes, F.array_position("p", F.array_max("p")).cast("bigint").alias("label"), F.array_max("p").alias("p")), classes


def joint_fusion(target: DataFrame, atlases: DataFrame, radius: int = 1, alpha: float = 0.1, beta: float = 2.0) -> DataFrame:
    """Labels by joint fusion: weights solve (M^beta + alpha I) w = 1 with M the patch error products of pairs of atlases; target: v; atlases: image, v, label."""
    axes = axes_of(target)
    names = sorted(r[0] for r in atlases.select("image").distinct().collect())
    n = len(names)
    err = atlases.join(target.select(*axes, F.col("v").alias("_t")), axes).groupBy(*axes).agg(F.array_sort(F.collect_list(F.struct("image", F.abs(F.col("v") - F.col("_t")).alias("e"), "label"))).alias("a"))
    products = [F.sum(F.col("_e")[i] * F.col("_e")[j]).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)]
    rows = scattered(err.select(*axes, F.col("a.e").alias("_e"), F.col("a.label").alias("_l")), box(axes, radius), axes)
    local = rows.groupBy(*axes).agg(F.max("_self").alias("_in"), F.max(F.when(F.col("_self"), F.col("_l"))).alias("labels"), *products).filter("_in")
    packed = local.select(*axes, "labels", F.array(*[f"m{i}_{j}" for i in range(n) for j in range(i, n)]).alias("m"))

    @F.pandas_udf("array<double>")
    def weights(m: pd.Series) -> pd.Series:
        at = np.triu_indices(n)
        full = np.zeros((len(m), n, n))
        full[:, at[0], at[1]] = np.stack([np.asarray(x, float) for x in m])
        full = np.maximum(full, full.transpose(0, 2, 1))
        w = np.linalg.solve(full**beta + alpha * np.eye(n), np.ones((len(m), n, 1)))[:, :, 0]
        return pd.Series(list(w / w.sum(1, keepdims=True)))

    votes = packed.withColumn("w", weights("m")).select(*axes, F.explode(F.arrays_zip("labels", "w")).alias("z")).groupBy(*axes, F.col("z.labels").alias("label")).agg(F.sum("z.w").alias("w"))
    return votes.groupBy(*axes).agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("b")).select(*axes, (-F.col("b.l")).alias("label"))


def denoise(df: DataFrame, patch: int = 1, search: int = 2, strength: float = 1.0, v: str = "v") -> DataFrame:
    """Non-local means: each cell the mean over its search box weighted by exp(-patch distance / (2 * noise variance)); the noise from the Laplacian's spread."""
    from gridloom.operators.neighborhood import laplacian

    axes = axes_of(df)
    base = df.select(*axes, F.col(v).cast("double").alias("v"))
    noise = laplacian(base, None).agg(F.var_pop("v")).first()[0] / (len(axes) * 2 * (len(axes) * 2 + 1)) or 1e-12
    patches = scattered(base.select(*axes, F.col("v").alias("_v")), box(axes, patch), axes, {"_i": list(range(len(box(axes, patch))))}).groupBy(*axes).agg(F.max("_self").alias("_in"), F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_p"), F.max(F.when(F.col("_self"), F.col("_v"))).alias("v")).filter("_in")
    patches = checkpointed(patches.select(*axes, "v", "_p"))
    near = scattered(patches.select(*axes, F.col("v").alias("_v"), F.col("_p").alias("_q")), box(axes, search), axes).select(*axes, "_v", "_q")
    shared = F.map_zip_with("_p", "_q", lambda k, a, b: (a - b) ** 2)
    d = F.filter(F.map_values(shared), lambda x: x.isNotNull())
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)
    w = F.exp(-mean / (2 * strength * noise))
    return patches.join(near, axes).select(*axes, w.alias("w"), "_v").groupBy(*axes).agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias("v"))


def bias_correct(df: DataFrame, k: int = 3, degree: int = 2, rounds: int = 3, v: str = "v") -> DataFrame:
    """v divided by exp of a smooth log field: rounds of a mixture on the corrected log image and a polynomial fitted to what its class means leave; positive cells only count."""
    axes = axes_of(df)
    bounds = df.agg(*[F.max(a).alias(a) for a in axes]).first()
    u = {a: F.col(a) / max(1, bounds[a]) * 2 - 1 for a in axes}
    powers = [p for p in box(axes, degree) if min(p) >= 0 and sum(p) <= degree]
    basis = [_monomial(u, axes, p) for p in powers]
    base = checkpointed(df.filter(F.col(v) > 0).select(*axes, F.log(F.col(v).cast("double")).alias("log")))
    coefficients = np.zeros(len(powers))
    for _ in range(rounds):
        field = sum((F.lit(float(c)) * b for c, b in zip(coefficients, basis, strict=True)), F.lit(0.0))
        flat = base.withColumn("v", F.col("log") - field)
        labels, classes = mixture(flat, k, 5)
        mean = F.lit(0.0)
        for i, (_w, m, _s) in enumerate(classes):
            mean = F.when(F.col("label") == i + 1, m).otherwise(mean)
        left = base.join(labels, axes).select(F.array(*basis).alias("b"), (F.col("log") - mean).alias("y"))
        _, _, outer = moments(left.select(F.concat("b", F.array("y")).alias("values")))
        q = len(powers)
        coefficients = np.linalg.solve(outer[:q, :q] + 1e-9 * np.trace(outer[:q, :q]) * np.eye(q), outer[:q, q])
        coefficients[0] = 0.0  # the mean level stays
    field = sum((F.lit(float(c)) * b for c, b in zip(coefficients, basis, strict=True)), F.lit(0.0))
    return df.select(*axes, (F.col(v) / F.exp(field)).alias("v"))


def _monomial(u: dict[str, Column], axes: list[str], powers: tuple[int, ...]) -> Column:
    out = F.lit(1.0)
    for a, p in zip(axes, powers, strict=True):
        for _ in range(p):
            out = out * u[a]
    return out


def metric(fixed: DataFrame, moving: DataFrame, m: transforms.Matrix, kind: str = "msq") -> float:
    """Mean squares or minus the correlation of fixed and the moving image read through a map."""
    axes = axes_of(fixed)
    read = transforms.warp_affine(moving, fixed, m).withColumnRenamed("v", "_m")
    both = fixed.join(read, axes)
    value = F.avg((F.col("v") - F.col("_m")) ** 2) if kind == "msq" else -F.corr("v", "_m")
    return both.agg(value).first()[0]


def register_translation(fixed: DataFrame, moving: DataFrame, reach: int, kind: str = "msq") -> tuple[int, ...]:
    """The whole-cell shift within reach of least metric: all shifts are scored in one aggregation over the overlap."""
    axes = axes_of(fixed)
    offsets = box(axes, reach)
    names = {f"_s{a}": [o[i] for o in offsets] for i, a in enumerate(axes)}
    moved = scattered(moving.select(*axes, F.col("v").alias("_m")), offsets, axes, names)
    value = F.avg((F.col("v") - F.col("_m")) ** 2) if kind == "msq" else -F.corr("v", "_m")
    rows = fixed.select(*axes, "v").join(unbroadcast(moved), axes).groupBy(*names).agg(value.alias("c"))
    best = rows.orderBy("c", *names).first()
    return tuple(best[n] for n in names)


def register_affine(fixed: DataFrame, moving: DataFrame, rounds: int = 5) -> transforms.Matrix:
    """An affine map by Gauss-Newton on mean squares: each round is one warp and one aggregation of the normal equations."""
    from gridloom.operators.neighborhood import central_differences

    axes = axes_of(fixed)
    n = len(axes)
    m = [[float(i == j) for j in range(n)] + [0.0] for i in range(n)]
    grads = checkpointed(central_differences(moving.select(*axes, F.col("v").cast("double").alias("v"))))
    for _ in range(rounds):
        read = transforms.warp_affine(grads.select(*axes, "v"), fixed, m).withColumnRenamed("v", "_m")
        rows = fixed.select(*axes, "v").join(read, axes)
        for a in axes:
            rows = rows.join(transforms.warp_affine(grads.select(*axes, F.col(f"g{a}").alias("v")), fixed, m).withColumnRenamed("v", f"_g{a}"), axes)
        slope = [F.col(f"_g{a}") * b for a in axes for b in (*[F.col(c).cast("double") for c in axes], F.lit(1.0))]
        _, _, outer = moments(rows.select(F.array(*slope, F.col("v") - F.col("_m")).alias("values")))
        q = n * (n + 1)
        step = np.linalg.solve(outer[:q, :q] + 1e-6 * np.trace(outer[:q, :q]) / q * np.eye(q), outer[:q, q]).reshape(n, n + 1)
        m = (np.asarray(m) + step).tolist()
    return m


def register_demons(fixed: DataFrame, moving: DataFrame, rounds: int = 3, sigma: float = 1.0) -> DataFrame:
    """A displacement field (axes, u<axis>) by demons: forces from the fixed gradient, smoothed by a gaussian each round."""
    from gridloom.operators.neighborhood import central_differences, gaussian_columns

    axes = axes_of(fixed)
    grads = checkpointed(central_differences(fixed.select(*axes, F.col("v").cast("double").alias("v"))))
    field = fixed.select(*axes, *[F.lit(0.0).alias(f"u{a}") for a in axes])
    for _ in range(rounds):
        read = transforms.warp_field(moving, field).withColumnRenamed("v", "_m")
        rows = grads.join(read, axes).join(field, axes)
        gap = F.col("_m") - F.col("v")
        size = sum((F.col(f"g{a}") ** 2 for a in axes), F.lit(0.0)) + gap**2
        rows = checkpointed(rows.select(*axes, *[(F.col(f"u{a}") - F.when(size > 1e-9, gap * F.col(f"g{a}") / size).otherwise(0.0)).alias(f"u{a}") for a in axes]))
        field = checkpointed(gaussian_columns(rows, sigma, [f"u{a}" for a in axes]))
    return field


def blobs(df: DataFrame, sigmas: tuple[float, ...], n: int, v: str = "v") -> DataFrame:
    """The n strongest extrema of the scale-normalised Laplacian over cells and scales: axes, sigma, response."""
    from gridloom.operators.neighborhood import gaussian, laplacian

    axes = axes_of(df)
    every = None
    for k, s in enumerate(sigmas):
        part = laplacian(gaussian(df, s, None, v), None).select(*axes, F.lit(k).alias("k"), F.lit(float(s)).alias("sigma"), (F.abs(F.col("v")) * s * s).alias("r"))
        every = part if every is None else every.union(part)
    every = checkpointed(every)
    space = [*axes, "k"]
    near = scattered(every.select(*space, F.col("r").alias("_r")), box(space, 1, centre=False), space).groupBy(*space).agg(F.max("_r").alias("top"))
    return every.join(near, space).filter("r > top").orderBy(F.desc("r"), *axes).limit(n).select(*axes, "sigma", F.col("r").alias("response"))


def canny(df: DataFrame, sigma: float, low: float, high: float, v: str = "v") -> DataFrame:
    """Edges (axes, v 1): gradient maxima along their nearest axis or diagonal direction over ``high``, and those over ``low`` that touch them through others (2-D)."""
    from gridloom.operators.iterative import connected_components
    from gridloom.operators.neighborhood import central_differences, gaussian

    g = checkpointed(central_differences(gaussian(df, sigma, None, v)).select("x", "y", "gx", "gy", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("m")))
    turn = F.pmod(F.round(F.atan2("gy", "gx") / (math.pi / 4)), F.lit(4)).cast("int")
    step = F.element_at(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (1, 1), (0, 1), (-1, 1))]), turn + 1)
    near = scattered(g.select("x", "y", F.col("m").alias("_m")), box(["x", "y"], 1, centre=False), ["x", "y"], {"dx": [o[0] for o in box(["x", "y"], 1, centre=False)], "dy": [o[1] for o in box(["x", "y"], 1, centre=False)]})
    along = g.withColumn("s", step).join(unbroadcast(near.select("x", "y", "dx", "dy", "_m")), ["x", "y"], "left")
    hit = ((F.col("dx") == F.col("s.dx")) & (F.col("dy") == F.col("s.dy"))) | ((F.col("dx") == -F.col("s.dx")) & (F.col("dy") == -F.col("s.dy")))
    peak = along.groupBy("x", "y").agg(F.max("m").alias("m"), F.coalesce(F.max(F.when(hit, F.col("_m"))), F.lit(0.0)).alias("top")).filter((F.col("m") >= F.col("top")) & (F.col("m") >= low))
    peak = checkpointed(peak)
    cc = checkpointed(connected_components(peak, full=True))
    strong = cc.join(unbroadcast(peak.filter(F.col("m") >= high)), ["x", "y"]).select("component").distinct()
    return cc.join(unbroadcast(strong), "component", "left_semi").select("x", "y", F.lit(1).cast("bigint").alias("v"))


def thickness(df: DataFrame, inner: int, outer: int, between: int, rounds: int = 30, label: str = "label") -> DataFrame:
    """Laplace thickness: a potential 0 at the inner and 1 at the outer label relaxed over the label between, thickness 1 / |gradient|."""
    from gridloom.operators.neighborhood import central_differences

    axes = axes_of(df)
    base = checkpointed(df.filter(F.col(label).isin(inner, outer, between)).select(*axes, F.col(label).alias("l")))
    now = base.withColumn("v", F.when(F.col("l") == outer, 1.0).when(F.col("l") == inner, 0.0).otherwise(0.5))
    for _ in range(rounds):
        near = scattered(now.select(*axes, F.col("v").alias("_v")), faces(axes), axes).groupBy(*axes).agg(F.avg("_v").alias("_n"))
        now = checkpointed(now.join(near, axes, "left").select(*axes, "l", F.when(F.col("l") == between, F.coalesce("_n", "v")).otherwise(F.col("v")).alias("v")))
    g = central_differences(now)
    size = F.sqrt(sum((F.col(f"g{a}") ** 2 for a in axes), F.lit(0.0)))
    return g.filter(F.col("l") == between).select(*axes, F.when(size > 1e-9, 1 / size).otherwise(0.0).alias("v"))
