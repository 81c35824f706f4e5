"""Neighbourhood operations as one aggregation over scattered cells (see grid.scattered)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import Geometry, annulus, axes_of, ball, box, cross, faces, scattered

SHAPES = {"box": box, "ball": ball, "cross": cross, "annulus": annulus}


def is_full(df: DataFrame) -> bool:
    """Whether the image has a cell at each place of its bounding box, each once; one aggregation."""
    return _full_and_means(df)[0]


def _full_and_means(df: DataFrame, *columns: str) -> tuple[bool, list[float]]:
    """is_full, and the means of columns, by the same aggregation."""
    axes = axes_of(df)
    r = list(df.agg(F.count(F.lit(1)), *[F.avg(F.col(c).cast("double")) for c in columns], *[f(a) for a in axes for f in (F.min, F.max)]).first())
    n, means, ends = r[0], r[1 : 1 + len(columns)], r[1 + len(columns) :]
    return n > 0 and n == math.prod(hi - lo + 1 for lo, hi in zip(ends[::2], ends[1::2], strict=True)), [m or 0.0 for m in means]


def box_passes(df: DataFrame, radius: int, columns: dict[str, object]) -> DataFrame:
    """Aggregates over the box of each cell of a full image, axis by axis: columns to F.sum, F.min or F.max.

    Each pass is a window along one axis, so rows don't multiply by the box; a line of cells bounds a task.
    """
    axes, out = axes_of(df), df
    for a in axes:
        w = Window.partitionBy(*[b for b in axes if b != a]).orderBy(a).rangeBetween(-radius, radius)
        out = out.select(*axes, *[f(c).over(w).alias(c) for c, f in columns.items()], *[c for c in out.columns if c not in axes and c not in columns])
    return out


def _extreme(df: DataFrame, radius: int, shape: str, f, v: str, out: str, full: bool | None = None) -> DataFrame:
    """The extreme over a shape, which may lack its centre; a cell without neighbours in the shape keeps its value. full: whether the image is known to have all its cells."""
    axes = axes_of(df)
    if shape == "box" and (is_full(df) if full is None else full):
        return box_passes(df.select(*axes, F.col(v).alias(out)), radius, {out: f})
    centre = (0,) * len(axes)
    shape_ = SHAPES[shape](axes, radius)
    offsets = shape_ if centre in shape_ else [*shape_, centre]
    rows = scattered(df.select(*axes, F.col(v).alias("_v")), offsets, axes, {"_use": [o in set(shape_) for o in offsets]})
    value = F.coalesce(f(F.when(F.col("_use"), F.col("_v"))), F.max(F.when(F.col("_self"), F.col("_v"))))
    return rows.groupBy(*axes).agg(value.alias(out), F.max("_self").alias("_in")).filter("_in").drop("_in")


def gray_dilate(df: DataFrame, radius: int = 1, shape: str = "box", v: str = "v", out: str = "v", full: bool | None = None) -> DataFrame:
    return _extreme(df, radius, shape, F.max, v, out, full)


def gray_erode(df: DataFrame, radius: int = 1, shape: str = "box", v: str = "v", out: str = "v", full: bool | None = None) -> DataFrame:
    return _extreme(df, radius, shape, F.min, v, out, full)


def gray_open(df: DataFrame, radius: int = 1, shape: str = "box", v: str = "v") -> DataFrame:
    full = shape == "box" and is_full(df)
    return gray_dilate(gray_erode(df, radius, shape, v, v, full), radius, shape, v, v, full)


def gray_close(df: DataFrame, radius: int = 1, shape: str = "box", v: str = "v") -> DataFrame:
    full = shape == "box" and is_full(df)
    return gray_erode(gray_dilate(df, radius, shape, v, v, full), radius, shape, v, v, full)


def binary_morphology(df: DataFrame, op: str, radius: int = 1, shape: str = "ball", foreground: float = 1.0, v: str = "v") -> DataFrame:
    """dilate, erode, open or close of the cells equal to the foreground value; cells outside the image are background for dilation and ignored for erosion."""
    as_bit = df.select(*axes_of(df), (F.col(v) == foreground).cast("bigint").alias("v"))
    ops = {"dilate": gray_dilate, "erode": gray_erode, "open": gray_open, "close": gray_close}
    return ops[op](as_bit, radius, shape)


def neighborhood_stats(df: DataFrame, radius: int, v: str = "v", bins: int = 0) -> DataFrame:
    """Over the box of each cell: mean, min, max, variance (n - 1), sigma, skewness, kurtosis (moments over variance * sigma, n - 1), n."""
    axes = axes_of(df)
    x = F.col("_v")
    full, (mean,) = _full_and_means(df, v)
    if full:
        # about the image's mean, so that sums of powers keep their digits
        base = df.select(*axes, (F.col(v).cast("double") - mean).alias("_v"))
        sums = base.select(*axes, F.lit(1).cast("bigint").alias("n"), x.alias("min"), x.alias("max"), *[(x**k).alias(f"s{k}") for k in (1, 2, 3, 4)])
        got = box_passes(sums, radius, {"n": F.sum, "min": F.min, "max": F.max, **{f"s{k}": F.sum for k in (1, 2, 3, 4)}})
        got = got.withColumns({"mean": F.col("s1") / F.col("n"), "variance": F.when(F.col("n") > 1, (F.col("s2") - F.col("s1") ** 2 / F.col("n")) / (F.col("n") - 1))})
        shift = F.lit(mean)
    else:
        rows = scattered(df.select(*axes, F.col(v).cast("double").alias("_v")), box(axes, radius), axes)
        got = rows.groupBy(*axes).agg(F.max("_self").alias("_in"), F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.var_samp("_v").alias("variance"), F.sum(x * x).alias("s2"), F.sum(x**3).alias("s3"), F.sum(x**4).alias("s4"), F.sum("_v").alias("s1")).filter("_in")
        shift = F.lit(0.0)
    n, m, s1, s2, s3, s4 = (F.col(c) for c in ("n", "mean", "s1", "s2", "s3", "s4"))
    m3 = s3 - 3 * m * s2 + 3 * m**2 * s1 - n * m**3
    m4 = s4 - 4 * m * s3 + 6 * m**2 * s2 - 4 * m**3 * s1 + n * m**4
    sd = F.sqrt("variance")
    ok = F.col("variance") > 1e-12
    moved = [(F.col(c) + shift).alias(c) for c in ("mean", "min", "max")]
    return got.select(*axes, "n", *moved, "variance", sd.alias("sigma"), F.when(ok, m3 / (n - 1) / (F.col("variance") * sd)).alias("skewness"), F.when(ok, m4 / (n - 1) / F.col("variance") ** 2).alias("kurtosis"))


def neighborhood_entropy(df: DataFrame, radius: int, v: str = "v") -> DataFrame:
    """Entropy in nats of the values in the box of each cell."""
    axes = axes_of(df)
    counts = scattered(df.select(*axes, F.col(v).alias("_v")), box(axes, radius), axes).groupBy(*axes, "_v").agg(F.count(F.lit(1)).alias("c"), F.max("_self").alias("_in"))
    n = F.sum("c")
    return counts.groupBy(*axes).agg((F.log(n) - F.sum(F.col("c") * F.log("c")) / n).alias("entropy"), F.max("_in").alias("_in")).filter("_in").drop("_in")


def median_filter(df: DataFrame, radius: int, v: str = "v") -> DataFrame:
    axes = axes_of(df)
    return scattered(df.select(*axes, F.col(v).alias("_v")), box(axes, radius), axes).groupBy(*axes).agg(F.median("_v").alias("v"), F.max("_self").alias("_in")).filter("_in").drop("_in")


def convolve(df: DataFrame, kernel: dict[tuple[int, ...], float], normalize: bool = True, v: str = "v") -> DataFrame:
    """Each cell's neighbours weighted by the kernel; normalize divides by the kernel's sum. Cells outside count as 0."""
    axes = axes_of(df)
    total = sum(kernel.values()) if normalize else 1.0
    rows = scattered(df.select(*axes, F.col(v).alias("_v")), list(kernel), axes, {"_k": [k / total for k in kernel.values()]})
    return rows.groupBy(*axes).agg(F.sum(F.col("_v") * F.col("_k")).alias("v"), F.max("_self").alias("_in")).filter("_in").drop("_in")


def _kernel(sigma: float, error: float = 0.01) -> list[tuple[int, float]]:
    radius = max(1, math.ceil(sigma * math.sqrt(-2 * math.log(error))))
    w = [(i, math.exp(-i * i / (2 * sigma * sigma))) for i in range(-radius, radius + 1)]
    s = sum(x for _, x in w)
    return [(i, x / s) for i, x in w]


def gaussian_columns(df: DataFrame, sigma: float, columns: list[str], geometry: Geometry | None = None) -> DataFrame:
    """(axes, the columns): separable gaussian smoothing of several columns at once, sigma in physical units; weights outside the image are left out and the rest rescaled."""
    axes = axes_of(df)
    out = df.select(*axes, *[F.col(c).cast("double").alias(c) for c in columns])
    for i, a in enumerate(axes):
        weights = _kernel(sigma / (geometry.spacing[i] if geometry else 1.0))
        offsets = [tuple(d if b == a else 0 for b in axes) for d, _ in weights]
        rows = scattered(out, offsets, axes, {"_k": [w for _, w in weights]})
        out = rows.groupBy(*axes).agg(*[(F.sum(F.col(c) * F.col("_k")) / F.sum("_k")).alias(c) for c in columns], F.max("_self").alias("_in")).filter("_in").drop("_in")
    return out


def gaussian(df: DataFrame, sigma: float, geometry: Geometry | None = None, v: str = "v") -> DataFrame:
    return gaussian_columns(df.select(*axes_of(df), F.col(v).alias("v")), sigma, ["v"], geometry)


def _axis(df: DataFrame, a: str):
    return Window.partitionBy(*[b for b in axes_of(df) if b != a]).orderBy(a)


def central_differences(df: DataFrame, geometry: Geometry | None = None, v: str = "v") -> DataFrame:
    """g<axis>: central differences, one-sided at the border."""
    out = df
    for i, a in enumerate(axes_of(df)):
        w, step = _axis(df, a), geometry.spacing[i] if geometry else 1.0
        lo, hi = F.coalesce(F.lag(v).over(w), F.col(v)), F.coalesce(F.lead(v).over(w), F.col(v))
        n = F.count(F.lit(1)).over(w.rowsBetween(-1, 1)) - 1
        out = out.withColumn(f"g{a}", F.when(n > 0, (hi - lo) / (n * step)).otherwise(0.0))
    return out


def gradient_magnitude(df: DataFrame, sigma: float = 1.0, geometry: Geometry | None = None, v: str = "v") -> DataFrame:
    """The gradient magnitude of the image smoothed by sigma (0.5 where not positive; None: not smoothed)."""
    base = df.select(*axes_of(df), F.col(v).cast("double").alias("v")) if sigma is None else gaussian(df, sigma if sigma > 0 else 0.5, geometry, v)
    g = central_differences(base, geometry)
    return g.select(*axes_of(df), F.sqrt(sum((F.col(f"g{a}") ** 2 for a in axes_of(df)), F.lit(0.0))).alias("v"))


def laplacian(df: DataFrame, sigma: float | None = 1.0, geometry: Geometry | None = None, v: str = "v") -> DataFrame:
    """Second differences summed over axes; the border repeats its cell."""
    base = df.select(*axes_of(df), F.col(v).cast("double").alias("v")) if sigma is None else gaussian(df, sigma if sigma > 0 else 0.5, geometry, v)
    out, parts = base, []
    for i, a in enumerate(axes_of(df)):
        w, step = _axis(df, a), geometry.spacing[i] if geometry else 1.0
        out = out.withColumn(f"l{a}", (F.coalesce(F.lag("v").over(w), F.col("v")) + F.coalesce(F.lead("v").over(w), F.col("v")) - 2 * F.col("v")) / step**2)
        parts.append(F.col(f"l{a}"))
    return out.select(*axes_of(df), sum(parts, F.lit(0.0)).alias("v"))


def sharpen(df: DataFrame, geometry: Geometry | None = None, v: str = "v") -> DataFrame:
    """The image minus its Laplacian, brought back to the image's mean and clamped to its range."""
    axes = axes_of(df)
    lap = laplacian(df, None, geometry, v).withColumnRenamed("v", "_l")
    both = df.select(*axes, F.col(v).cast("double").alias("v")).join(lap, axes).withColumn("_s", F.col("v") - F.col("_l"))
    stats = both.agg(F.avg("v").alias("_m"), F.avg("_s").alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    moved = F.col("_s") + F.col("_m") - F.col("_n")
    return both.crossJoin(F.broadcast(stats)).select(*axes, F.greatest("_lo", F.least("_hi", moved)).alias("v"))


def unsharp_mask(df: DataFrame, amount: float = 0.5, radius: float = 1.0, threshold: float = 0.0, v: str = "v") -> DataFrame:
    axes = axes_of(df)
    both = df.select(*axes, F.col(v).cast("double").alias("v")).join(gaussian(df, radius, None, v).withColumnRenamed("v", "_g"), axes)
    d = F.col("v") - F.col("_g")
    return both.select(*axes, F.when(F.abs(d) > threshold, F.col("v") + amount * d).otherwise(F.col("v")).alias("v"))


def local_correlation(df: DataFrame, radius: int, a: str = "v", b: str = "w") -> DataFrame:
    """Squared correlation of two images in each cell's box."""
    axes = axes_of(df)
    full, (ma, mb) = _full_and_means(df, a, b)
    if full:
        base = df.select(*axes, (F.col(a).cast("double") - ma).alias("sa"), (F.col(b).cast("double") - mb).alias("sb"))
        parts = base.withColumns({"n": F.lit(1).cast("bigint"), "ab": F.col("sa") * F.col("sb"), "aa": F.col("sa") ** 2, "bb": F.col("sb") ** 2})
        s = box_passes(parts, radius, dict.fromkeys(("n", "sa", "sb", "ab", "aa", "bb"), F.sum))
        n = F.col("n")
        c, p, q = (F.col(k) / n - F.col(f"s{k[0]}") * F.col(f"s{k[1]}") / n**2 for k in ("ab", "aa", "bb"))
        return s.select(*axes, F.when((p > 1e-12) & (q > 1e-12), c**2 / (p * q)).otherwise(0.0).alias("v"))
    rows = scattered(df.select(*axes, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")), box(axes, radius), axes)
    got = rows.groupBy(*axes).agg(F.max("_self").alias("_in"), F.covar_pop("_a", "_b").alias("c"), F.var_pop("_a").alias("p"), F.var_pop("_b").alias("q")).filter("_in")
    return got.select(*axes, F.when((F.col("p") > 1e-12) & (F.col("q") > 1e-12), F.col("c") ** 2 / (F.col("p") * F.col("q"))).otherwise(0.0).alias("v"))


def correlation_update(df: DataFrame, radius: int, a: str = "v", b: str = "w") -> DataFrame:
    """a - b minus its mean over the box, for cells whose whole box is in the image and where a or b is positive; 0 elsewhere."""
    axes = axes_of(df)
    d = (F.col(a) - F.col(b)).alias("_d")
    whole = (2 * radius + 1) ** len(axes)
    if is_full(df):
        base = df.select(*axes, d, ((F.col(a) > 0) | (F.col(b) > 0)).alias("_live"), (F.col(a) - F.col(b)).alias("_s"), F.lit(1).cast("bigint").alias("_n"))
        s = box_passes(base, radius, {"_s": F.sum, "_n": F.sum})
        return s.select(*axes, F.when((F.col("_n") == whole) & F.col("_live"), F.col("_d") - F.col("_s") / F.col("_n")).otherwise(0.0).alias("v"))
    live = ((F.col(a) > 0) | (F.col(b) > 0)).alias("_live")
    rows = scattered(df.select(*axes, d, live), box(axes, radius), axes)
    got = rows.groupBy(*axes).agg(F.max("_self").alias("_in"), F.avg("_d").alias("m"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_self"), F.col("_d"))).alias("d"), F.max(F.when(F.col("_self"), F.col("_live"))).alias("live")).filter("_in")
    return got.select(*axes, F.when((F.col("n") == whole) & F.col("live"), F.col("d") - F.col("m")).otherwise(0.0).alias("v"))


def correlation_voting(target: DataFrame, set_: DataFrame, radius: int, label: str = "label", image: str = "image") -> DataFrame:
    """Each cell's label by votes weighted with |local correlation| of each image with the target; target: v, set: image, v, label."""
    axes = axes_of(target)
    both = set_.join(target.select(*axes, F.col("v").alias("_t")), axes)
    rows = scattered(both.select(image, *axes, F.col("v").alias("_v"), "_t", F.col(label).alias("_l")), box(axes, radius), axes)
    local = rows.groupBy(image, *axes).agg(F.max("_self").alias("_in"), F.abs(F.corr("_v", "_t")).alias("r"), F.max(F.when(F.col("_self"), F.col("_l"))).alias("l")).filter("_in")
    votes = local.groupBy(*axes, "l").agg(F.sum(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))).alias("w"), F.count(F.lit(1)).alias("n"))
    return votes.groupBy(*axes).agg(F.max(F.struct("w", "n", (-F.col("l")).alias("l"))).alias("b")).select(*axes, (-F.col("b.l")).alias("label"))


def label_contour(df: DataFrame, label: str = "label", fully_connected: bool = True) -> DataFrame:
    """The label where some neighbour in the image has another label, else 0."""
    axes = axes_of(df)
    offsets = box(axes, 1) if fully_connected else cross(axes, 1)
    rows = scattered(df.select(*axes, F.col(label).alias("_l")), offsets, axes)
    got = rows.groupBy(*axes).agg(F.max("_self").alias("_in"), F.min("_l").alias("lo"), F.max("_l").alias("hi"), F.max(F.when(F.col("_self"), F.col("_l"))).alias("l")).filter("_in")
    return got.select(*axes, F.when(F.col("lo") != F.col("hi"), F.col("l")).otherwise(F.lit(0)).cast("bigint").alias("label"))


def label_interfaces(df: DataFrame, label: str = "label") -> DataFrame:
    """Unordered pairs of labels (a < b, background left out) and the number of face contacts."""
    axes = axes_of(df)
    pairs = None
    for a in axes:
        w = _axis(df, a)
        near = df.select(F.col(label).alias("p"), F.lead(label).over(w).alias("q"), (F.lead(a).over(w) - F.col(a)).alias("gap")).filter("gap = 1 AND p <> q AND p <> 0 AND q <> 0")
        near = near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
        pairs = near if pairs is None else pairs.union(near)
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def remove_interfaces(df: DataFrame, label: str = "label") -> DataFrame:
    """Labels zeroed where a face or corner neighbour has another nonzero label, all judged on the input."""
    axes = axes_of(df)
    nz = F.when(F.col("_l") != 0, F.col("_l"))
    rows = scattered(df.select(*axes, F.col(label).alias("_l")), box(axes, 1), axes)
    got = rows.groupBy(*axes).agg(F.max("_self").alias("_in"), F.min(nz).alias("lo"), F.max(nz).alias("hi"), F.max(F.when(F.col("_self"), F.col("_l"))).alias("l")).filter("_in")
    return got.select(*axes, F.when((F.col("l") != 0) & (F.col("lo") != F.col("hi")), F.lit(0)).otherwise(F.col("l")).cast("bigint").alias("label"))


def surface_area(df: DataFrame, geometry: Geometry, label: str = "label") -> DataFrame:
    """Per label but 0, the area of the cell faces that touch another label or the outside."""
    axes = axes_of(df)
    parts = None
    for i, a in enumerate(axes):
        w = _axis(df, a)
        face = geometry.cell_volume / geometry.spacing[i]
        open_ = lambda f, d, a=a, w=w: F.when((f(a).over(w) == F.col(a) + d) & (f(label).over(w) == F.col(label)), 0).otherwise(1)
        part = df.select(F.col(label).alias("label"), ((open_(F.lag, -1) + open_(F.lead, 1)) * face).alias("s"))
        parts = part if parts is None else parts.union(part)
    return parts.filter("label <> 0").groupBy("label").agg(F.sum("s").alias("area"))


def label_thickness(df: DataFrame, geometry: Geometry, label: str = "label") -> DataFrame:
    """Per label but 0: 2 * voxels / edge voxels * cell volume ^ 0.3333."""
    axes = axes_of(df)
    rows = scattered(df.select(*axes, F.col(label).alias("_l")), cross(axes, 1), axes)
    got = rows.groupBy(*axes).agg(F.max("_self").alias("_in"), F.min("_l").alias("lo"), F.max("_l").alias("hi"), F.max(F.when(F.col("_self"), F.col("_l"))).alias("label")).filter("_in AND label <> 0")
    edge = F.count(F.when(F.col("lo") != F.col("hi"), 1))
    n = F.count(F.lit(1))
    return got.groupBy("label").agg(n.alias("voxels"), edge.alias("edge"), F.when(edge > 0, 2 * n / edge * geometry.cell_volume**0.3333).alias("thickness"))


def cooccurrence(df: DataFrame, offset: tuple[int, ...], bins: int = 16, v: str = "v") -> DataFrame:
    """Texture features of the symmetric co-occurrence matrix: energy, entropy (bits), correlation, inverse difference moment, inertia."""
    axes = axes_of(df)
    s = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    level = F.least(F.floor((F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    q = df.crossJoin(F.broadcast(s)).select(*axes, level.alias("i"))
    moved = q.select(*[(F.col(a) - d).alias(a) for a, d in zip(axes, offset, strict=True)], F.col("i").alias("j"))
    pairs = q.join(moved, axes).groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"))
    sym = pairs.union(pairs.select("j", "i", "c")).groupBy("i", "j").agg(F.sum("c").alias("c"))
    p = sym.crossJoin(F.broadcast(sym.agg(F.sum("c").alias("n")))).select("i", "j", (F.col("c") / F.col("n")).alias("p"))
    m = p.agg(F.sum(F.col("i") * F.col("p")).alias("m"))
    d = p.crossJoin(F.broadcast(m))
    di, dj = F.col("i") - F.col("m"), F.col("j") - F.col("m")
    var = F.sum(di * di * F.col("p"))
    k = di + dj
    return d.agg(F.sum(F.col("p") ** 2).alias("energy"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), (F.sum(di * dj * F.col("p")) / var).alias("correlation"), F.sum(F.col("p") / (1 + (F.col("i") - F.col("j")) ** 2)).alias("idm"), F.sum((F.col("i") - F.col("j")) ** 2 * F.col("p")).alias("inertia"), F.sum(k**3 * F.col("p")).alias("cluster_shade"), F.sum(k**4 * F.col("p")).alias("cluster_prominence"))


def run_lengths(df: DataFrame, axis: str = "x", bins: int = 8, v: str = "v") -> DataFrame:
    """Run-length texture features along an axis: short and long run emphasis, grey-level and run-length nonuniformity, runs."""
    axes = axes_of(df)
    rest = [a for a in axes if a != axis]
    s = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    level = F.least(F.floor((F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    q = df.crossJoin(F.broadcast(s)).select(*axes, level.alias("g"))
    w = Window.partitionBy(*rest).orderBy(axis)
    new = F.when((F.lag("g").over(w) == F.col("g")) & (F.lag(axis).over(w) == F.col(axis) - 1), 0).otherwise(1)
    runs = q.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy(*rest, "run", "g").agg(F.count(F.lit(1)).alias("l"))
    table = runs.groupBy("g", "l").agg(F.count(F.lit(1)).alias("c"))
    n = table.agg(F.sum("c").alias("runs"), (F.sum(F.col("c") / F.col("l") ** 2) / F.sum("c")).alias("short_run_emphasis"), (F.sum(F.col("c") * F.col("l") ** 2) / F.sum("c")).alias("long_run_emphasis"))
    by = lambda c, name: table.groupBy(c).agg(F.sum("c").alias("s")).agg((F.sum(F.col("s") ** 2) / F.sum("s")).alias(name))
    return n.crossJoin(by("g", "grey_level_nonuniformity")).crossJoin(by("l", "run_length_nonuniformity"))  # one row each


def topology(df: DataFrame, v: str = "v", level: float = 0.5) -> DataFrame:
    """Euler number of the cells >= level in 2-D with face contacts: cells - face contacts + full squares; with cells and contacts."""
    axes = axes_of(df)
    on = df.filter(F.col(v) >= level).select(*axes)
    touch = sum((on.join(on.select(*[(F.col(b) - int(b == a)).alias(b) for b in axes]), axes).count() for a in axes), 0)
    rows = scattered(on, [(0, 0), (1, 0), (0, 1), (1, 1)], axes).groupBy(*axes).agg(F.count(F.lit(1)).alias("n")).filter("n = 4")
    cells, squares = on.count(), rows.count()
    return df.sparkSession.createDataFrame([(cells, touch, cells - touch + squares)], "cells bigint, contacts bigint, euler bigint")


def face_offsets(df: DataFrame) -> list[tuple[int, ...]]:
    return faces(axes_of(df))
