"""Statistics by label: grouped aggregations with partial steps; the background label is 0."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import Geometry, axes_of, scattered


def label_stats(df: DataFrame, geometry: Geometry, label: str = "label", v: str = "v") -> DataFrame:
    """x, y, .. (physical centroid), label, mass, volume, count of each label but 0."""
    found = [F.avg(p).alias(a) for a, p in zip(geometry.axes, geometry.physical(), strict=True)]
    n = F.count(F.lit(1))
    return df.filter(F.col(label) != 0).groupBy(F.col(label).alias("label")).agg(*found, F.sum(v).alias("mass"), (n * geometry.cell_volume).alias("volume"), n.alias("count"))


def roi_statistics(df: DataFrame, geometry: Geometry, names: DataFrame | None = None, label: str = "label", v: str = "v") -> DataFrame:
    """roi_number, cluster_size, mass, mean over cells with |v| > 1e-9, centre of all cells of the label; names: (roi_number, roi_name)."""
    live = F.abs(F.col(v)) > 1e-9
    centre = [F.avg(p).alias(f"com_{a}") for a, p in zip(geometry.axes, geometry.physical(), strict=True)]
    size, mass = F.count(F.when(live, 1)), F.coalesce(F.sum(F.when(live, F.col(v))), F.lit(0.0))
    out = df.filter(F.col(label) > 0).groupBy(F.col(label).alias("roi_number")).agg(size.alias("cluster_size"), mass.alias("mass"), (mass / size).alias("mean"), *centre)
    return out.filter("cluster_size > 0") if names is None else out.filter("cluster_size > 0").join(names, "roi_number", "left")


def label_overlap(df: DataFrame, a: str = "la", b: str = "lb", target_total: bool = True) -> DataFrame:
    """Per label (and label -1 for all): total_or_target, jaccard, dice, volume_similarity, false_negative, false_positive; a is the source, b the target.

    Every cell is counted once for its source and once for its target label, so one aggregation does.
    """
    la, lb = F.col(a), F.col(b)
    # a cell with one label on both sides counts once; labels are compared with their own cells only
    sides = F.when(la == lb, F.array(F.struct(la.alias("label"), F.lit(1).alias("s"), F.lit(1).alias("t")))).otherwise(F.array(F.struct(la.alias("label"), F.lit(1).alias("s"), F.lit(0).alias("t")), F.struct(lb.alias("label"), F.lit(0).alias("s"), F.lit(1).alias("t"))))
    rows = df.select(F.explode(sides).alias("r")).select("r.*").filter("label <> 0")
    counts = rows.groupBy("label").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum(F.col("s") * F.col("t")).alias("i"))
    every = counts.unionByName(counts.agg(F.lit(-1).cast("bigint").alias("label"), F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("i").alias("i")))
    s, t, i = F.col("s"), F.col("t"), F.col("i")
    u = s + t - i
    share = lambda n, d: F.when(d > 0, n / d)
    return every.select("label", share(i, t).alias("total_or_target"), share(i, u).alias("jaccard"), share(2 * i, s + t).alias("dice"), share(2 * (s - t), s + t).alias("volume_similarity"), share(t - i, t).alias("false_negative"), share(s - i, s).alias("false_positive"))


def dice_table(df: DataFrame, a: str = "la", b: str = "lb") -> DataFrame:
    """Labels in both images: dice, ro (intersection over union), and the shares of each region in the overlap."""
    one = df.filter(F.col(a) != 0).groupBy(F.col(a).alias("label")).agg(F.count(F.lit(1)).alias("n1"), F.count(F.when(F.col(a) == F.col(b), 1)).alias("i"))
    two = df.filter(F.col(b) != 0).groupBy(F.col(b).alias("label")).agg(F.count(F.lit(1)).alias("n2"))
    i, n1, n2 = F.col("i"), F.col("n1"), F.col("n2")
    return one.join(two, "label").select("label", (2 * i / (n1 + n2)).alias("dice"), (i / (n1 + n2 - i)).alias("ro"), (i / n1).alias("percent_1"), (i / n2).alias("percent_2"))


def intensity_statistics(df: DataFrame, label: str = "label", v: str = "v", bins: int = 200) -> DataFrame:
    """Per label but 0: mean, sigma, skewness, kurtosis (k-statistics), entropy (bits, ``bins`` bins over the label's range), sum, p05, p95 (of the bins), min, max, count."""
    use = df.filter(F.col(label) != 0).select(F.col(label).alias("label"), F.col(v).cast("double").alias("v"))
    base = use.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sigma"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"))
    d = F.col("v") - F.col("mean")
    moments = use.join(base.select("label", "mean"), "label").groupBy("label").agg(F.sum(d**3).alias("m3"), F.sum(d**4).alias("m4"))
    span = F.col("max") - F.col("min")
    k = F.when(span > 0, F.least(F.floor((F.col("v") - F.col("min")) / span * bins), F.lit(bins - 1))).otherwise(0)
    cells = use.join(base.select("label", "min", "max", "n"), "label").groupBy("label", "n", "min", "max", k.cast("int").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    so_far = F.sum("c").over(Window.partitionBy("label").orderBy("k"))  # at most ``bins`` rows a label
    upper = F.col("min") + (F.col("k") + 1) * span / bins
    shape = cells.withColumn("share", so_far / F.col("n")).groupBy("label").agg((-F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") / F.col("n")))).alias("entropy"), F.min(F.when(F.col("share") >= 0.05, upper)).alias("p05"), F.min(F.when(F.col("share") >= 0.95, upper)).alias("p95"))
    n, s = F.col("n").cast("double"), F.col("sigma")  # products of counts exceed 64 bits
    skew = F.when((n > 2) & (s > 0), n / ((n - 1) * (n - 2)) * F.col("m3") / s**3)
    kurt = F.when((n > 3) & (s > 0), n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * F.col("m4") / s**4 - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))
    return base.join(moments, "label").join(shape, "label").select("label", "mean", "sigma", skew.alias("skewness"), kurt.alias("kurtosis"), "entropy", "sum", "p05", "p95", "min", "max", F.col("n").alias("count"))


def geometry_measures(df: DataFrame, geometry: Geometry, label: str = "label") -> DataFrame:
    """Per label but 0: voxels, volume, centroid, bounding box, and in 2-D the axes, eccentricity, elongation, orientation from second moments."""
    axes = geometry.axes
    p = dict(zip(axes, geometry.physical(), strict=True))
    aggs = [F.count(F.lit(1)).alias("voxels")]
    aggs += [f(p[a]).alias(f"{n}_{a}") for a in axes for n, f in (("centroid", F.avg),)]
    aggs += [f(a).cast("bigint").alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))]
    aggs += [F.covar_pop(p[a], p[b]).alias(f"c_{a}{b}") for i, a in enumerate(axes) for b in axes[i:]]
    out = df.filter(F.col(label) != 0).groupBy(F.col(label).alias("label")).agg(*aggs).withColumn("volume", F.col("voxels") * geometry.cell_volume)
    if len(axes) == 2:
        a, b, c = F.col("c_xx"), F.col("c_yy"), F.col("c_xy")
        root = F.sqrt(((a - b) / 2) ** 2 + c**2)
        big, small = (a + b) / 2 + root, F.greatest((a + b) / 2 - root, F.lit(0.0))
        out = out.withColumns({"major": 4 * F.sqrt(big), "minor": 4 * F.sqrt(small), "eccentricity": F.when(big > 0, F.sqrt(1 - small / big)), "elongation": F.when(small > 1e-12, F.sqrt(big / small)), "orientation": 0.5 * F.atan2(2 * c, a - b)})
    return out.drop(*[f"c_{a}{b}" for i, a in enumerate(axes) for b in axes[i:]])


def count_difference(df: DataFrame, a: str = "v", b: str = "w", mask: str = "mask") -> DataFrame:
    """Over mask > 0: the sum of |a - b|, its mean, and the percentage of cells with a < b."""
    d = F.col(a) - F.col(b)
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.filter(F.col(mask) > 0).agg(F.coalesce(F.sum(F.abs(d)), F.lit(0.0)).alias("total"), (F.coalesce(F.sum(F.abs(d)), F.lit(0.0)) / n).alias("mean"), (F.count(F.when(d < 0, 1)) / n * 100).alias("negative_percent"))


def min_max_mean(df: DataFrame, geometry: Geometry, v: str = "v") -> DataFrame:
    """min, max, mean, variance (over n), sd (over n - 1) and the centre of mass."""
    centre = [(F.sum(p * F.col(v)) / F.sum(v)).alias(f"com_{a}") for a, p in zip(geometry.axes, geometry.physical(), strict=True)]
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_samp(v).alias("sd"), *centre)


def label_region(df: DataFrame, label_value: int, label: str = "label", pad: int = 0) -> DataFrame:
    """The cells in a label's bounding box, widened by pad."""
    axes = axes_of(df)
    bounds = df.filter(F.col(label) == label_value).agg(*[f(a).alias(f"_{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(bounds))  # one row
    for a in axes:
        out = out.filter((F.col(a) >= F.col(f"_lo{a}") - pad) & (F.col(a) <= F.col(f"_hi{a}") + pad))
    return out.drop(*[f"_{n}{a}" for a in axes for n in ("lo", "hi")])


def pearson(df: DataFrame, a: str = "v", b: str = "w", mask: str | None = None) -> DataFrame:
    return (df.filter(F.col(mask) > 0) if mask else df).agg(F.corr(a, b).alias("r"))


def mutual_information(df: DataFrame, a: str = "v", b: str = "w", bins: int = 32) -> DataFrame:
    """Mutual information in nats of a joint histogram of equal bins."""
    lo_hi = df.agg(F.min(a).alias("_a0"), F.max(a).alias("_a1"), F.min(b).alias("_b0"), F.max(b).alias("_b1"), F.count(F.lit(1)).alias("_n"))
    cell = lambda c, p: F.when(F.col(f"_{p}1") > F.col(f"_{p}0"), F.least(F.floor((F.col(c) - F.col(f"_{p}0")) / (F.col(f"_{p}1") - F.col(f"_{p}0")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    joint = df.crossJoin(F.broadcast(lo_hi)).groupBy(cell(a, "a").alias("i"), cell(b, "b").alias("j"), "_n").agg(F.count(F.lit(1)).alias("c"))
    pi, pj = F.sum("c").over(Window.partitionBy("i")), F.sum("c").over(Window.partitionBy("j"))  # at most bins * bins rows
    return joint.withColumns({"pi": pi, "pj": pj}).agg(F.sum(F.col("c") / F.col("_n") * F.log(F.col("c") * F.col("_n") / (F.col("pi") * F.col("pj")))).alias("mi"))


#: Neighbours of a cell (first axis, second axis) by name, and the joint entropies of spatial mutual information with their weights.
_SIDES = {"0": (0, 0), "u": (0, -1), "l": (-1, 0), "r": (1, 0)}
_SPATIAL = {("u", "0"): 0.5, ("0", "u"): 0.5, ("l", "0"): 0.5, ("0", "l"): 0.5, ("0", "0"): -1.0, ("u", "r"): -0.25, ("r", "u"): -0.25, ("l", "u"): -0.25, ("u", "l"): -0.25}


def spatial_mutual_information(df: DataFrame, a: str = "v", b: str = "w", bins: int = 32) -> DataFrame:
    """(smi): mutual information of two images as fields, in nats: joint entropies of one image with the neighbours of the other, in the plane of the first two axes.

    A cell's neighbours come together in one aggregation of scattered bins, and each pair of places is one joint histogram of at most bins * bins rows;
    a pair counts at cells where both its places lie in the image.
    """
    axes = axes_of(df)
    lo_hi = df.agg(F.min(a).alias("_a0"), F.max(a).alias("_a1"), F.min(b).alias("_b0"), F.max(b).alias("_b1"))
    cell = lambda c, p: F.when(F.col(f"_{p}1") > F.col(f"_{p}0"), F.least(F.floor((F.col(c) - F.col(f"_{p}0")) / (F.col(f"_{p}1") - F.col(f"_{p}0")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    binned = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).crossJoin(F.broadcast(lo_hi)).select(*axes, cell(a, "a").alias("_a"), cell(b, "b").alias("_b"))
    offsets = [(*o, *[0] * (len(axes) - 2)) for o in _SIDES.values()]
    near = scattered(binned, offsets, axes, {"_s": list(_SIDES)})
    at = lambda c, s: F.max(F.when(F.col("_s") == s, F.col(c)))
    cells = near.groupBy(*axes).agg(*[at(f"_{c}", s).alias(f"{c}{s}") for c in "ab" for s in _SIDES]).filter("a0 IS NOT NULL")
    pairs = F.array(*[F.struct(F.lit(f"{s}{t}").alias("pair"), F.col(f"a{s}").alias("i"), F.col(f"b{t}").alias("j")) for s, t in _SPATIAL])
    joint = cells.select(F.explode(pairs).alias("p")).select("p.*").filter("i IS NOT NULL AND j IS NOT NULL").groupBy("pair", "i", "j").agg(F.count(F.lit(1)).alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy("pair"))
    weight = F.coalesce(*[F.when(F.col("pair") == f"{s}{t}", w) for (s, t), w in _SPATIAL.items()])
    return joint.select((-weight * share * F.log(share)).alias("h")).agg(F.sum("h").alias("smi"))


def similarity(df: DataFrame, a: str = "v", b: str = "w") -> DataFrame:
    """Global metrics of two images: msq (mean squares), demons (the same, halved gradient-free form), gc (correlation), ncc (its square)."""
    d = F.col(a) - F.col(b)
    return df.agg(F.avg(d * d).alias("msq"), F.corr(a, b).alias("gc"), (F.corr(a, b) * F.corr(a, b)).alias("ncc"), F.sum(d * d).alias("ssd"))


def otsu_thresholds(df: DataFrame, k: int = 1, bins: int = 200, v: str = "v", mask: str | None = None) -> list[float]:
    """k thresholds that maximise the between-class variance of a histogram of ``bins``; the histogram is one aggregation, its search a dynamic programme."""
    use = (df.filter(F.col(mask) > 0) if mask else df).select(F.col(v).cast("double").alias("v"))
    lo, hi = use.agg(F.min("v"), F.max("v")).first()
    if lo is None or hi == lo:
        return []
    cell = F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    rows = {r[0]: (r[1], r[2]) for r in use.groupBy(cell).agg(F.count(F.lit(1)), F.sum("v")).collect()}
    n, s = [0.0], [0.0]
    for i in range(bins):
        c, t = rows.get(i, (0, 0.0))
        n.append(n[-1] + c)
        s.append(s[-1] + t)
    gain = lambda i, j: (s[j] - s[i]) ** 2 / (n[j] - n[i]) if n[j] > n[i] else 0.0
    best = [[gain(0, j) for j in range(bins + 1)]]
    back: list[list[int]] = []
    for _ in range(k):
        row, at = [-math.inf] * (bins + 1), [0] * (bins + 1)
        for j in range(1, bins + 1):
            for i in range(1, j):
                g = best[-1][i] + gain(i, j)
                if g > row[j] + 1e-11 * abs(row[j] if row[j] > -math.inf else 0.0):  # of equal splits the lowest
                    row[j], at[j] = g, i
        best.append(row)
        back.append(at)
    cuts, j = [], bins
    for at in reversed(back):
        j = at[j]
        cuts.append(lo + j * (hi - lo) / bins)
    return cuts[::-1]


def otsu(df: DataFrame, k: int = 1, v: str = "v", out: str = "out", mask: str | None = None) -> DataFrame:
    """Class 1..k+1 of each cell by its Otsu thresholds."""
    cls = F.lit(1)
    for c in otsu_thresholds(df, k, v=v, mask=mask):
        cls = cls + F.when(F.col(v) >= c, 1).otherwise(0)
    return df.withColumn(out, cls.cast("bigint"))


def kmeans(df: DataFrame, k: int, v: str = "v", out: str = "out", rounds: int = 200) -> tuple[DataFrame, list[float]]:
    """One-dimensional k-means from evenly spaced means; each round is one aggregation of k rows."""
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    means = [lo + (hi - lo) * (i + 1) / (k + 1) for i in range(k)]

    def nearest(m: list[float]):
        cls = F.lit(0)
        for i in range(1, k):
            cls = F.when(F.col(v) > (m[i - 1] + m[i]) / 2, i).otherwise(cls)
        return cls

    for _ in range(rounds):
        got = {r[0]: r[1] for r in df.groupBy(nearest(means)).agg(F.avg(v)).collect()}
        new = [got.get(i, means[i]) for i in range(k)]
        if max(abs(p - q) for p, q in zip(new, means, strict=True)) < 1e-9:
            break
        means = new
    return df.withColumn(out, (nearest(means) + 1).cast("bigint")), means
