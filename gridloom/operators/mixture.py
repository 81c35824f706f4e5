"""Mixture segmentation with priors, a Markov random field, several features and several likelihoods.

A round is one projection of the cells to posteriors and one aggregation by class, whose size depends on
classes and features only; neighbours add one scattered sum a round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import stats
from gridloom.grid import axes_of, box, scattered
from gridloom.operators import label as labels
from gridloom.plans.lineage import checkpointed

FLOOR = 1e-10


@dataclass(frozen=True)
class Options:
    """posterior: socrates (prior ** w * (likelihood * neighbours) ** (1 - w)), plato (the same, but certain priors decide), aristotle (times the distance priors) or sigmoid (priors through a logistic curve); icm: one asynchronous pass a round, by colours of cells that aren't neighbours."""

    classes: int = 3
    rounds: int = 5
    threshold: float = 1e-3
    likelihood: str = "gaussian"
    bins: int = 32
    blur: float = 1.0
    start: str = "kmeans"
    prior_weight: float = 0.0
    posterior: str = "socrates"
    sigmoid: tuple[float, float] = (0.1, 0.5)
    smoothing: float = 0.0
    radius: int = 1
    icm: bool = False
    annealing: tuple[float, float, float] | None = None
    outliers: str | None = None
    seed: int = 0


@dataclass
class Classes:
    """Of each class: weight, mean and covariance of the features, or its histograms; and of the features their ranges."""

    weight: list[float]
    mean: list[np.ndarray] = field(default_factory=list)
    cov: list[np.ndarray] = field(default_factory=list)
    histogram: list[list[np.ndarray]] = field(default_factory=list)
    ranges: list[tuple[float, float]] = field(default_factory=list)


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def _gaussian(x: list[Column], mean: np.ndarray, cov: np.ndarray) -> Column:
    """The density of several features, written out from the inverse covariance."""
    inv, n = np.linalg.inv(cov), len(mean)
    d = [c - float(m) for c, m in zip(x, mean, strict=True)]
    q = _sum([F.lit(float(inv[i, j]) * (1 if i == j else 2)) * d[i] * d[j] for i in range(n) for j in range(i, n)])
    return F.exp(-q / 2) / math.sqrt((2 * math.pi) ** n * max(np.linalg.det(cov), 1e-300))


def _parzen(x: list[Column], histograms: list[np.ndarray], ranges: list[tuple[float, float]]) -> Column:
    """The product of the features' smoothed histogram densities."""
    out = F.lit(1.0)
    for c, h, (lo, hi) in zip(x, histograms, ranges, strict=True):
        bins = len(h)
        k = F.greatest(F.lit(0), F.least(F.floor((c - lo) / max(hi - lo, 1e-300) * bins), F.lit(bins - 1))).cast("int")
        out = out * F.lit([float(v) for v in h])[k]
    return out


def boxplot(df: DataFrame, v: str = "v", k: float = 1.5, how: str = "winsorize", bins: int = 200, out: str = "out") -> DataFrame:
    """Values beyond k interquartile ranges of the quartiles, by a histogram: winsorized to those bounds, or trimmed (null)."""
    q1, q3 = stats.quantiles(df, v, [0.25, 0.75], bins)
    lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    x = F.col(v).cast("double")
    kept = F.greatest(F.lit(lo), F.least(F.lit(hi), x)) if how == "winsorize" else F.when(x.between(lo, hi), x)
    return df.withColumn(out, kept)


def grubbs(df: DataFrame, v: str = "v", alpha: float = 0.05, most: int = 50, least: int = 6, out: str = "out") -> DataFrame:
    """Values that Grubbs' test names outliers one after the other become null: each test takes the value furthest from the mean of those left."""
    now = df.filter(F.col(v).isNotNull()).agg(F.count(v), F.sum(v), F.sum(F.col(v).cast("double") ** 2)).first()
    n, s, s2 = now[0], now[1] or 0.0, now[2] or 0.0
    far = lambda f: [r[0] for r in df.select(F.col(v).cast("double").alias("v")).filter("v IS NOT NULL").orderBy(f("v")).limit(most).collect()]
    low, high = far(F.asc), far(F.desc)  # the outliers are among these, as only the ends are ever tested
    lo, hi = 0, 0
    while n >= least and lo + hi < most:
        mean = s / n
        sd = math.sqrt(max((s2 - n * mean * mean) / (n - 1), 0.0))
        a, b = low[lo] if lo < len(low) else mean, high[hi] if hi < len(high) else mean
        worst = a if mean - a >= b - mean else b
        t = stats.t_quantile(1 - alpha / (2 * n), n - 2)
        if sd == 0 or abs(worst - mean) / sd <= (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t)):
            break
        lo, hi = (lo + 1, hi) if worst == a else (lo, hi + 1)
        n, s, s2 = n - 1, s - worst, s2 - worst * worst
    x = F.col(v).cast("double")
    out_ = F.lit(False)
    if lo:
        out_ = out_ | (x <= low[lo - 1])
    if hi:
        out_ = out_ | (x >= high[hi - 1])
    return df.withColumn(out, F.when(~out_, x))


def start(df: DataFrame, values: list[str], o: Options, priors: DataFrame | None) -> DataFrame:
    """(axes, label) of the first classes: kmeans, otsu or random ones of the first feature, or the priors' greatest."""
    axes = axes_of(df)
    if o.start == "priors" and priors is not None:
        best = priors.groupBy(*axes).agg(F.max(F.struct("p", (-F.col("label")).alias("l"))).alias("b"))
        return df.select(*axes).join(best, axes, "left").select(*axes, F.coalesce(-F.col("b.l"), F.lit(1)).cast("int").alias("label"))
    if o.start == "otsu":
        return labels.otsu(df, o.classes - 1, values[0]).select(*axes, F.col("out").cast("int").alias("label"))
    if o.start == "random":
        return df.select(*axes, (F.pmod(F.xxhash64(F.lit(o.seed), *axes), F.lit(o.classes)) + 1).cast("int").alias("label"))
    return labels.kmeans(df, o.classes, values[0])[0].select(*axes, F.col("out").cast("int").alias("label"))


def _estimate(post: DataFrame, values: list[str], o: Options, ranges: list[tuple[float, float]]) -> Classes:
    """Classes from posteriors p (an array)."""
    n, k = len(values), o.classes
    ask = [F.sum(F.col("p")[c]).alias(f"w{c}") for c in range(k)]
    ask += [F.sum(F.col("p")[c] * F.col(values[i])).alias(f"m{c}_{i}") for c in range(k) for i in range(n)]
    ask += [F.sum(F.col("p")[c] * F.col(values[i]) * F.col(values[j])).alias(f"s{c}_{i}_{j}") for c in range(k) for i in range(n) for j in range(i, n)]
    r = post.agg(*ask, F.count(F.lit(1)).alias("n"), *[F.var_pop(v).alias(f"v{i}") for i, v in enumerate(values)]).first()
    out = Classes([], ranges=ranges)
    for c in range(k):
        w = max(r[f"w{c}"] or 0.0, 1e-9)
        m = np.array([(r[f"m{c}_{i}"] or 0.0) / w for i in range(n)])
        s = np.array([[(r[f"s{c}_{min(i, j)}_{max(i, j)}"] or 0.0) / w for j in range(n)] for i in range(n)]) - np.outer(m, m)
        s += np.diag([1e-6 * max(r[f"v{i}"] or 0.0, 1e-12) for i in range(n)])
        out.weight.append(w / max(r["n"], 1))
        out.mean.append(m)
        out.cov.append(s)
    if o.likelihood == "parzen":
        for c in range(k):
            out.histogram.append([])
            for i, v in enumerate(values):
                lo, hi = ranges[i]
                b = F.greatest(F.lit(0), F.least(F.floor((F.col(v) - lo) / max(hi - lo, 1e-300) * o.bins), F.lit(o.bins - 1))).cast("int")
                got = {row[0]: row[1] for row in post.groupBy(b).agg(F.sum(F.col("p")[c])).collect()}
                h = np.array([got.get(j, 0.0) for j in range(o.bins)])
                d = np.arange(-4, 5)
                g = np.exp(-(d**2) / (2 * o.blur**2))
                h = np.convolve(h, g / g.sum(), "same")
                out.histogram[c].append(np.maximum(h / max(h.sum(), 1e-300) * o.bins / max(hi - lo, 1e-300), FLOOR))
    return out


def _posterior(rows: DataFrame, values: list[str], o: Options, classes: Classes, t: int) -> Column:
    x = [F.col(v) for v in values]
    parts = []
    for c in range(o.classes):
        like = _parzen(x, classes.histogram[c], classes.ranges) if o.likelihood == "parzen" else _gaussian(x, classes.mean[c], classes.cov[c])
        like = F.greatest(like * float(classes.weight[c]), F.lit(FLOOR))
        near = F.greatest(F.exp(o.smoothing * F.col("near")[c]), F.lit(FLOOR)) if o.smoothing > 0 else F.lit(1.0)
        p = like * near
        if "prior" in rows.columns and o.prior_weight > 0:
            prior = F.greatest(F.col("prior")[c], F.lit(FLOOR))
            if o.posterior == "sigmoid":
                prior = 1 / (1 + F.exp(-(F.col("prior")[c] - o.sigmoid[1]) / o.sigmoid[0]))
            p = F.pow(prior, F.lit(o.prior_weight)) * F.pow(p, F.lit(1 - o.prior_weight))
            if o.posterior == "aristotle" and "distance" in rows.columns:
                p = p * F.greatest(F.col("distance")[c], F.lit(FLOOR))
            if o.posterior == "plato":
                sure = F.array_max("prior") >= 1
                p = F.when(sure, (F.col("prior")[c] >= 1).cast("double")).otherwise(p)
        if o.annealing:
            first, rate, last = o.annealing
            p = F.pow(p, F.lit(1 / max(first * rate**t, last)))
        parts.append(p)
    total = _sum(parts)
    return F.array(*[F.when(total > 0, p / total).otherwise(1.0 / o.classes) for p in parts])


def _neighbours(post: DataFrame, axes: list[str], o: Options) -> DataFrame:
    """(axes, near): of each class the neighbours' probabilities, weighted by the inverse of their distance, as a share of all."""
    offsets = box(axes, o.radius, centre=False)
    rows = scattered(post.select(*axes, F.col("p").alias("_p")), offsets, axes, {"_w": [1 / math.sqrt(sum(d * d for d in q)) for q in offsets]})
    got = rows.groupBy(*axes).agg(F.sum("_w").alias("_t"), *[F.sum(F.col("_w") * F.col("_p")[c]).alias(f"_{c}") for c in range(o.classes)])
    full = post.select(*axes).join(got, axes, "left")
    return full.select(*axes, F.array(*[F.coalesce(F.col(f"_{c}") / F.col("_t"), F.lit(0.0)) for c in range(o.classes)]).alias("near"))


def segment(df: DataFrame, values: list[str], o: Options = Options(), priors: DataFrame | None = None, distances: DataFrame | None = None) -> tuple[DataFrame, Classes]:  # noqa: B008
    """((axes, label, p), classes). priors and distances: axes, label (1..classes), p; absent ones are 0. Of equal probabilities the class of less weight wins."""
    axes, k = axes_of(df), o.classes
    base = df.select(*axes, *[F.col(v).cast("double").alias(v) for v in values])
    for v in values:
        if o.outliers == "boxplot":
            base = boxplot(base, v, out=v)
        elif o.outliers == "grubbs":
            base = grubbs(base, v, out=v)
    base = base.dropna(subset=values)
    for name, extra in (("prior", priors), ("distance", distances)):
        if extra is not None:
            wide = extra.groupBy(*axes).agg(F.array(*[F.coalesce(F.max(F.when(F.col("label") == c + 1, F.col("p"))), F.lit(0.0)) for c in range(k)]).alias(name))
            base = base.join(wide, axes, "left").withColumn(name, F.coalesce(name, F.lit([0.0] * k)))
    base = checkpointed(base)
    bounds = base.agg(*[f(v) for v in values for f in (F.min, F.max)]).first()
    ranges = [(bounds[2 * i], bounds[2 * i + 1]) for i in range(len(values))]
    first = start(base, values, o, priors)
    post = checkpointed(base.join(first, axes).withColumn("p", F.array(*[(F.col("label") == c + 1).cast("double") for c in range(k)])).drop("label"))
    classes, before = _estimate(post, values, o, ranges), None
    for t in range(o.rounds):
        rows = base if o.smoothing <= 0 else base.join(_neighbours(post, axes, o), axes)
        if o.icm and o.smoothing > 0:
            post = _coloured(base, post, values, o, classes, t)
        else:
            post = checkpointed(rows.withColumn("p", _posterior(rows, values, o, classes, t)).drop("near"))
        classes = _estimate(post, values, o, ranges)
        sure = post.agg(F.avg(F.array_max("p"))).first()[0]
        if before is not None and abs(sure - before) < o.threshold:
            break
        before = sure
    return post.select(*axes, _label(classes, k).alias("label"), F.array_max("p").alias("p")), classes


def _label(classes: Classes, k: int) -> Column:
    order = sorted(range(k), key=lambda c: (classes.weight[c], c))
    out, top = F.lit(0), F.array_max("p")
    for c in reversed(order):
        out = F.when(F.col("p")[c] >= top, c + 1).otherwise(out)
    return out.cast("bigint")


def _coloured(base: DataFrame, post: DataFrame, values: list[str], o: Options, classes: Classes, t: int) -> DataFrame:
    """One pass of conditional modes: cells of one colour, no two of which are neighbours, take their label from the labels around them; then the next colour."""
    axes, side = axes_of(base), o.radius + 1
    colour = F.lit(0)
    for a in axes:
        colour = colour * side + F.pmod(F.col(a), F.lit(side))
    for c in range(side ** len(axes)):
        hard = post.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(o.classes - 1)), lambda i: (F.array_position("p", F.array_max("p")) == i + 1).cast("double")))
        rows = base.join(_neighbours(hard, axes, o), axes)
        new = rows.withColumn("_n", _posterior(rows, values, o, classes, t)).select(*axes, "_n")
        post = checkpointed(post.join(new, axes).withColumn("p", F.when(colour == c, F.col("_n")).otherwise(F.col("p"))).drop("_n"))
    return post
