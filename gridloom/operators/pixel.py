"""Cell-wise operations: projections over one image, or over two joined on their axes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Geometry, axes_of


def aligned(a: DataFrame, b: DataFrame, value: str = "v", other: str = "w") -> DataFrame:
    """Two images with the second's value as ``other``."""
    axes = axes_of(a)
    return a.join(b.select(*axes, F.col(value).alias(other)), axes)


#: Binary operations of two values.
BINARY = {
    "m": lambda a, b: a * b,
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "pow": lambda a, b: F.pow(a, b),
    "exp": lambda a, b: F.exp(a * b),
    "max": lambda a, b: F.greatest(a, b),
    "abs": lambda a, b: F.abs(a),
    "addtozero": lambda a, b: F.when(a == 0, a + b).otherwise(a),
    "overadd": lambda a, b: F.when(b != 0, b).otherwise(a),
    "decision": lambda a, b: 1 / (1 + F.exp(-(a - 0.25) / b)),
    # where the divisor isn't positive there is no quotient; see divide_carried for the scan-order form
    "div": lambda a, b: F.when(b > 0, a / b),
}


def binary(df: DataFrame, op: str, a: str = "v", b: str | float = "w", out: str = "out") -> DataFrame:
    """A binary operation with a column or a number."""
    other = F.col(b) if isinstance(b, str) else F.lit(float(b))
    return df.withColumn(out, BINARY[op](F.col(a), other))


def divide_carried(df: DataFrame, a: str = "v", b: str = "w", out: str = "out") -> DataFrame:
    """The quotient; where the divisor isn't positive, that of the cell before in scan order (0 at first).

    The carry runs along the fastest axis by a window; the last quotient of each line is then carried
    along the next axis, and so on, each level within one line of its axis, so that no task holds more
    than a line of cells, or of lines.
    """
    from pyspark.sql import Window

    axes = axes_of(df)
    carried = df.withColumn(out, F.when(F.col(b) > 0, F.col(a) / F.col(b)))
    tails = carried.select(*axes, F.col(out).alias("_q"))
    for k, axis in enumerate(axes):
        rest = axes[k + 1 :]
        line = Window.partitionBy(*rest).orderBy(axis)
        if k == 0:
            carried = carried.withColumn(out, F.last(out, ignorenulls=True).over(line))
        else:
            before = F.last("_q", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
            into = tails.select(axis, *rest, before.alias("_in"))
            carried = carried.join(into, [axis, *rest]).withColumn(out, F.coalesce(out, "_in")).drop("_in")
        tails = tails.groupBy(*rest).agg(F.max_by("_q", F.when(F.col("_q").isNotNull(), F.col(axis))).alias("_q")) if rest else tails
    return carried.withColumn(out, F.coalesce(out, F.lit(0.0)))


def total(df: DataFrame, geometry: Geometry, a: str = "v", b: str = "w") -> DataFrame:
    """total: sum of products; volume: that times the cell volume; mean: per cell."""
    product = F.col(a) * F.col(b)
    return df.agg(F.sum(product).alias("total"), (F.sum(product) * geometry.cell_volume).alias("volume"), (F.sum(product) / F.count(F.lit(1))).alias("mean"))


def with_stats(df: DataFrame, **stats: Column) -> DataFrame:
    """Adds scalars of the whole image to each cell: one partial aggregation, one row broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in stats.items()])))


def negate(df: DataFrame, v: str = "v", out: str = "out") -> DataFrame:
    """(1 - (v - min) / (max - min)) * (max - min); a constant image counts as min 0 and max 1."""
    s = with_stats(df, _lo=F.min(v), _hi=F.max(v))
    lo, hi = F.when(F.col("_lo") == F.col("_hi"), 0.0).otherwise(F.col("_lo")), F.when(F.col("_lo") == F.col("_hi"), 1.0).otherwise(F.col("_hi"))
    return s.withColumn(out, (1 - (F.col(v) - lo) / (hi - lo)) * (hi - lo)).drop("_lo", "_hi")


def rescale(df: DataFrame, lo: float, hi: float, v: str = "v", out: str = "out") -> DataFrame:
    """Linear to [lo, hi]; a constant image becomes lo."""
    s = with_stats(df, _lo=F.min(v), _hi=F.max(v))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return s.withColumn(out, lo + (hi - lo) * share).drop("_lo", "_hi")


def byte(df: DataFrame, v: str = "v", out: str = "out") -> DataFrame:
    return rescale(df, 0.0, 255.0, v, out).withColumn(out, F.floor(out).cast("bigint"))


def normalize(df: DataFrame, v: str = "v", out: str = "out", by_mean: bool = False, mask: str | None = None) -> DataFrame:
    """(v - min) / (max - min) with a maximum of at least 0; or divided by the mean, over mask != 0 where one is given."""
    if by_mean or mask:
        s = with_stats(df, _m=F.avg(F.when(F.col(mask) != 0, F.col(v)) if mask else F.col(v)))
        return s.withColumn(out, F.col(v) / F.col("_m")).drop("_m")
    s = with_stats(df, _lo=F.least(F.min(v), F.lit(1e9)), _hi=F.greatest(F.max(v), F.lit(0.0)))
    return s.withColumn(out, (F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def threshold_at_mean(df: DataFrame, percent: float, v: str = "v", out: str = "out") -> DataFrame:
    """1 where mean * percent <= v <= max."""
    s = with_stats(df, _m=F.avg(v), _hi=F.max(v))
    return s.withColumn(out, ((F.col(v) >= F.col("_m") * percent) & (F.col(v) <= F.col("_hi"))).cast("bigint")).drop("_m", "_hi")


def flatten_image(df: DataFrame, percent: float, v: str = "v", out: str = "out") -> DataFrame:
    s = with_stats(df, _hi=F.max(v))
    return s.withColumn(out, F.least(F.col(v), F.col("_hi") * percent)).drop("_hi")


def window(df: DataFrame, lo: float, hi: float, out_lo: float, out_hi: float, v: str = "v", out: str = "out") -> DataFrame:
    """Clamped to [lo, hi], then linear to [out_lo, out_hi]."""
    clamped = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(v)))
    return df.withColumn(out, (clamped - lo) / (hi - lo) * (out_hi - out_lo) + out_lo)


def sigmoid(df: DataFrame, alpha: float, beta: float, v: str = "v", out: str = "out") -> DataFrame:
    return df.withColumn(out, 1 / (1 + F.exp(-(F.col(v) - beta) / alpha)))


def finite(df: DataFrame, value: float = 0.0, v: str = "v", out: str = "out") -> DataFrame:
    """Not-a-numbers and infinities replaced."""
    bad = F.isnan(v) | (F.abs(F.col(v)) == float("inf"))
    return df.withColumn(out, F.when(bad, F.lit(value)).otherwise(F.col(v)))


def replace_value(df: DataFrame, lo: float, hi: float, value: float, v: str = "v", out: str = "out") -> DataFrame:
    return df.withColumn(out, F.when(F.col(v).between(lo, hi), F.lit(value)).otherwise(F.col(v)))


def threshold(df: DataFrame, lo: float, hi: float, inside: int = 1, outside: int = 0, v: str = "v", out: str = "out") -> DataFrame:
    """An inclusive band."""
    return df.withColumn(out, F.when(F.col(v).between(lo, hi), inside).otherwise(outside).cast("bigint"))


def where(df: DataFrame, value: float, v: str = "v", mask: str | None = None, tolerance: float = 1e-6) -> DataFrame:
    """The number of cells of a value, inside mask > 0 where one is given."""
    hit = F.abs(F.col(v) - value) < tolerance
    return df.filter(hit & (F.col(mask) > 0) if mask else hit).agg(F.count(F.lit(1)).alias("n"))


def truncate_intensity(df: DataFrame, lo: float = 0.025, hi: float = 0.975, bins: int = 64, mask: str | None = None, v: str = "v", out: str = "out") -> DataFrame:
    """Clamped to two quantiles, interpolated in a histogram of ``bins`` over mask >= 0.5 and v > 0."""
    use = (F.col(v) > 0) & (F.col(mask) >= 0.5) if mask else F.col(v) > 0
    kept = with_stats(df.filter(use).select(F.col(v).alias("v")), a=F.min("v"), b=F.max("v"))
    bin_ = F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("int")
    histogram = kept.groupBy(bin_.alias("k"), "a", "b").agg(F.count(F.lit(1)).alias("n"))  # at most ``bins`` rows
    rows = sorted((r["k"], r["n"], r["a"], r["b"]) for r in histogram.collect())

    def quantile(p: float) -> float:
        goal, seen = p * sum(n for _, n, _, _ in rows), 0.0
        for k, n, a, b in rows:
            if seen + n >= goal:
                return a + (k + (goal - seen) / n) * (b - a) / bins
            seen += n
        return rows[-1][3]

    return df.withColumn(out, F.greatest(F.lit(quantile(lo)), F.least(F.lit(quantile(hi)), F.col(v))))


def coordinate_components(df: DataFrame, geometry: Geometry) -> DataFrame:
    """One column of physical coordinates per axis: px, py, ..."""
    return df.withColumns({f"p{a}": c for a, c in zip(geometry.axes, geometry.physical(), strict=True)})


def hashed_uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) from a digest of the columns' values: the same on any partitioning and after a lost task."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 2**32


def hashed_normal(seed: int, *columns: str) -> Column:
    """A standard normal number from two hashed uniform ones (Box and Muller)."""
    return F.sqrt(-2 * F.log(hashed_uniform(2 * seed, *columns))) * F.cos(2 * math.pi * hashed_uniform(2 * seed + 1, *columns))


def add_noise(df: DataFrame, kind: str, seed: int, v: str = "v", out: str = "out", sd: float = 1.0, share: float = 0.01, salt: float = 0.0, pepper: float = 1.0) -> DataFrame:
    """gaussian (additive), salt_and_pepper, shot, speckle or uniform noise, by hashes of the seed and the cell."""
    x, axes = F.col(v), axes_of(df)
    u, n = hashed_uniform(seed, *axes), hashed_normal(seed, *axes)
    made = {
        "gaussian": x + n * sd,
        "uniform": x + (u - 0.5) * sd,
        "speckle": x * (1 + n * sd),
        "shot": F.greatest(F.lit(0.0), x + n * F.sqrt(F.greatest(x, F.lit(0.0)) * sd)),
        "salt_and_pepper": F.when(u < share / 2, F.lit(salt)).when(u < share, F.lit(pepper)).otherwise(x),
    }
    return df.withColumn(out, made[kind])


def vector(op: str, a: str = "a", b: str = "b") -> Column:
    """Component-wise product, sum or difference of two array columns."""
    f = {"vm": lambda x, y: x * y, "vadd": lambda x, y: x + y, "vsub": lambda x, y: x - y}[op]
    return F.zip_with(a, b, f)


def vector_total(df: DataFrame, geometry: Geometry, a: str = "a", b: str = "b") -> DataFrame:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return df.agg((F.sum(dot) * geometry.cell_volume).alias("total"))


def mtr(df: DataFrame, m0: str, m1: str, mask: str, out: str = "out") -> DataFrame:
    """clamp((m0 - m1) / m0, 0, 1) where mask > 0, else 0."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(m0) - F.col(m1)) / F.col(m0)))
    return df.withColumn(out, F.when(F.col(mask) > 0, ratio).otherwise(0.0))


def set_pixel(df: DataFrame, index: dict[str, int], value: float, v: str = "v", out: str = "out") -> DataFrame:
    hit = F.lit(True)
    for a, i in index.items():
        hit = hit & (F.col(a) == i)
    return df.withColumn(out, F.when(hit, F.lit(value)).otherwise(F.col(v)))


def image_compare(a: DataFrame, b: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """n: cells that differ by more than the tolerance, or that one image lacks; difference: the sum of their differences."""
    axes = axes_of(a)
    both = a.select(*axes, F.col("v").alias("_a")).join(b.select(*axes, F.col("v").alias("_b")), axes, "full")
    gap = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    off = F.col("_a").isNull() | F.col("_b").isNull() | (gap > tolerance)
    return both.agg(F.count(F.when(off, 1)).alias("n"), F.coalesce(F.sum(F.when(off, gap)), F.lit(0.0)).alias("difference"))
