"""Operations over a set of images on one grid: one row per image and cell, grouped by cell."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import axes_of, numbered


def average_images(df: DataFrame, normalize: bool = False, v: str = "v", image: str = "image") -> DataFrame:
    """The mean image; normalize divides each image by its mean first, where that is positive."""
    if normalize:
        means = df.groupBy(image).agg(F.avg(v).alias("_m"))
        df = df.join(means, image).withColumn(v, F.when(F.col("_m") > 0, F.col(v) / F.col("_m")).otherwise(F.col(v)))
    return df.groupBy(*axes_of(df)).agg(F.avg(v).alias("v"))


def set_statistics(df: DataFrame, v: str = "v") -> DataFrame:
    """Per cell: median, mean, max, min, variance (over n - 1), n."""
    return df.groupBy(*axes_of(df)).agg(F.median(v).alias("median"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.var_samp(v).alias("variance"), F.count(v).alias("n"))


def weighted_mean(df: DataFrame, weight: str, v: str = "v") -> DataFrame:
    return df.groupBy(*axes_of(df)).agg((F.sum(F.col(v) * F.col(weight)) / F.sum(weight)).alias("v"))


def students_t(df: DataFrame, group: str = "grp", a: int = 0, b: int = 1, v: str = "v") -> DataFrame:
    """Per cell the t statistic of two groups, with variances over n; 0 where they vanish."""
    side = lambda g, f: f(F.when(F.col(group) == g, F.col(v)))
    got = df.filter(F.col(group).isin(a, b)).groupBy(*axes_of(df)).agg(*[side(g, f).alias(f"{n}{k}") for k, g in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("s", F.var_pop), ("n", F.count))])
    spread = F.sqrt(F.col("sa") / F.col("na") + F.col("sb") / F.col("nb"))
    return got.select(*axes_of(df), F.when(spread > 0, (F.col("ma") - F.col("mb")) / spread).otherwise(0.0).alias("t"))


def majority_vote(df: DataFrame, label: str = "label", rater: str = "image", fraction: float = 0.0) -> DataFrame:
    """The label with most votes; of equals the one that reaches that number first in rater order. decided: whether its share reaches ``fraction``."""
    axes = axes_of(df)
    votes = df.groupBy(*axes, label).agg(F.count(F.lit(1)).alias("n"), F.max(rater).alias("last"))
    total = votes.groupBy(*axes).agg(F.max(F.struct("n", (-F.col("last")).alias("early"), F.col(label).alias("label"))).alias("best"), F.sum("n").alias("all"))
    return total.select(*axes, F.col("best.label").alias("label"), (F.col("best.n") >= fraction * F.col("all")).alias("decided"))


def average_labels(df: DataFrame, label: str = "label", image: str = "image") -> DataFrame:
    """Per cell and label but 0, the share of images with that label."""
    axes = axes_of(df)
    images = df.agg(F.count_distinct(image).alias("_n"))
    return df.filter(F.col(label) != 0).groupBy(*axes, label).agg(F.count(F.lit(1)).alias("_c")).crossJoin(F.broadcast(images)).select(*axes, F.col(label).alias("label"), (F.col("_c") / F.col("_n")).alias("p"))


def most_likely(df: DataFrame, sigma: float, p: str = "p", label: str = "label") -> DataFrame:
    """The label of highest probability over sigma, the first of equals; 0 where none is."""
    axes = axes_of(df)
    return df.groupBy(*axes).agg(F.max(F.when(F.col(p) > sigma, F.struct(F.col(p).alias("p"), (-F.col(label)).alias("l")))).alias("b")).select(*axes, F.coalesce(-F.col("b.l"), F.lit(0)).cast("bigint").alias("label"))


def pure_tissue(df: DataFrame, p: str = "p", image: str = "image") -> DataFrame:
    """Per cell the sum over images of p_i times the product of 1 - p_j of the others."""
    axes = axes_of(df)
    got = df.groupBy(*axes).agg(F.array_sort(F.collect_list(F.struct(image, p))).alias("a"))  # one value an image
    ps = F.col(f"a.{p}")
    term = lambda q, i: q * F.aggregate(F.transform(ps, lambda r, j: F.when(j == i, 1.0).otherwise(1 - r)), F.lit(1.0), lambda s, x: s * x)
    return got.select(*axes, F.aggregate(F.transform(ps, term), F.lit(0.0), lambda s, x: s + x).alias("w"))


def project(df: DataFrame, axis: str, how: str = "sum", v: str = "v") -> DataFrame:
    f = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}[how]
    return df.groupBy(*[a for a in axes_of(df) if a != axis]).agg(f(v).alias("v"))


def set_to_matrix(df: DataFrame, mask: DataFrame | None = None, image: str = "image", v: str = "v") -> DataFrame:
    """Rows image, values: the masked cells of each image in scan order as one array."""
    axes = axes_of(df)
    use = df.join(mask.select(*axes), axes, "left_semi") if mask is not None else df
    place = F.struct(*[F.col(a) for a in reversed(axes)], F.col(v).alias("_v"))
    return use.groupBy(image).agg(F.array_sort(F.collect_list(place)).alias("m")).select(image, F.col("m._v").alias("values"))


def vector_to_image(grid: DataFrame, values: list[float], mask: str = "mask") -> DataFrame:
    """Cells with mask >= 0.5 take the vector's values in scan order; the others are 0."""
    axes = axes_of(grid)
    spark = grid.sparkSession
    held = spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "i bigint, out double")
    inside = numbered(grid.filter(F.col(mask) >= 0.5)).join(held, "i", "left").select(*axes, "out")
    return grid.join(inside, axes, "left").withColumn("out", F.coalesce("out", F.lit(0.0)))


def random_samples(df: DataFrame, n: int, seed: int, image: str = "image") -> DataFrame:
    """n cells of each image, chosen by a digest of the seed and the cell, so that reruns choose the same."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (image, *axes_of(df))]))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(image).orderBy(order, *axes_of(df)))).filter(F.col("_r") <= n).drop("_r")


def check_tissue_labels(df: DataFrame, labels: str = "label", priors: tuple[str, ...] = ("p1", "p2", "p3")) -> DataFrame:
    """Renames labels 1..3 by the permutation with the best mean Dice overlap with the priors' argmax."""
    from itertools import permutations

    best = F.array_position(F.array(*priors), F.greatest(*priors)).cast("bigint")
    got = df.filter(F.col(labels) != 0).groupBy(labels, best.alias("best")).agg(F.count(F.lit(1)).alias("n"))  # at most nine rows
    n = {(r[0], r[1]): r["n"] for r in got.collect()}
    size = lambda k, axis: sum(c for key, c in n.items() if key[axis] == k)
    dice = lambda a, b: 2 * n.get((a, b), 0) / max(1, size(a, 0) + size(b, 1))
    order = max(permutations((1, 2, 3)), key=lambda p: (sum(dice(i + 1, p[i]) for i in range(3)), [-x for x in p]))
    new = F.col(labels)
    for i, to in enumerate(order):
        new = F.when(F.col(labels) == i + 1, to).otherwise(new)
    return df.withColumn("out", new.cast("bigint"))


def multiply_images(a: DataFrame, b: DataFrame, v: str = "v") -> DataFrame:
    axes = axes_of(a)
    return a.select(*axes, F.col(v).alias("_a")).join(b.select(*axes, F.col(v).alias("_b")), axes).select(*axes, (F.col("_a") * F.col("_b")).alias("v"))


def product(df: DataFrame, columns: list[str], out: str = "out") -> DataFrame:
    return df.withColumn(out, reduce(mul, [F.col(c) for c in columns]))
