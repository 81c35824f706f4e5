"""Time-series operations over rows (axes, t, v); absent cells stay absent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.grid import axes_of
from gridloom.plans.lineage import checkpointed


def _cells(df: DataFrame) -> list[str]:
    return [a for a in axes_of(df) if a != "t"]


def subset(df: DataFrame, n: int, length: int) -> DataFrame:
    """n evenly spaced volumes, floor(i * T / n), renumbered; several may repeat one."""
    picks = df.sparkSession.range(n).select(F.col("id").alias("_i"), F.least(F.floor(F.col("id") * length / n), F.lit(length - 1)).cast("bigint").alias("t"))
    return df.join(F.broadcast(picks), "t").withColumn("t", F.col("_i")).drop("_i")


def split_alternating(df: DataFrame, odd: bool, length: int) -> DataFrame:
    """The even or the odd time points, renumbered; a last unpaired one is left out."""
    return df.filter((F.col("t") % 2 == int(odd)) & (F.col("t") < 2 * (length // 2))).withColumn("t", F.expr("t div 2"))


def simple_subtraction(df: DataFrame, v: str = "v", mean: bool = False) -> DataFrame:
    """v[2t] - v[2t + 1] where both are there; mean averages over t."""
    pair = df.groupBy(*_cells(df), F.expr("t div 2").alias("t")).agg(F.max(F.when(F.col("t") % 2 == 0, F.col(v))).alias("a"), F.max(F.when(F.col("t") % 2 == 1, F.col(v))).alias("b"))
    out = pair.filter("a IS NOT NULL AND b IS NOT NULL").select(*_cells(df), "t", (F.col("a") - F.col("b")).alias("v"))
    return out.groupBy(*_cells(df)).agg(F.avg("v").alias("v")) if mean else out


def interpolation_subtraction(df: DataFrame, v: str = "v") -> DataFrame:
    """Control minus label at inner times, the absent kind interpolated linearly from the neighbours in time (even times are control)."""
    w = Window.partitionBy(*_cells(df)).orderBy("t")
    near = df.withColumns({"p": F.lag(v).over(w), "q": F.lead(v).over(w), "tp": F.lag("t").over(w), "tq": F.lead("t").over(w)})
    inner = near.filter((F.col("tp") == F.col("t") - 1) & (F.col("tq") == F.col("t") + 1))
    d = F.col(v) - (F.col("p") + F.col("q")) / 2
    return inner.select(*_cells(df), "t", F.when(F.col("t") % 2 == 0, d).otherwise(-d).alias("v"))


def mask_series(df: DataFrame, mask: DataFrame, v: str = "v", m: str = "mask") -> DataFrame:
    """0 over the whole series where the mask is 0 or absent."""
    axes = _cells(df)
    return df.join(mask.select(*axes, F.col(m).alias("_m")), axes, "left").withColumn(v, F.when(F.coalesce("_m", F.lit(0)) != 0, F.col(v)).otherwise(0.0)).drop("_m")


def average_over(df: DataFrame, v: str = "v", plus_one: bool = False) -> DataFrame:
    """The mean over t; plus_one divides by one more than the number of volumes."""
    return df.groupBy(*_cells(df)).agg((F.sum(v) / (F.count(v) + int(plus_one))).alias("v"))


def leverage(df: DataFrame, k: int, v: str = "v") -> DataFrame:
    """Per t: raw leverage, the mean over cells of |v - cell mean| / T, and its relative distance to the k times before and after."""
    cells = _cells(df)
    means = df.groupBy(*cells).agg(F.avg(v).alias("_m"))
    length = df.agg(F.count_distinct("t").alias("_t"))
    raw = df.join(means, cells).groupBy("t").agg(F.avg(F.abs(F.col(v) - F.col("_m"))).alias("_d")).crossJoin(F.broadcast(length)).select("t", (F.col("_d") / F.col("_t")).alias("raw_leverage"))
    frame = Window.orderBy("t").rowsBetween(-k, k - 1)  # one row a time point
    near = (F.sum("raw_leverage").over(frame) - F.col("raw_leverage")) / (F.count("raw_leverage").over(frame) - 1)
    return raw.withColumn("k_neighbors_distance", F.abs(F.col("raw_leverage") - near) / near)


def region_correlation(df: DataFrame, label: str = "label", v: str = "v", min_size: int = 0) -> DataFrame:
    """Pearson correlation of the mean signals of each pair of labels whose regions have more than min_size cells."""
    cells = _cells(df)
    sizes = df.filter(F.col(label) != 0).groupBy(label).agg(F.count_distinct(*cells).alias("n")).filter(F.col("n") > min_size)
    signal = df.filter(F.col(label) != 0).join(sizes.select(label), label, "left_semi").groupBy(F.col(label).alias("l"), "t").agg(F.avg(v).alias("s"))
    a, b = signal.select(F.col("l").alias("a"), "t", F.col("s").alias("sa")), signal.select(F.col("l").alias("b"), "t", F.col("s").alias("sb"))
    return a.join(b, "t").filter("a < b").groupBy("a", "b").agg(F.corr("sa", "sb").alias("r"))


def to_matrix(df: DataFrame, v: str = "v") -> DataFrame:
    """Rows t, values: the cells in scan order as one array; absent cells leave no place."""
    place = F.struct(*[F.col(a) for a in reversed(_cells(df))], F.col(v).alias("_v"))
    return df.groupBy("t").agg(F.array_sort(F.collect_list(place)).alias("m")).select("t", F.col("m._v").alias("values"))


def temporal_sd(df: DataFrame, v: str = "v") -> DataFrame:
    return df.groupBy(*_cells(df)).agg(F.stddev_pop(v).alias("sd"), F.avg(v).alias("mean"), F.count(v).alias("n"))


def comp_cor(df: DataFrame, components: int = 4, share: float = 0.95, bins: int = 50, v: str = "v") -> DataFrame:
    """Per t: the global signal and the leading components of the cells whose temporal deviation exceeds the ``share`` quantile of a histogram.

    The covariance of time points is T x T, whatever the number of cells: its entries are sums over
    cells, aggregated in Spark; only they reach the driver for the eigenvectors.
    """
    cells = _cells(df)
    sd = temporal_sd(df, v)
    lo, hi, n = sd.agg(F.min("sd"), F.max("sd"), F.count("sd")).first()
    k = F.least(F.floor((F.col("sd") - lo) / max(hi - lo, 1e-12) * bins), F.lit(bins - 1)).cast("int")
    cut, seen = hi, 0
    for b, c in sorted((r[0], r[1]) for r in sd.groupBy(k).agg(F.count(F.lit(1))).collect()):
        seen += c
        if seen >= share * n:
            cut = lo + b * (hi - lo) / bins
            break
    noisy = df.join(sd.filter(F.col("sd") >= cut).select(*cells, "mean"), cells).select(*cells, "t", (F.col(v) - F.col("mean")).alias("d"))
    pairs = noisy.alias("a").join(noisy.alias("b"), cells).filter("a.t <= b.t").groupBy(F.col("a.t").alias("i"), F.col("b.t").alias("j")).agg(F.sum(F.col("a.d") * F.col("b.d")).alias("c"))
    signal = {r["t"]: r["g"] for r in df.groupBy("t").agg(F.avg(v).alias("g")).collect()}
    times = sorted(signal)
    at = {t: i for i, t in enumerate(times)}
    cov = np.zeros((len(times), len(times)))
    for r in pairs.collect():
        cov[at[r["i"]], at[r["j"]]] = cov[at[r["j"]], at[r["i"]]] = r["c"]
    _, vectors = np.linalg.eigh(cov)
    lead = vectors[:, ::-1][:, :components]
    lead = lead * np.where(lead[np.abs(lead).argmax(0), range(lead.shape[1])] < 0, -1, 1)
    rows = [(t, float(signal[t]), *map(float, lead[i])) for t, i in at.items()]
    return df.sparkSession.createDataFrame(rows, "t bigint, global double, " + ", ".join(f"comp{i + 1} double" for i in range(lead.shape[1])))


# Constants of the labelling models, in ms.
PASL = {"lambda": 0.9, "alpha": 0.95, "t1a": 1650.0, "ti1": 600.0, "slice": 42.0}
PCASL = {"lambda": 0.9, "alpha": 0.85, "t1a": 1650.0, "t1t": 1300.0, "tau": 2100.0, "w": 700.0}


def pasl(df: DataFrame, m0: float, v: str = "v", control_first: bool = True) -> DataFrame:
    """Mean over odd t of lambda * dM / (2 alpha M0 TI1 exp(-TI2 / T1a)), TI2 = TI1 + 42 t."""
    c = PASL
    w = Window.partitionBy(*_cells(df)).orderBy("t")
    d = F.lag(v).over(w) - F.col(v) if control_first else F.col(v) - F.lag(v).over(w)
    odd = df.withColumns({"_d": d, "_p": F.lag("t").over(w)}).filter((F.col("t") % 2 == 1) & (F.col("_p") == F.col("t") - 1))
    flow = c["lambda"] * F.col("_d") / (2 * c["alpha"] * m0 * c["ti1"] * F.exp(-(c["ti1"] + c["slice"] * F.col("t")) / c["t1a"]))
    return odd.groupBy(*_cells(df)).agg(F.avg(flow).alias("cbf"))


def pcasl(df: DataFrame, m0: float, v: str = "v") -> DataFrame:
    """Mean over odd t of -lambda * dM / (4 alpha M0 T1t (exp(-(tau + w) / T1a) - exp(-w / T1t)))."""
    from math import exp

    c = PCASL
    w = Window.partitionBy(*_cells(df)).orderBy("t")
    odd = df.withColumns({"_d": F.col(v) - F.lag(v).over(w), "_p": F.lag("t").over(w)}).filter((F.col("t") % 2 == 1) & (F.col("_p") == F.col("t") - 1))
    scale = -c["lambda"] / (4 * c["alpha"] * m0 * c["t1t"] * (exp(-(c["tau"] + c["w"]) / c["t1a"]) - exp(-c["w"] / c["t1t"])))
    return odd.groupBy(*_cells(df)).agg(F.avg(F.col("_d") * scale).alias("cbf"))


def slice_timing(df: DataFrame, shift: float, slice_axis: str, v: str = "v") -> DataFrame:
    """Each slice's series read at t + shift * slice, linearly between neighbours; 0 outside."""
    at = F.col("t") + shift * F.col(slice_axis)
    low = F.floor(at).cast("bigint")
    points = df.select(*_cells(df), "t", low.alias("_k"), (at - low).alias("_f"))
    value = lambda n: df.select(*_cells(df), F.col("t").alias("_k"), F.col(v).alias(n))
    got = points.join(value("_a"), [*_cells(df), "_k"], "left").withColumn("_k", F.col("_k") + 1).join(value("_b"), [*_cells(df), "_k"], "left")
    mixed = F.when(F.col("_f") == 0, F.col("_a")).otherwise(F.col("_a") * (1 - F.col("_f")) + F.col("_b") * F.col("_f"))
    return got.select(*_cells(df), "t", F.coalesce(mixed, F.lit(0.0)).alias("v"))


def framewise_displacement(params: DataFrame, points: DataFrame) -> DataFrame:
    """Per t the mean and greatest distance that mask points move against the time before; params: t and a row-major affine a (2 x 3)."""
    move = [sum((F.col("a")[3 * i + j] * F.col(f"p{j}") for j in range(2)), F.col("a")[3 * i + 2]) for i in range(2)]
    at = params.crossJoin(points).select("t", "p0", "p1", move[0].alias("x"), move[1].alias("y"))  # params has one row a time point
    w = Window.partitionBy("p0", "p1").orderBy("t")
    d = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    return at.withColumn("d", d).groupBy("t").agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean_displacement"), F.coalesce(F.max("d"), F.lit(0.0)).alias("max_displacement"))


def residual(df: DataFrame, regressors: DataFrame, names: list[str], v: str = "v") -> DataFrame:
    """(axes, t, v): each cell's series less its least-squares fit on a constant and regressors (t and the named columns), over the times that the cell has.

    A cell's normal equations are sums over its times, solved in Arrow batches of cells.
    """
    cells, n = _cells(df), len(names) + 1
    rows = df.join(F.broadcast(regressors.select("t", *names)), "t").withColumn("_r", F.array(F.lit(1.0), *[F.col(c).cast("double") for c in names]))  # one row a time point
    sums = [F.sum(F.col("_r")[i] * F.col("_r")[j]) for i in range(n) for j in range(i, n)] + [F.sum(F.col("_r")[i] * F.col(v)) for i in range(n)]
    fits = rows.groupBy(*cells).agg(F.array(*sums).alias("_s"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(s: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(r, float) for r in s])
        m = np.zeros((len(x), n, n))
        at = np.triu_indices(n)
        m[:, at[0], at[1]] = m[:, at[1], at[0]] = x[:, : len(at[0])]
        return pd.Series(list(np.einsum("nij,nj->ni", np.linalg.pinv(m, hermitian=True), x[:, len(at[0]) :])))

    held = fits.select(*cells, solve("_s").alias("_b"))
    fit = sum((F.col("_b")[i] * F.col("_r")[i] for i in range(n)), F.lit(0.0))
    return rows.join(held, cells).select(*cells, "t", (F.col(v) - fit).alias("v"))


def tissue_confounds(df: DataFrame, label: str = "label", csf: int = 3, wm: int = 1, components: int = 2, v: str = "v") -> DataFrame:
    """Per t: the global signal and the leading noise components of two tissues' cells (columns csf1.., wm1..)."""
    whole = df.filter(F.col(label) > 0)
    out = whole.groupBy("t").agg(F.avg(v).alias("global"))
    for name, k in (("csf", csf), ("wm", wm)):
        part = comp_cor(whole.filter(F.col(label) == k).drop(label), components, v=v)
        out = out.join(part.select("t", *[F.col(f"comp{i + 1}").alias(f"{name}{i + 1}") for i in range(components)]), "t", "left")
    return out


def region_similarity(df: DataFrame, length: int, label: str = "label", v: str = "v", ridge: float = 0.1) -> DataFrame:
    """(a, b, r): of each pair of labels how far the leading patterns over time of their cells agree, from 0 to 1: the greatest canonical correlation of the two regions' series, regularised.

    Of a region Spark sums the products of times over its cells (length x length numbers); the pairs are
    solved on the driver. Absent times count as the cell's mean.
    """
    from gridloom.operators.models import moments

    cells = _cells(df)
    use = df.filter(F.col(label) != 0)
    names = sorted(r[0] for r in use.select(label).distinct().collect())
    at = F.map_from_entries(F.collect_list(F.struct("t", F.col(v).cast("double"))))
    series = use.groupBy(label, *cells).agg(at.alias("_m"), F.avg(v).alias("_a"))
    series = series.select(label, F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(length - 1).cast("bigint")), lambda t: F.coalesce(F.col("_m")[t] - F.col("_a"), F.lit(0.0))).alias("values"))
    roots = {}
    for k in names:
        _, _, outer = moments(series.filter(F.col(label) == k))
        h = outer @ np.linalg.inv(outer + ridge * max(np.trace(outer), 1e-300) / length * np.eye(length))
        w, q = np.linalg.eigh((h + h.T) / 2)
        roots[k] = (q * np.sqrt(np.maximum(w, 0))) @ q.T
    rows = [(int(a), int(b), float(np.linalg.norm(roots[a] @ roots[b], 2))) for i, a in enumerate(names) for b in names[i + 1 :]]
    return df.sparkSession.createDataFrame(rows, "a bigint, b bigint, r double")


def region_sparse_cca(df: DataFrame, share_a: float = 0.5, share_b: float = 0.5, rounds: int = 5, label: str = "label", v: str = "v") -> tuple[DataFrame, DataFrame]:
    """(a, b, r) and (a, b, side, axes, loading) of each pair of labels a < b: the leading sparse canonical directions of their cells over time.

    All pairs go at once. A round sums each pair's cells of one side to a series, sums that series back to the cells of the other side, and
    soft-thresholds these to a share of the region's cells, at unit length; it starts from the variances of a's cells. Absent times count as the cell's mean; labels
    without a common time are no pair; a pair without any variance has r 0. A pair's cells of one side are ranked in one window.
    """
    cells = _cells(df)
    use = df.filter((F.col(label) != 0) & F.col(v).isNotNull()).select(F.col(label).alias("l"), *cells, "t", F.col(v).cast("double").alias("v"))
    series = checkpointed(use.withColumn("e", F.col("v") - F.avg("v").over(Window.partitionBy("l", *cells))).drop("v"))
    sizes = series.select("l", *cells).distinct().groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    seen = series.select("l", "t").distinct()
    pairs = checkpointed(seen.withColumnRenamed("l", "a").join(seen.withColumnRenamed("l", "b"), "t").filter("a < b").select("a", "b").distinct())

    def scaled(z: DataFrame, side: str, share: float | None) -> DataFrame:
        """z (a, b, cells, w), thresholded where there is a share, at unit length."""
        pair = Window.partitionBy("a", "b")
        if share is not None:
            z = z.join(sizes.withColumnRenamed("l", side), side).withColumn("_k", F.greatest(F.floor(share * F.col("n") + 0.5), F.lit(1)))
            z = z.withColumn("_r", F.row_number().over(pair.orderBy(F.desc(F.abs("w")))))
            cut = F.coalesce(F.max(F.when(F.col("_r") == F.col("_k") + 1, F.abs("w"))).over(pair), F.lit(0.0))
            z = z.withColumn("w", F.signum("w") * F.greatest(F.abs("w") - cut, F.lit(0.0)))
        size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(pair))
        return checkpointed(z.select("a", "b", *cells, F.when(size > 0, F.col("w") / size).otherwise(0.0).alias("w")))

    def summed(u: DataFrame, side: str) -> DataFrame:
        return series.withColumnRenamed("l", side).join(u.filter("w <> 0"), [side, *cells]).groupBy("a", "b", "t").agg(F.sum(F.col("e") * F.col("w")).alias("s"))

    def back(s: DataFrame, side: str) -> DataFrame:
        return series.withColumnRenamed("l", side).join(s, [side, "t"]).groupBy("a", "b", *cells).agg(F.sum(F.col("e") * F.col("s")).alias("w"))

    spread = series.groupBy(F.col("l").alias("a"), *cells).agg(F.sum(F.col("e") * F.col("e")).alias("w"))
    u, w = scaled(pairs.join(spread, "a"), "a", None), None
    for _ in range(rounds):
        w = scaled(back(summed(u, "a"), "b"), "b", share_b)
        u = scaled(back(summed(w, "b"), "a"), "a", share_a)
    s, t = summed(u, "a"), summed(w, "b").withColumnRenamed("s", "q")
    sums = s.join(t, ["a", "b", "t"], "full").groupBy("a", "b").agg(F.sum(F.col("s") * F.col("q")).alias("_st"), F.sum(F.col("s") * F.col("s")).alias("_ss"), F.sum(F.col("q") * F.col("q")).alias("_tt"))
    r = F.when(F.col("_ss") * F.col("_tt") > 0, F.coalesce("_st", F.lit(0.0)) / F.sqrt(F.col("_ss") * F.col("_tt"))).otherwise(0.0)
    found = pairs.join(sums, ["a", "b"], "left").select("a", "b", F.coalesce(r, F.lit(0.0)).alias("r"))
    side = lambda x, name: x.filter("w <> 0").select("a", "b", F.lit(name).alias("side"), *cells, F.col("w").alias("loading"))
    return found, side(u, "a").union(side(w, "b"))


def volumes(df: DataFrame) -> DataFrame:
    """n: the number of volumes."""
    return df.agg(F.count_distinct("t").alias("n"))
