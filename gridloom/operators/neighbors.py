"""Nearest neighbours of points, and densities of kernels shaped by them.

Points lie in buckets of a grid; a point meets the buckets around its own, and keeps its k nearest if these are closer than one side, as
nothing outside can be. The others meet buckets of twice the side, and so on, until the buckets hold everything. Of many points in
one place, k + 1 stand for all, so copies meet only those. While many points are left and no bucket holds very many, the others' copies
are sent to the buckets around them, so that a point's pairs are made and ranked where it is; else the points left are sent.

Edge cases: a point isn't its own neighbour; of equal distances the least id is nearer; fewer than k other points give fewer neighbours;
points with a null or non-finite coordinate, or a null id, are left out; ids are unique whole numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.lineage import checkpointed

_DEALT = 64
#: The most points of a bucket that are ranked in one task.
_TOGETHER = 10_000


def _least(rows: DataFrame, by: list[str], order: list, k: int, dealt: str | None = None) -> DataFrame:
    """The k first rows of each group; with ``dealt``, first of each of _DEALT parts of it, so that a large group isn't sorted in one task."""
    if dealt:
        part = F.pmod(F.xxhash64(dealt), F.lit(_DEALT))
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, part).orderBy(*order))).filter(F.col("_n") <= k)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= k)


def nearest(points: DataFrame, k: int, coords: list[str], id_: str = "id") -> DataFrame:
    """(id, rank, other, d2, o_<coord>): the k nearest other points of each point, their squared distances and places; exact."""
    d, axes = len(coords), [f"c{i}" for i in range(len(coords))]
    held = points.select(F.col(id_).cast("bigint").alias("id"), *[F.col(c).cast("double").alias(a) for c, a in zip(coords, axes, strict=True)])
    fine = F.col("id").isNotNull()
    for a in axes:
        fine = fine & (F.abs(F.col(a)) < float("inf"))
    held = checkpointed(held.filter(fine))
    box = held.agg(F.count(F.lit(1)), *[f(a) for a in axes for f in (F.min, F.max)]).first()
    n, spans = box[0], [hi - lo for lo, hi in zip(box[1::2], box[2::2], strict=True)] if box[0] else [0.0]
    extent = max(spans) or 1.0
    # k + 1 of each place are enough for its own points and for others
    source = checkpointed(_least(held, axes, [F.col("id")], k + 1, "id").drop("_n"))
    side = extent * (max(k, 1) / max(n, 1)) ** (1 / max(1, sum(s > 0 for s in spans)))
    around: list[tuple[int, ...]] = [()]
    for _ in axes:
        around = [(*o, s) for o in around for s in (-1, 0, 1)]
    step = F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"s{i}") for i, s in enumerate(o)]) for o in around]))
    todo, found = held, []
    names = ["id", "rank", "other", "d2", *(f"o_{c}" for c in coords)]
    size = source.count()
    for _ in range(30):  # until a point's bucket holds few on average: points may crowd in a part of the extent
        held_by = source.groupBy(*[F.floor(F.col(a) / side).alias(a) for a in axes]).agg(F.count(F.lit(1)).cast("double").alias("m"))
        if n == 0 or held_by.agg(F.sum(F.col("m") ** 2) / F.sum("m")).first()[0] <= 4 * max(k, 1):
            break
        side /= 2
    while n:
        last = side >= 2 * extent
        buckets = [F.floor(F.col(a) / side).cast("bigint").alias(f"b{i}") for i, a in enumerate(axes)]
        theirs = source.select(F.col("id").alias("other"), *[F.col(a).alias(f"o{i}") for i, a in enumerate(axes)], *buckets)
        mine = todo.select("id", *axes, *buckets)
        near = [(F.col(f"b{i}") + F.col(f"_s.s{i}")).alias(f"b{i}") for i in range(d)]
        at = [f"b{i}" for i in range(d)]
        if 2 * n >= size and mine.groupBy(*at).count().agg(F.max("count")).first()[0] <= _TOGETHER:
            theirs = theirs.withColumn("_s", step).select("other", *[f"o{i}" for i in range(d)], *near)
            by = [*at, "id"]
        else:
            mine = mine.withColumn("_s", step).select("id", *axes, *near)
            by = ["id"]
        d2 = sum(((F.col(a) - F.col(f"o{i}")) ** 2 for i, a in enumerate(axes)), F.lit(0.0))
        pairs = mine.hint("merge").join(theirs, at).filter("id <> other").withColumn("d2", d2)
        if not last:  # farther ones decide nothing in this round
            pairs = pairs.filter(F.col("d2") < side * side)
        top = _least(pairs, by, [F.col("d2"), F.col("other")], k)
        kept = F.lit(True) if last else F.count(F.lit(1)).over(Window.partitionBy(*by)) == k
        got = checkpointed(top.withColumn("_kept", kept).filter("_kept").select("id", F.col("_n").alias("rank"), "other", "d2", *[F.col(f"o{i}").alias(f"o_{c}") for i, c in enumerate(coords)]).select(names))
        found.append(got)
        if last:
            break
        todo = checkpointed(todo.join(got.filter("rank = 1").select("id"), "id", "left_anti"))
        n = todo.count()
        side *= 2
    out = points.sparkSession.createDataFrame([], "id bigint, rank int, other bigint, d2 double" + "".join(f", `o_{c}` double" for c in coords))
    for got in found:
        out = out.union(got)
    return out


def local_covariances(points: DataFrame, k: int, coords: list[str], sigma: float, id_: str = "id", near: DataFrame | None = None) -> DataFrame:
    """(id, coords, s<i><j>): per point the covariance of its k nearest others about it, with sigma squared on the diagonal."""
    d = len(coords)
    near = nearest(points, k, coords, id_) if near is None else near
    own = points.select(F.col(id_).cast("bigint").alias("id"), *[F.col(c).cast("double").alias(c) for c in coords])
    gap = lambda i: F.col(f"o_{coords[i]}") - F.col(coords[i])
    sums = near.join(own, "id").groupBy("id", *coords).agg(*[F.avg(gap(i) * gap(j)).alias(f"s{i}{j}") for i in range(d) for j in range(i + 1)])
    return sums.select("id", *coords, *[(F.col(f"s{i}{j}") + (sigma * sigma if i == j else 0.0)).alias(f"s{i}{j}") for i in range(d) for j in range(i + 1)])


def _log_normal(gaps: list[Column], entry) -> Column:
    """Log density of a normal of covariance entry(i, j) at gaps from its mean: by its Cholesky factor, written out."""
    d = len(gaps)
    lower: list[list[Column]] = [[F.lit(0.0)] * d for _ in range(d)]
    for i in range(d):
        for j in range(i + 1):
            rest = entry(i, j)
            for m in range(j):
                rest = rest - lower[i][m] * lower[j][m]
            lower[i][j] = F.sqrt(rest) if i == j else rest / lower[j][j]
    out, solved = F.lit(-0.5 * d * math.log(2 * math.pi)), []
    for i in range(d):
        rest = gaps[i]
        for m in range(i):
            rest = rest - lower[i][m] * solved[m]
        solved.append(rest / lower[i][i])
        out = out - F.log(lower[i][i]) - solved[i] * solved[i] / 2
    return out


def manifold_density(points: DataFrame, k: int, coords: list[str], sigma: float, id_: str = "id", log_floor: float = -700.0) -> DataFrame:
    """(id, density): at each point the mean of the kernels of its k nearest others, each a normal shaped by its own k nearest."""
    every = nearest(points, k, coords, id_)
    kernels = checkpointed(local_covariances(points, k, coords, sigma, id_, every))
    d = len(coords)
    near = every.select("id", "other")
    own = kernels.select("id", *[F.col(c).alias(f"x{i}") for i, c in enumerate(coords)])
    theirs = kernels.withColumnRenamed("id", "other")
    gaps = [F.col(f"x{i}") - F.col(c) for i, c in enumerate(coords)]
    log = _log_normal(gaps, lambda i, j: F.col(f"s{i}{j}"))
    del d
    return near.join(own, "id").join(theirs, "other").groupBy("id").agg(F.avg(F.exp(F.greatest(log, F.lit(log_floor)))).alias("density"))
