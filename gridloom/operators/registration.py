"""Registration: linear maps by pattern search over one aggregation a step, and deformable fields.

All candidate maps of a step are scored in one plan: each cell reads the moving image at every
candidate's place, and the metric is one aggregation by candidate. Deformable models keep dense fields
of the image's cells; a round reads, forces, smooths and composes by joins, cut by checkpoints.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import axes_of, box, dealt, scattered, unbroadcast
from gridloom.operators import spline, transforms
from gridloom.operators.neighborhood import central_differences, gaussian, gaussian_columns
from gridloom.plans.lineage import checkpointed

Matrix = list[list[float]]


def shrink(image: DataFrame, factor: int, v: str = "v") -> DataFrame:
    """Block means; indices are those of the coarse grid."""
    axes = axes_of(image)
    return image.groupBy(*[F.floor(F.col(a) / factor).cast("bigint").alias(a) for a in axes]).agg(F.avg(v).alias("v"))


def scores(fixed: DataFrame, moving: DataFrame, maps: list[Matrix], metric: str = "msq", bins: int = 16) -> list[float]:
    """The metric of each map, the lower the better: msq (mean squares), gc (minus correlation), mi (minus mutual information of a joint histogram). Cells that a map takes out of the moving image don't count."""
    axes = axes_of(fixed)
    n = len(axes)
    held = F.array(*[F.array(*[F.lit(float(x)) for row in m for x in row]) for m in maps])
    base = dealt(fixed.select(*axes, F.col("v").cast("double").alias("v"))).select(*axes, "v", F.posexplode(held).alias("c", "_m"))
    place = [sum((F.col("_m")[i * (n + 1) + j] * F.col(a) for j, a in enumerate(axes)), F.col("_m")[i * (n + 1) + n]) for i in range(n)]
    at = base.select("c", *axes, "v", *[p.alias(f"_p{a}") for a, p in zip(axes, place, strict=True)])
    parts = []
    for k in range(2**n):
        w, index = F.lit(1.0), []
        for i, a in enumerate(axes):
            up, f = k >> i & 1, F.col(f"_p{a}") - F.floor(f"_p{a}")
            w = w * (f if up else 1 - f)
            index.append((F.floor(f"_p{a}") + up).cast("bigint").alias(f"_{a}"))
        parts.append(F.struct(w.alias("w"), *index))
    corners = at.withColumn("_c", F.explode(F.array(*parts))).select("c", *axes, "v", "_c.*").filter("w > 0")
    there = moving.select(*[F.col(a).alias(f"_{a}") for a in axes], F.col("v").cast("double").alias("_v"))
    both = corners.join(unbroadcast(there), [f"_{a}" for a in axes]).groupBy("c", *axes, "v").agg(F.sum(F.col("w") * F.col("_v")).alias("m"), F.sum("w").alias("w")).filter("w > 1 - 1e-9")
    if metric == "mi":
        lo, hi = fixed.agg(F.min("v"), F.max("v")).first(), moving.agg(F.min("v"), F.max("v")).first()
        cell = lambda c, r: F.least(F.floor((F.col(c) - r[0]) / max(r[1] - r[0], 1e-300) * bins), F.lit(bins - 1)).cast("int")
        joint = both.groupBy("c", cell("v", lo).alias("i"), cell("m", hi).alias("j")).agg(F.count(F.lit(1)).alias("k"))  # at most bins * bins rows a map
        over = lambda *by: F.sum("k").over(Window.partitionBy("c", *by))
        term = joint.withColumns({"n": over(), "a": over("i"), "b": over("j")})
        got = term.groupBy("c").agg((-F.sum(F.col("k") / F.col("n") * F.log(F.col("k") * F.col("n") / (F.col("a") * F.col("b"))))).alias("s"))
    else:
        value = F.avg((F.col("v") - F.col("m")) ** 2) if metric == "msq" else -F.corr("v", "m")
        got = both.groupBy("c").agg(value.alias("s"))
    by = {r["c"]: r["s"] for r in got.collect()}
    return [math.inf if by.get(i) is None or math.isnan(by[i]) else by[i] for i in range(len(maps))]


def matrix_of(kind: str, p: list[float], centre: list[float]) -> Matrix:
    """A 2-D map about a centre from its parameters: translation (tx, ty), rigid (angle, ..), similarity (log scale, angle, ..), composite_affine (angle, two log scales, shear, ..), affine (the matrix minus the identity, ..)."""
    *linear, tx, ty = p
    if kind == "translation":
        a = np.eye(2)
    elif kind == "affine":
        a = np.eye(2) + np.reshape(linear, (2, 2))
    else:
        angle = linear[0] if kind != "similarity" else linear[1]
        turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
        if kind == "rigid":
            a = turn
        elif kind == "similarity":
            a = math.exp(linear[0]) * turn
        else:
            a = turn @ np.diag(np.exp(linear[1:3])) @ np.array([[1.0, linear[3]], [0.0, 1.0]])
    c = np.asarray(centre)
    return np.hstack([a, (c - a @ c + [tx, ty])[:, None]]).tolist()


#: Linear parameters of each kind, before the two of its shift.
LINEAR = {"translation": 0, "rigid": 1, "similarity": 2, "composite_affine": 4, "affine": 4}


def linear(fixed: DataFrame, moving: DataFrame, kind: str = "rigid", metric: str = "msq", levels: tuple[tuple[int, float], ...] = ((2, 1.0), (1, 0.0)), steps: int = 8, start: list[float] | None = None) -> tuple[Matrix, list[float], float]:
    """(map, parameters, metric): levels of (shrink factor, smoothing); a step scores a move up and down of each parameter in one plan, takes the best, and halves the moves where none helps."""
    n = LINEAR[kind]
    p = list(start or [0.0] * (n + 2))
    best = math.inf
    for factor, sigma in levels:
        ready = lambda df: checkpointed(shrink(gaussian(df, sigma) if sigma > 0 else df, factor) if factor > 1 else (gaussian(df, sigma) if sigma > 0 else df))  # noqa: B023, E731
        a, b = ready(fixed.select("x", "y", "v")), ready(moving.select("x", "y", "v"))
        size = a.agg(F.max("x"), F.max("y")).first()
        centre = [s / 2 for s in size]
        in_cells = lambda q: matrix_of(kind, [*q[:n], q[n] / factor, q[n + 1] / factor], centre)  # noqa: B023, E731
        reach = [0.1] * n + [2.0 * factor] * 2
        best = scores(a, b, [in_cells(p)], metric)[0]
        for _ in range(steps):
            tries = [[x + (d * reach[i] if i == j else 0) for i, x in enumerate(p)] for j in range(len(p)) for d in (-1, 1)]
            got = scores(a, b, [in_cells(q) for q in tries], metric)
            k = int(np.argmin(got))
            if got[k] < best:
                p, best = tries[k], got[k]
            else:
                reach = [r / 2 for r in reach]
    centre = [s / 2 for s in fixed.agg(F.max("x"), F.max("y")).first()]
    return matrix_of(kind, p, centre), p, best


# Deformable models.
def force(fixed: DataFrame, moved: DataFrame, metric: str = "msq", radius: int = 2) -> DataFrame:
    """(axes, u<axis>): where each cell of the moved image should read instead: demons for msq, the gradient of the local correlation for cc."""
    axes = axes_of(fixed)
    g = central_differences(moved.select(*axes, F.col("v").cast("double").alias("v"))).withColumnRenamed("v", "_m")
    rows = fixed.select(*axes, F.col("v").cast("double").alias("v")).join(unbroadcast(g), axes)
    if metric == "msq":
        gap = F.col("v") - F.col("_m")
        size = sum((F.col(f"g{a}") ** 2 for a in axes), F.lit(0.0)) + gap**2
        return rows.select(*axes, *[F.when(size > 1e-9, gap * F.col(f"g{a}") / size).otherwise(0.0).alias(f"u{a}") for a in axes])
    near = scattered(rows.select(*axes, F.col("v").alias("_a"), F.col("_m").alias("_b")), box(axes, radius), axes)
    local = near.groupBy(*axes).agg(F.avg("_a").alias("ma"), F.avg("_b").alias("mb"), F.covar_pop("_a", "_b").alias("ab"), F.var_pop("_a").alias("aa"), F.var_pop("_b").alias("bb"), F.count(F.lit(1)).alias("n"))
    both = rows.join(unbroadcast(local), axes)
    a, b = F.col("v") - F.col("ma"), F.col("_m") - F.col("mb")
    pull = 2 * F.col("ab") / (F.col("aa") * F.col("bb")) * (a - F.col("ab") / F.col("bb") * b)
    ok = (F.col("aa") > 1e-9) & (F.col("bb") > 1e-9)
    return both.select(*axes, *[F.when(ok, pull * F.col(f"g{x}")).otherwise(0.0).alias(f"u{x}") for x in axes])


def _scaled(u: DataFrame, step: float) -> DataFrame:
    """The update with its longest vector of ``step`` cells, where it is longer."""
    axes = axes_of(u)
    size = F.sqrt(sum((F.col(f"u{a}") ** 2 for a in axes), F.lit(0.0)))
    top = u.agg(F.max(size).alias("_top"))
    k = F.when(F.col("_top") > step, step / F.col("_top")).otherwise(1.0)
    return u.crossJoin(F.broadcast(top)).select(*axes, *[(F.col(f"u{a}") * k).alias(f"u{a}") for a in axes])


def regularised(u: DataFrame, how: str, amount: float) -> DataFrame:
    """A field smoothed by a gaussian (amount: sigma) or by its spline (amount: spans along an axis)."""
    axes = axes_of(u)
    if amount <= 0:
        return u
    if how == "bspline":
        return spline.smooth_field(u, int(amount), still=True)
    return gaussian_columns(u, amount, [f"u{a}" for a in axes])


def _zero(image: DataFrame) -> DataFrame:
    axes = axes_of(image)
    return image.select(*axes, *[F.lit(0.0).alias(f"u{a}") for a in axes])


def _sum(u: DataFrame, v: DataFrame, k: float = 1.0) -> DataFrame:
    axes = axes_of(u)
    other = v.select(*axes, *[F.col(f"u{a}").alias(f"_{a}") for a in axes])
    return u.join(unbroadcast(other), axes).select(*axes, *[(F.col(f"u{a}") + k * F.col(f"_{a}")).alias(f"u{a}") for a in axes])


@dataclass(frozen=True)
class Deformation:
    """forward: the field of the fixed image's cells into the moving image; parts: a model's own fields."""

    forward: DataFrame
    parts: tuple[DataFrame, ...]


def displacement(fixed: DataFrame, moving: DataFrame, rounds: int = 5, metric: str = "msq", how: str = "gaussian", update: float = 1.0, total: float = 0.0, step: float = 0.5, radius: int = 2) -> Deformation:
    """One dense field: each round adds the smoothed update by composition and smooths the whole; with how "bspline" the smoothing is a spline's, and with total spans alone the field is a free-form lattice."""
    now = _zero(fixed)
    for _ in range(rounds):
        moved = checkpointed(transforms.warp_field(moving, now))
        u = _scaled(regularised(force(fixed, moved, metric, radius), how, update), step)
        now = checkpointed(regularised(checkpointed(transforms.compose_fields(checkpointed(u), now)), how, total))
    return Deformation(now, (now,))


def exponential(fixed: DataFrame, moving: DataFrame, rounds: int = 5, metric: str = "msq", how: str = "gaussian", update: float = 1.0, total: float = 0.5, step: float = 0.5, squarings: int = 3, radius: int = 2) -> Deformation:
    """A stationary velocity field, whose exponential is the deformation."""
    velocity = _zero(fixed)
    for _ in range(rounds):
        moved = checkpointed(transforms.warp_field(moving, transforms.exponential(velocity, squarings)))
        u = _scaled(regularised(force(fixed, moved, metric, radius), how, update), step)
        velocity = checkpointed(regularised(checkpointed(_sum(velocity, u)), how, total))
    return Deformation(transforms.exponential(velocity, squarings), (velocity,))


def symmetric(fixed: DataFrame, moving: DataFrame, rounds: int = 5, metric: str = "msq", how: str = "gaussian", update: float = 1.0, total: float = 0.0, step: float = 0.25, radius: int = 2, inverse_rounds: int = 5) -> Deformation:
    """Two fields from a middle space, one into each image, moved by the same step against each other; forward goes back along the first and on along the second."""
    a, b = _zero(fixed), _zero(fixed)
    for _ in range(rounds):
        one, two = checkpointed(transforms.warp_field(fixed, a)), checkpointed(transforms.warp_field(moving, b))
        ub = _scaled(regularised(force(one, two, metric, radius), how, update), step)
        ua = _scaled(regularised(force(two, one, metric, radius), how, update), step)
        a = checkpointed(regularised(checkpointed(transforms.compose_fields(checkpointed(ua), a)), how, total))
        b = checkpointed(regularised(checkpointed(transforms.compose_fields(checkpointed(ub), b)), how, total))
    back = transforms.invert_field(a, inverse_rounds)
    return Deformation(checkpointed(transforms.compose_fields(back, b)), (a, b))


def velocity(fixed: DataFrame, moving: DataFrame, times: int = 2, rounds: int = 3, metric: str = "msq", how: str = "gaussian", update: float = 1.0, step: float = 0.5, radius: int = 2) -> Deformation:
    """A velocity field at ``times`` points of time; each round compares the images at every point of time and moves the velocity there, smoothed over time by its neighbours."""
    fields = [_zero(fixed) for _ in range(times)]

    def flow(parts: list[DataFrame]) -> DataFrame:
        out = _zero(fixed)
        for v in parts:
            out = checkpointed(transforms.compose_fields(out, _sum(_zero(fixed), v, 1 / times)))
        return out

    for _ in range(rounds):
        new = []
        for k in range(times):
            ahead = flow(fields[k:])
            behind = flow([_sum(_zero(fixed), v, -1.0) for v in reversed(fields[:k])])
            here = checkpointed(transforms.warp_field(fixed, behind))
            there = checkpointed(transforms.warp_field(moving, ahead))
            new.append(checkpointed(_sum(fields[k], _scaled(regularised(force(here, there, metric, radius), how, update), step))))
        fields = [checkpointed(_sum(_sum(_zero(fixed), new[k], 0.5), _sum(_sum(_zero(fixed), new[max(0, k - 1)], 0.25), new[min(times - 1, k + 1)], 0.25))) for k in range(times)]
    return Deformation(flow(fields), tuple(fields))


MODELS = {
    "GaussianDisplacementField": lambda f, m, **k: displacement(f, m, **k),
    "BSplineDisplacementField": lambda f, m, **k: displacement(f, m, **{"how": "bspline", "update": 8, **k}),
    "BSpline": lambda f, m, **k: displacement(f, m, **{"how": "bspline", "update": 0, "total": 6, **k}),
    "SyN": lambda f, m, **k: symmetric(f, m, **k),
    "BSplineSyN": lambda f, m, **k: symmetric(f, m, **{"how": "bspline", "update": 8, **k}),
    "Exponential": lambda f, m, **k: exponential(f, m, **k),
    "BSplineExponential": lambda f, m, **k: exponential(f, m, **{"how": "bspline", "update": 8, "total": 8, **k}),
    "TimeVaryingVelocityField": lambda f, m, **k: velocity(f, m, **k),
    "TimeVaryingBSplineVelocityField": lambda f, m, **k: velocity(f, m, **{"how": "bspline", "update": 8, **k}),
}


def register(fixed: DataFrame, moving: DataFrame, stages: list[tuple[str, dict]], levels: tuple[tuple[int, float], ...] = ((2, 1.0), (1, 0.0))) -> tuple[DataFrame, Matrix]:
    """Stages by transform name, linear ones first: (field of fixed into moving, the linear map). Each deformable stage starts from what the stages before reached."""
    names = {"Translation": "translation", "Rigid": "rigid", "Similarity": "similarity", "Affine": "affine", "CompositeAffine": "composite_affine"}
    m: Matrix = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    axes = axes_of(fixed)
    field = None
    for name, options in stages:
        if name in names:
            if field is not None:
                raise ValueError("linear stages come before deformable ones")
            read = checkpointed(transforms.warp_affine(moving, fixed, m))
            more, _, _ = linear(fixed, read, names[name], levels=levels, **options)
            m = transforms.compose(m, more)
        else:
            read = checkpointed(transforms.warp_affine(moving, fixed, m) if field is None else transforms.warp_field(checkpointed(transforms.warp_affine(moving, fixed, m)), field))
            got = MODELS[name](fixed, read, **options).forward
            field = got if field is None else checkpointed(transforms.compose_fields(got, field))
    field = _zero(fixed) if field is None else field
    at = [F.col(a) + F.col(f"u{a}") for a in axes]
    return field.select(*axes, *[(p - F.col(a)).alias(f"u{a}") for a, p in zip(axes, transforms.affine(at, m), strict=True)]), m
