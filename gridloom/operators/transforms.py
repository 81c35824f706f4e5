"""Spatial transforms: points, affine maps, displacement fields."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import axes_of, dealt, unbroadcast
from gridloom.operators.neighborhood import central_differences

Matrix = list[list[float]]


def affine(points: list[Column], m: Matrix) -> list[Column]:
    """Rows of m are matrix entries and an offset."""
    return [sum((F.lit(float(a)) * p for a, p in zip(row, points, strict=False)), F.lit(float(row[-1]))) for row in m]


def apply_to_points(df: DataFrame, m: Matrix, columns: list[str]) -> DataFrame:
    """The first columns mapped, the others as they are."""
    return df.withColumns(dict(zip(columns, affine([F.col(c) for c in columns], m), strict=True)))


def _full(m: Matrix) -> np.ndarray:
    return np.vstack([np.asarray(m, float), [0.0] * len(m) + [1.0]])


def compose(*maps: Matrix) -> Matrix:
    """The map that applies the last one first."""
    out = _full(maps[0])
    for m in maps[1:]:
        out = out @ _full(m)
    return out[:-1].tolist()


def invert(m: Matrix) -> Matrix:
    return np.linalg.inv(_full(m))[:-1].tolist()


def average(maps: list[Matrix], weights: list[float] | None = None) -> Matrix:
    w = np.asarray(weights or [1.0] * len(maps))
    return (np.tensordot(w / w.sum(), np.asarray(maps, float), 1)).tolist()


def rotation(axis: tuple[float, float, float], degrees: float) -> np.ndarray:
    k = np.asarray(axis, float) / np.linalg.norm(axis)
    t = np.radians(degrees)
    cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(t) * cross + (1 - np.cos(t)) * cross @ cross


def wahba(correlation: np.ndarray) -> np.ndarray:
    """The rotation closest to a correlation matrix of paired directions."""
    u, _, v = np.linalg.svd(correlation)
    d = np.diag([1.0] * (len(correlation) - 1) + [np.sign(np.linalg.det(u @ v))])
    return u @ d @ v


def fit(pairs: DataFrame, p: list[str], q: list[str], kind: str = "affine") -> Matrix:
    """The least-squares rigid or affine map from columns p to q; Spark sums the moments, of fixed size, and the driver solves."""
    n = len(p)
    names = [*p, "_1"]
    one = pairs.withColumn("_1", F.lit(1.0))
    moments = [F.sum(F.col(a) * F.col(b)) for a in names for b in names] + [F.sum(F.col(a) * F.col(b)) for a in names for b in q]
    row = list(one.agg(*[m.alias(f"m{i}") for i, m in enumerate(moments)]).first())
    pp, pq = np.reshape(row[: (n + 1) ** 2], (n + 1, n + 1)), np.reshape(row[(n + 1) ** 2 :], (n + 1, n))
    if kind == "affine":
        return np.linalg.lstsq(pp, pq, rcond=None)[0].T.tolist()
    count = pp[-1, -1]
    mp, mq = pp[-1, :-1] / count, pq[-1] / count
    r = wahba((pq[:-1] - count * np.outer(mp, mq)).T)
    return np.hstack([r, (mq - r @ mp)[:, None]]).tolist()


def landmarks(fixed: DataFrame, moving: DataFrame, label: str = "label", kind: str = "affine") -> Matrix:
    """The map between the centres of equal labels of two label images."""
    axes = axes_of(fixed)
    centre = lambda df, s: df.filter(F.col(label) != 0).groupBy(label).agg(*[F.avg(a).alias(a + s) for a in axes])
    return fit(centre(fixed, "_p").join(centre(moving, "_q"), label), [f"{a}_p" for a in axes], [f"{a}_q" for a in axes], kind)


def warp(image: DataFrame, grid: DataFrame, positions: dict[str, Column], outside: float = 0.0) -> DataFrame:
    """The image read linearly at a position of each grid cell: corners with weights, one join, one sum."""
    axes = axes_of(grid)
    base = dealt(grid.select(*axes, *[positions[a].alias(f"_p{a}") for a in axes]))
    corners = [()]
    for _ in axes:
        corners = [(*c, k) for c in corners for k in (0, 1)]
    parts = []
    for c in corners:
        weight, index = F.lit(1.0), []
        for a, k in zip(axes, c, strict=True):
            f = F.col(f"_p{a}") - F.floor(f"_p{a}")
            weight = weight * (f if k else 1 - f)
            index.append((F.floor(f"_p{a}") + k).cast("bigint").alias(f"_{a}"))
        parts.append(F.struct(weight.alias("w"), *index))
    rows = base.withColumn("_c", F.explode(F.array(*parts))).select(*axes, "_c.*").filter("w > 0")
    values = image.select(*[F.col(a).alias(f"_{a}") for a in axes], F.col("v").cast("double").alias("v"))
    got = rows.join(unbroadcast(values), [f"_{a}" for a in axes]).groupBy(*axes).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return grid.select(*axes).join(unbroadcast(got), axes, "left").select(*axes, F.coalesce("v", F.lit(float(outside))).alias("v"))


def warp_values(image: DataFrame, grid: DataFrame, positions: dict[str, Column], values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Several columns of an image (vectors, tensors' components) read linearly at a position of each grid cell, for each value of ``by`` (a time); 0 outside."""
    axes = axes_of(grid)
    base = dealt(grid.select(*axes, *[positions[a].alias(f"_p{a}") for a in axes]))
    parts = []
    for k in range(2 ** len(axes)):
        weight, index = F.lit(1.0), []
        for i, a in enumerate(axes):
            f = F.col(f"_p{a}") - F.floor(f"_p{a}")
            weight = weight * (f if k >> i & 1 else 1 - f)
            index.append((F.floor(f"_p{a}") + (k >> i & 1)).cast("bigint").alias(f"_{a}"))
        parts.append(F.struct(weight.alias("w"), *index))
    rows = base.withColumn("_c", F.explode(F.array(*parts))).select(*axes, "_c.*").filter("w > 0")
    there = image.select(*[F.col(a).alias(f"_{a}") for a in axes], *by, *[F.col(v).cast("double").alias(v) for v in values])
    got = rows.join(unbroadcast(there), [f"_{a}" for a in axes]).groupBy(*axes, *by).agg(*[F.sum(F.col("w") * F.col(v)).alias(v) for v in values])
    cells = grid.select(*axes)
    if by:
        cells = cells.crossJoin(F.broadcast(image.select(*by).distinct()))  # the points of time
    return cells.join(unbroadcast(got), [*axes, *by], "left").select(*axes, *by, *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def warp_series(series: DataFrame, grid: DataFrame, m: Matrix, v: str = "v") -> DataFrame:
    """Each volume of a series through one map."""
    axes = axes_of(grid)
    return warp_values(series, grid, dict(zip(axes, affine([F.col(a).cast("double") for a in axes], m), strict=True)), [v], ("t",))


def warp_tensors(image: DataFrame, grid: DataFrame, m: Matrix, t: str = "t") -> DataFrame:
    """Tensors through an affine map: their logarithms are read linearly, and the tensors turned by the inverse map's rotation; outside they are the identity."""
    from gridloom.operators import tensor

    axes = axes_of(grid)
    logs = image.select(*axes, tensor.log_tensor(t).alias("_l")).select(*axes, *[F.col("_l")[i].alias(f"l{i}") for i in range(6)])
    got = warp_values(logs, grid, dict(zip(axes, affine([F.col(a).cast("double") for a in axes], m), strict=True)), [f"l{i}" for i in range(6)])
    n = len(axes)
    turn = np.eye(3)
    turn[:n, :n] = polar(np.linalg.inv(np.asarray(m, float)[:, :n]))[0]
    out = got.select(*axes, tensor.exp_tensor(F.array(*[f"l{i}" for i in range(6)])).alias(t))
    return tensor.rotate(out, turn.tolist(), t).select(*axes, F.col("out").alias(t))


def positions(grid: DataFrame, stack: list[Matrix | DataFrame]) -> DataFrame:
    """(axes, p<axis>): where each cell goes by a stack of affine maps and displacement fields, the last one first."""
    from gridloom.plans.lineage import checkpointed

    axes = axes_of(grid)
    now = grid.select(*axes, *[F.col(a).cast("double").alias(f"p{a}") for a in axes])
    for t in reversed(stack):
        if isinstance(t, DataFrame):
            held = checkpointed(now)
            read = warp_values(t, held, {a: F.col(f"p{a}") for a in axes}, [f"u{a}" for a in axes])
            now = held.join(read, axes).select(*axes, *[(F.col(f"p{a}") + F.col(f"u{a}")).alias(f"p{a}") for a in axes])
        else:
            now = now.select(*axes, *[q.alias(f"p{a}") for a, q in zip(axes, affine([F.col(f"p{a}") for a in axes], t), strict=True)])
    return now


def field_of(grid: DataFrame, stack: list[Matrix | DataFrame]) -> DataFrame:
    """The dense displacement field of a stack."""
    axes = axes_of(grid)
    return positions(grid, stack).select(*axes, *[(F.col(f"p{a}") - F.col(a)).alias(f"u{a}") for a in axes])


def polar(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotation nearest to a matrix and the stretch left: a = rotation @ stretch."""
    r = wahba(a)
    return r, r.T @ a


def average_no_rigid(maps: list[Matrix], weights: list[float] | None = None) -> Matrix:
    """The weighted mean of the maps' stretches alone, without their rotations and shifts."""
    w = np.asarray(weights or [1.0] * len(maps))
    n = len(maps[0])
    stretch = np.tensordot(w / w.sum(), np.array([polar(np.asarray(m, float)[:, :n])[1] for m in maps]), 1)
    return np.hstack([stretch, np.zeros((n, 1))]).tolist()


def describe(m: Matrix) -> dict[str, float]:
    """A map's determinant, turn in degrees (2-D), scale of volume and shift length."""
    a = np.asarray(m, float)
    n = len(a)
    r, s = polar(a[:, :n])
    out = {"determinant": float(np.linalg.det(a[:, :n])), "shift": float(np.linalg.norm(a[:, n])), "stretch": float(np.abs(np.linalg.det(s)) ** (1 / n))}
    return out | ({"degrees": float(np.degrees(np.arctan2(r[1, 0], r[0, 0])))} if n == 2 else {})


def difference(a: Matrix, b: Matrix, points: DataFrame, p: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """How far two maps take points apart: mean and max."""
    x, y = affine([F.col(c) for c in p], a), affine([F.col(c) for c in p], b)
    d = F.sqrt(sum(((u - v) ** 2 for u, v in zip(x, y, strict=True)), F.lit(0.0)))
    return points.agg(F.avg(d).alias("mean"), F.max(d).alias("max"))


def make_field(parts: list[DataFrame], still_border: bool = False) -> DataFrame:
    """A displacement field of component images (axes, v); still_border: 0 on the image's border."""
    axes = axes_of(parts[0])
    out = parts[0].select(*axes)
    for a, part in zip(axes, parts, strict=True):
        out = out.join(part.select(*axes, F.col("v").cast("double").alias(f"u{a}")), axes)
    return border_still(out) if still_border else out


def border_still(field: DataFrame) -> DataFrame:
    axes = axes_of(field)
    ends = field.agg(*[f(a).alias(f"_{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    edge = F.lit(False)
    for a in axes:
        edge = edge | (F.col(a) == F.col(f"_lo{a}")) | (F.col(a) == F.col(f"_hi{a}"))
    return field.crossJoin(F.broadcast(ends)).select(*axes, *[F.when(edge, 0.0).otherwise(F.col(f"u{a}")).alias(f"u{a}") for a in axes])


def smooth_field(field: DataFrame, sigma: float) -> DataFrame:
    """Gaussian smoothing of each component, the border still."""
    from gridloom.operators.neighborhood import gaussian_columns

    return border_still(gaussian_columns(field, sigma, [f"u{a}" for a in axes_of(field)]))


def simulate_field(grid: DataFrame, seed: int, sd: float = 1.0, spans: int = 4, kind: str = "bspline", smoothing: float = 4.0) -> DataFrame:
    """A random field whose border is still: the spline of hashed normal moves, or the exponential of smoothed ones."""
    from gridloom.operators import spline
    from gridloom.operators.pixel import hashed_normal

    axes = axes_of(grid)
    raw = grid.select(*axes, *[(hashed_normal(seed + i, *axes) * sd).alias(f"u{a}") for i, a in enumerate(axes)])
    return spline.smooth_field(raw, spans, still=True) if kind == "bspline" else exponential(smooth_field(raw, smoothing), 3)


def geometric_jacobian(field: DataFrame) -> DataFrame:
    """(x, y, v): the area that the square from each cell to its next neighbours has after a 2-D field, by its corners; cells without all three have no row."""
    p = field.select("x", "y", (F.col("x") + F.col("ux")).alias("_x"), (F.col("y") + F.col("uy")).alias("_y"))
    from gridloom.grid import scattered

    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    rows = scattered(p, corners, ["x", "y"], {"_k": [0, 1, 2, 3]}).groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("_k", "_x", "_y"))).alias("c")).filter(F.size("c") == 4)
    x, y = (lambda i: F.col("c")[i % 4]["_x"]), (lambda i: F.col("c")[i % 4]["_y"])
    area = sum((x(i) * y(i + 1) - x(i + 1) * y(i) for i in range(4)), F.lit(0.0)) / 2
    return rows.select("x", "y", area.alias("v"))


def keep_direction(field: DataFrame, vectors: DataFrame) -> DataFrame:
    """2-D vectors (axes, a, b) turned as a field's jacobian turns them, with their length."""
    out = vectors
    for u in ("ux", "uy"):
        d = central_differences(field.select("x", "y", F.col(u).alias("v")))
        out = out.join(d.select("x", "y", F.col("gx").alias(f"{u}_x"), F.col("gy").alias(f"{u}_y")), ["x", "y"])
    p, q = (1 + F.col("ux_x")) * F.col("a") + F.col("ux_y") * F.col("b"), F.col("uy_x") * F.col("a") + (1 + F.col("uy_y")) * F.col("b")
    size, now = F.sqrt(F.col("a") ** 2 + F.col("b") ** 2), F.sqrt(p**2 + q**2)
    k = F.when(now > 0, size / now).otherwise(0.0)
    return out.select("x", "y", (p * k).alias("a"), (q * k).alias("b"))


def integrate_velocity(fields: list[DataFrame], grid: DataFrame, steps: int = 4) -> DataFrame:
    """The displacement after unit time along velocity fields at evenly spaced times, linear between them, in equal steps."""
    from gridloom.plans.lineage import checkpointed

    axes = axes_of(grid)
    now = grid.select(*axes, *[F.lit(0.0).alias(f"u{a}") for a in axes])
    for s in range(steps):
        t = (s + 0.5) / steps * (len(fields) - 1)
        k = min(int(t), max(0, len(fields) - 2))
        f = t - k
        here = fields[k].select(*axes, *[(F.col(f"u{a}") * ((1 - f) / steps)).alias(f"u{a}") for a in axes])
        if len(fields) > 1 and f > 0:
            other = fields[k + 1].select(*axes, *[(F.col(f"u{a}") * (f / steps)).alias(f"_{a}") for a in axes])
            here = here.join(other, axes).select(*axes, *[(F.col(f"u{a}") + F.col(f"_{a}")).alias(f"u{a}") for a in axes])
        now = checkpointed(compose_fields(now, here))
    return now


def rotate_directions(directions: DataFrame, maps: DataFrame) -> DataFrame:
    """Gradient directions (t, dx, dy, dz) turned by the rotation r (nine numbers) of the motion at their time."""
    b = ("dx", "dy", "dz")
    turned = [sum((F.col("r")[3 * i + j] * F.col(c) for j, c in enumerate(b)), F.lit(0.0)) for i in range(3)]
    return directions.join(maps.select("t", "r"), "t").select("t", *[v.alias(c) for v, c in zip(turned, b, strict=True)])


def warp_affine(image: DataFrame, grid: DataFrame, m: Matrix) -> DataFrame:
    axes = axes_of(grid)
    return warp(image, grid, dict(zip(axes, affine([F.col(a).cast("double") for a in axes], m), strict=True)))


def warp_field(image: DataFrame, field: DataFrame) -> DataFrame:
    """field: axes and u<axis>."""
    axes = axes_of(field)
    return warp(image, field, {a: F.col(a) + F.col(f"u{a}") for a in axes})


def jacobian(field: DataFrame, log: bool = False) -> DataFrame:
    """The determinant of a 2-D field's deformation gradient, floored at 0; log floors it at 0.001 and takes the logarithm."""
    out = field.select("x", "y")
    for u in ("ux", "uy"):
        d = central_differences(field.select("x", "y", F.col(u).alias("v")))
        out = out.join(d.select("x", "y", F.col("gx").alias(f"{u}_x"), F.col("gy").alias(f"{u}_y")), ["x", "y"])
    det = F.greatest((1 + F.col("ux_x")) * (1 + F.col("uy_y")) - F.col("ux_y") * F.col("uy_x"), F.lit(0.0))
    return out.select("x", "y", (F.log(F.greatest(det, F.lit(0.001))) if log else det).alias("v"))


def inverse_error(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Per cell |u(p) + w(p + u(p))|: how far a field and its inverse miss the cell."""
    axes = axes_of(forward)
    out = forward.join(_read_field(backward, forward), axes)
    return out.select(*axes, F.sqrt(sum(((F.col(f"u{a}") + F.col(f"_w{a}")) ** 2 for a in axes), F.lit(0.0))).alias("v"))


def lipschitz(field: DataFrame, reach: int = 1) -> DataFrame:
    """Per cell the greatest |u(p) - u(q)| / |p - q| over cells within ``reach``; lipschitz_all takes every other cell."""
    from gridloom.grid import box, scattered

    axes = axes_of(field)
    u = [f"u{a}" for a in axes]
    offsets = box(axes, reach, centre=False)
    near = scattered(field.select(*axes, *[F.col(c).alias(f"_{c}") for c in u]), offsets, axes, {"_r": [sum(d * d for d in o) ** 0.5 for o in offsets]})
    d = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in u), F.lit(0.0))) / F.col("_r")
    return field.hint("merge").join(unbroadcast(near), axes).groupBy(*axes).agg(F.max(d).alias("v"))


def lipschitz_all(field: DataFrame, side: int = 32) -> DataFrame:
    """Per cell the greatest |u(p) - u(q)| / |p - q| over all other cells.

    Cells are dealt into tiles. A tile's box of places and box of values bound its ratio to any cell, so a
    cell is compared with the cells of touching tiles, and of a further tile only where that bound
    exceeds what the cell has found so far; tiles are solved pair by pair, never all pairs at once.
    """
    from gridloom.plans.lineage import checkpointed

    axes = axes_of(field)
    u, t = [f"u{a}" for a in axes], [f"_t{a}" for a in axes]
    cells = checkpointed(field.select(*axes, *u, *[F.floor(F.col(a) / side).cast("bigint").alias(n) for a, n in zip(axes, t, strict=True)]))
    ends = [f(c).alias(f"{n}{c}") for c in (*axes, *u) for n, f in (("lo_", F.min), ("hi_", F.max))]
    boxes = cells.groupBy(*t).agg(*ends)
    d = lambda a, b: F.sqrt(sum(((F.col(x) - F.col(y)) ** 2 for x, y in zip(a, b, strict=True)), F.lit(0.0)))
    pair = cells.select(*[F.col(c).alias(f"q_{c}") for c in (*axes, *u, *t)])
    ratio = F.when(d(axes, [f"q_{a}" for a in axes]) > 0, d(u, [f"q_{c}" for c in u]) / d(axes, [f"q_{a}" for a in axes])).otherwise(0.0)
    offsets = [()]
    for _ in axes:
        offsets = [(*o, k) for o in offsets for k in (-1, 0, 1)]
    reach = F.explode(F.array(*[F.struct(*[(F.col(n) + k).alias(f"q_{n}") for n, k in zip(t, o, strict=True)]) for o in offsets]))
    near = cells.withColumn("_o", reach).select(*axes, *u, *t, "_o.*").join(pair, [f"q_{n}" for n in t])
    found = checkpointed(near.groupBy(*axes, *u, *t).agg(F.max(ratio).alias("v")))
    # the tiles that may hold more for a tile: none farther than the widest gap of values over the least that its cells have found
    ends = boxes.agg(*[F.min(n).alias(f"min{n}") for n in t], *[F.max(n).alias(f"max{n}") for n in t], F.sqrt(sum(((F.max(f"hi_{c}") - F.min(f"lo_{c}")) ** 2 for c in u), F.lit(0.0))).alias("_wide"))
    least = found.groupBy(*t).agg(F.min("v").alias("_least")).crossJoin(F.broadcast(ends))  # one row
    tiles = F.when((F.col("_least") > 0) & ~F.isnan("_wide"), F.col("_wide") / F.when(F.col("_least") > 0, F.col("_least")) / side + 1)
    most = F.greatest(*[F.col(f"max{n}") - F.col(f"min{n}") for n in t], F.lit(0))
    turn = least.withColumn("_k", F.least(F.coalesce(F.ceil(tiles).cast("bigint"), most), most))
    for n in t:
        turn = turn.withColumn(f"q_{n}", F.explode(F.sequence(F.greatest(F.col(n) - F.col("_k"), f"min{n}"), F.least(F.col(n) + F.col("_k"), f"max{n}"))))
    far = F.lit(False)
    for n in t:
        far = far | (F.abs(F.col(n) - F.col(f"q_{n}")) > 1)
    other = boxes.select(*[F.col(n).alias(f"q_{n}") for n in t], *[c for c in boxes.columns if c not in t])
    own = boxes.select(*t, *[F.col(c).alias(f"o{c}") for c in boxes.columns if c not in t])
    apart = lambda c: F.greatest(F.col(f"lo_{c}") - F.col(f"ohi_{c}"), F.col(f"olo_{c}") - F.col(f"hi_{c}"), F.lit(0.0))
    spread = lambda c: F.greatest(F.abs(F.col(f"hi_{c}") - F.col(f"olo_{c}")), F.abs(F.col(f"ohi_{c}") - F.col(f"lo_{c}")))
    over = lambda wide, gaps: F.sqrt(sum((wide(c) ** 2 for c in u), F.lit(0.0))) / F.sqrt(sum((gaps(a) ** 2 for a in axes), F.lit(0.0)))
    pairs = turn.filter(far).select(*t, "_least", *[f"q_{n}" for n in t]).join(unbroadcast(own), t).join(unbroadcast(other), [f"q_{n}" for n in t])
    pairs = pairs.filter(over(spread, apart) * (1 + 1e-9) > F.col("_least")).select(*t, *other.columns)
    # what a further tile could give a cell at most: the farthest value over the nearest place
    gap = lambda c: F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0))
    span = lambda c: F.greatest(F.abs(F.col(f"hi_{c}") - F.col(c)), F.abs(F.col(c) - F.col(f"lo_{c}")))
    ask = found.hint("merge").join(unbroadcast(pairs), t).filter(over(span, gap) > F.col("v"))
    more = ask.select(*axes, *u, *[f"q_{n}" for n in t]).join(pair, [f"q_{n}" for n in t]).groupBy(*axes).agg(F.max(ratio).alias("_m"))
    return found.select(*axes, "v").join(more, axes, "left").select(*axes, F.greatest("v", F.coalesce("_m", F.lit(0.0))).alias("v"))


def reflection(df: DataFrame, axis: str) -> DataFrame:
    """The map that mirrors an axis at the image's centre of mass: one row of matrix entries a, b, cx, c, d, cy."""
    m = df.agg((F.sum(F.col(axis) * F.col("v")) / F.sum("v")).alias("c"))
    flip = [(-1.0 if a == axis else 1.0) for a in ("x", "y")]
    off = [F.when(F.lit(a == axis), 2 * F.col("c")).otherwise(0.0) for a in ("x", "y")]
    return m.select(F.lit(flip[0]).alias("a"), F.lit(0.0).alias("b"), off[0].alias("cx"), F.lit(0.0).alias("c"), F.lit(flip[1]).alias("d"), off[1].alias("cy"))


def integrate(field: DataFrame, seeds: DataFrame, steps: int, step: float = 0.5) -> DataFrame:
    """Seeds (id, px, py) moved along a 2-D vector field by the midpoint rule; outside the grid the field is 0."""
    from gridloom.plans.lineage import checkpointed

    def speed(points: DataFrame) -> DataFrame:
        out = points
        for a in ("x", "y"):
            parts = [F.struct((F.floor("px") + i).cast("bigint").alias("x"), (F.floor("py") + j).cast("bigint").alias("y"), ((F.col("px") - F.floor("px") if i else 1 - F.col("px") + F.floor("px")) * (F.col("py") - F.floor("py") if j else 1 - F.col("py") + F.floor("py"))).alias("w")) for i in (0, 1) for j in (0, 1)]
            rows = points.withColumn("_c", F.explode(F.array(*parts))).select("id", "_c.*").join(field.select("x", "y", f"u{a}"), ["x", "y"])
            out = out.join(rows.groupBy("id").agg(F.sum(F.col("w") * F.col(f"u{a}")).alias(f"s{a}")), "id", "left")
        return out.fillna(0.0, ["sx", "sy"])

    now = seeds.select("id", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))
    for _ in range(steps):
        half = speed(now).select("id", F.col("px").alias("qx"), F.col("py").alias("qy"), (F.col("px") + step / 2 * F.col("sx")).alias("px"), (F.col("py") + step / 2 * F.col("sy")).alias("py"))
        now = checkpointed(speed(half).select("id", (F.col("qx") + step * F.col("sx")).alias("px"), (F.col("qy") + step * F.col("sy")).alias("py")))
    return now


def _read_field(field: DataFrame, along: DataFrame, k: float = 1.0) -> DataFrame:
    """(axes, _w<axis>): a field's components read, in one join, where another field takes each cell, times k."""
    axes = axes_of(along)
    got = warp_values(field, along, {a: F.col(a) + F.col(f"u{a}") for a in axes}, [f"u{a}" for a in axes])
    return got.select(*axes, *[(k * F.col(f"u{a}")).alias(f"_w{a}") for a in axes])


def compose_fields(first: DataFrame, then: DataFrame) -> DataFrame:
    """The field of going along ``first`` and from there along ``then``."""
    axes = axes_of(first)
    out = first.join(unbroadcast(_read_field(then, first)), axes)
    return out.select(*axes, *[(F.col(f"u{a}") + F.col(f"_w{a}")).alias(f"u{a}") for a in axes])


def invert_field(field: DataFrame, rounds: int = 10) -> DataFrame:
    """w with w(p) = -u(p + w(p)), by fixed-point rounds."""
    from gridloom.plans.lineage import checkpointed

    axes = axes_of(field)
    now = field.select(*axes, *[(-F.col(f"u{a}")).alias(f"u{a}") for a in axes])
    for _ in range(rounds):
        read = _read_field(field, now, -1.0)
        now = checkpointed(read.select(*axes, *[F.col(f"_w{a}").alias(f"u{a}") for a in axes]))
    return now


def exponential(velocity: DataFrame, squarings: int = 4) -> DataFrame:
    """The displacement after unit time along a stationary velocity field, by scaling and squaring."""
    from gridloom.plans.lineage import checkpointed

    axes = axes_of(velocity)
    now = velocity.select(*axes, *[(F.col(f"u{a}") / 2**squarings).alias(f"u{a}") for a in axes])
    for _ in range(squarings):
        now = checkpointed(compose_fields(now, now))
    return now


def warp_labels(labels: DataFrame, grid: DataFrame, positions: dict[str, Column]) -> DataFrame:
    """The label with the greatest linear weight at each position, the least of equals; 0 outside."""
    axes = axes_of(grid)
    base = dealt(grid.select(*axes, *[positions[a].alias(f"_p{a}") for a in axes]))
    parts = []
    for k in range(2 ** len(axes)):
        weight, index = F.lit(1.0), []
        for i, a in enumerate(axes):
            up = k >> i & 1
            f = F.col(f"_p{a}") - F.floor(f"_p{a}")
            weight = weight * (f if up else 1 - f)
            index.append((F.floor(f"_p{a}") + up).cast("bigint").alias(f"_{a}"))
        parts.append(F.struct(weight.alias("w"), *index))
    rows = base.withColumn("_c", F.explode(F.array(*parts))).select(*axes, "_c.*").filter("w > 0")
    got = rows.join(labels.select(*[F.col(a).alias(f"_{a}") for a in axes], "label"), [f"_{a}" for a in axes]).groupBy(*axes, "label").agg(F.sum("w").alias("w"))
    best = got.groupBy(*axes).agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("b")).select(*axes, (-F.col("b.l")).alias("label"))
    return grid.select(*axes).join(best, axes, "left").select(*axes, F.coalesce("label", F.lit(0)).cast("bigint").alias("label"))


#: Windows of a sinc kernel of radius r, as functions of distance.
WINDOWS = {
    "cosine": lambda d, r: F.cos(d * np.pi / 2 / r),
    "hamming": lambda d, r: 0.54 + 0.46 * F.cos(d * np.pi / r),
    "welch": lambda d, r: 1 - d * d / r**2,
    "blackman": lambda d, r: 0.42 + 0.5 * F.cos(d * np.pi / r) + 0.08 * F.cos(2 * d * np.pi / r),
    "lanczos": lambda d, r: F.when(d == 0, 1.0).otherwise(F.sin(d * np.pi / r) / (d * np.pi / r)),
    "gaussian": None,
}


def resample_sinc(image: DataFrame, shift: dict[str, float], kind: str = "lanczos", radius: int = 3, sigma: float = 0.7) -> DataFrame:
    """The image read at cells plus a constant shift by a windowed sinc or a gaussian kernel, axis by axis; weights outside are left out and the rest rescaled."""
    from gridloom.grid import scattered

    axes = axes_of(image)
    out = image.select(*axes, F.col("v").cast("double").alias("v"))
    for a in axes:
        s = shift.get(a, 0.0)
        if s == 0:
            continue
        offsets = [tuple(d if b == a else 0 for b in axes) for d in range(-radius - 1, radius + 2)]
        d = F.col("_d") - F.lit(float(s))
        rows = scattered(out.withColumnRenamed("v", "_v"), offsets, axes, {"_d": [float(k) for k in range(-radius - 1, radius + 2)]})
        inside = F.abs(d) < radius
        if kind == "gaussian":
            weight = F.exp(-(d**2) / (2 * sigma**2))
        else:
            weight = WINDOWS[kind](d, radius) * F.when(d == 0, 1.0).otherwise(F.sin(d * np.pi) / (d * np.pi))
        rows = rows.withColumn("_k", F.when(inside, weight).otherwise(0.0))
        out = rows.groupBy(*axes).agg((F.sum(F.col("_v") * F.col("_k")) / F.sum("_k")).alias("v"), F.max("_self").alias("_in")).filter("_in").drop("_in")
    return out


def closest_points(points: DataFrame, targets: DataFrame, reach: float, p: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """Each point (id) with its nearest target (to) within reach: buckets of that size and their neighbours are joined, never all pairs."""
    n = len(p)
    cell = lambda c: F.floor(F.col(c) / reach).cast("bigint")
    offsets = [()]
    for _ in range(n):
        offsets = [(*o, d) for o in offsets for d in (-1, 0, 1)]
    near = F.explode(F.array(*[F.struct(*[(cell(c) + d).alias(f"_{i}") for i, (c, d) in enumerate(zip(p, o, strict=True))]) for o in offsets]))
    left = points.select("id", *p).withColumn("_c", near).select("id", *p, "_c.*")
    right = targets.select(F.col("id").alias("to"), *[F.col(c).alias(f"q{i}") for i, c in enumerate(p)], *[cell(c).alias(f"_{i}") for i, c in enumerate(p)])
    d2 = sum(((F.col(c) - F.col(f"q{i}")) ** 2 for i, c in enumerate(p)), F.lit(0.0))
    got = left.join(right, [f"_{i}" for i in range(n)]).withColumn("d", F.sqrt(d2)).filter(F.col("d") <= reach)
    return got.groupBy("id").agg(F.min(F.struct("d", "to", *[f"q{i}" for i in range(n)])).alias("b")).select("id", "b.*")


def register_points(points: DataFrame, targets: DataFrame, reach: float, rounds: int = 5, kind: str = "rigid") -> Matrix:
    """Iterated closest points: each round one bucket join and one sum of moments."""
    m: Matrix = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    for _ in range(rounds):
        moved = apply_to_points(points.select("id", "px", "py"), m, ["px", "py"])
        pairs = closest_points(moved, targets, reach).join(points.select("id", "px", "py"), "id")
        m = fit(pairs, ["px", "py"], ["q0", "q1"], kind)
    return m
