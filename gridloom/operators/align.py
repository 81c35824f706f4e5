"""Linear alignment of many volumes at once, by Gauss-Newton steps in two or three dimensions.

Volumes stand in one table with a key (time, slice, candidate, or a single one). Each has a map from its cells to the fixed image's, d (d + 1)
numbers that stay on the driver. A step joins a volume's cells to the fixed image where their map puts them, and one aggregation by key
sums the products of the residual and of the volume's gradient with the motion of each parameter (inverse composition, so
gradients are taken once a level). The solve is of a few numbers a key. Volumes that hardly move any more rest.

The fixed image is held with the 2^d values around each cell in one row, so a cell reads it by one row, not by a row a corner; with ``by_key`` each key
has its own fixed image (slices). A level works on block means of the cells, or on a share of them chosen by a digest.

Edge cases: cells that a map takes out of the fixed image don't count; a key with fewer such cells than parameters, or none, keeps its map; null values
are absent cells; a flat volume keeps its map.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import axes_of, unbroadcast
from gridloom.plans.lineage import checkpointed

KINDS = ("translation", "rigid", "similarity", "affine")
#: A volume rests when its farthest corner moves less than this, in cells.
STILL = 1e-3
#: Steps over which a volume's metric has to fall by SLOPE of itself, or it rests.
WINDOW, SLOPE = 4, 1e-6


@dataclass
class Aligned:
    """maps: key to a d x (d + 1) array from the volume's cells to the fixed image's; metric: key to the mean square at the start and at the end."""

    axes: list[str]
    kind: str
    centre: np.ndarray
    maps: dict = field(default_factory=dict)
    metric: dict = field(default_factory=dict)
    steps: int = 0

    def parameters(self, key) -> list[float]:
        """The shift of the centre, then the rotation (angles about the axes, one in two dimensions), the logarithm of the scale and, for affine, the matrix less the identity."""
        m, d = self.maps[key], len(self.axes)
        a = m[:, :d]
        shift = (a @ self.centre + m[:, d] - self.centre).tolist()
        if self.kind == "translation":
            return shift
        if self.kind == "affine":
            return shift + (a - np.eye(d)).ravel().tolist()
        u, _, w = np.linalg.svd(a)
        r, scale = u @ w, abs(np.linalg.det(a)) ** (1 / d)
        turn = _angles(r)
        return shift + turn + ([math.log(scale)] if self.kind == "similarity" else [])

    def table(self, spark, key: str = "t") -> DataFrame:
        """(key, before, after, p0, p1, ..): the metrics and the parameters, a row a volume."""
        rows = [(k, *self.metric[k], *map(float, self.parameters(k))) for k in sorted(self.maps)]
        n = len(rows[0]) - 3 if rows else 0
        return spark.createDataFrame(rows, f"{key} bigint, before double, after double" + "".join(f", p{i} double" for i in range(n)))


def _angles(r: np.ndarray) -> list[float]:
    """Rotation vector of a rotation, one angle in two dimensions."""
    if len(r) == 2:
        return [math.atan2(r[1, 0], r[0, 0])]
    angle = math.acos(min(1.0, max(-1.0, (np.trace(r) - 1) / 2)))
    axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    size = np.linalg.norm(axis)
    return (axis * (angle / size)).tolist() if size > 1e-12 else [0.0, 0.0, 0.0]


def rotation(turn: list[float]) -> np.ndarray:
    """The rotation of an angle, or of a rotation vector."""
    if len(turn) == 1:
        c, s = math.cos(turn[0]), math.sin(turn[0])
        return np.array([[c, -s], [s, c]])
    x, y, z = turn
    k, angle = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]]), math.sqrt(x * x + y * y + z * z)
    if angle < 1e-12:
        return np.eye(3) + k
    return np.eye(3) + math.sin(angle) / angle * k + (1 - math.cos(angle)) / (angle * angle) * (k @ k)


def _turns(d: int) -> list[tuple[int, int]]:
    """The planes of rotation, in the order of the angles: from the first axis to the second."""
    return [(0, 1)] if d == 2 else [(1, 2), (2, 0), (0, 1)]


def _motions(kind: str, grad: list[Column], y: list[Column]) -> list[Column]:
    """The volume's gradient along the motion of each parameter, y being the place about the centre over the radius."""
    out, d = list(grad), len(grad)
    if kind in ("rigid", "similarity"):
        out += [grad[j] * y[i] - grad[i] * y[j] for i, j in _turns(d)]
    if kind == "similarity":
        out.append(sum((g * p for g, p in zip(grad, y, strict=True)), F.lit(0.0)))
    if kind == "affine":
        out += [grad[i] * y[j] for i in range(d) for j in range(d)]
    return out


def _small(kind: str, p: np.ndarray, d: int, centre: np.ndarray, radius: float) -> np.ndarray:
    """The (d + 1) x (d + 1) map of a step's parameters."""
    a = np.eye(d)
    if kind in ("rigid", "similarity"):
        n = len(_turns(d))
        a = rotation((p[d : d + n] / radius).tolist())
        if kind == "similarity":
            a = math.exp(p[d + n] / radius) * a
    elif kind == "affine":
        a = a + p[d:].reshape(d, d) / radius
    out = np.eye(d + 1)
    out[:d, :d], out[:d, d] = a, centre - a @ centre + p[:d]
    return out


def _coarse(df: DataFrame, axes: list[str], by: list[str], factor: int) -> DataFrame:
    df = df.filter("v IS NOT NULL").select(*by, *axes, F.col("v").cast("double").alias("v"))
    if factor == 1:
        return df
    return df.groupBy(*by, *[F.floor(F.col(a) / factor).cast("bigint").alias(a) for a in axes]).agg(F.avg("v").alias("v"))


def _gradients(df: DataFrame, axes: list[str], by: list[str]) -> DataFrame:
    """df with g<axis>: central differences, one-sided at borders, 0 where a cell is alone; all axes in one aggregation."""
    steps = [(i, s) for i in range(len(axes)) for s in (-1, 1)]
    offsets = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("s")), *[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in steps])
    sent = df.withColumn("_o", F.explode(offsets))
    sent = sent.select(*by, *[(F.col(a) + F.when(F.col("_o.i") == i, F.col("_o.s")).otherwise(0)).alias(a) for i, a in enumerate(axes)], "_o.i", "_o.s", "v")
    value = lambda i, s: F.max(F.when((F.col("i") == i) & (F.col("s") == s), F.col("v")))
    got = sent.groupBy(*by, *axes).agg(value(-1, 0).alias("v"), *[value(i, s).alias(f"_{i}{'b' if s > 0 else 'f'}") for i, s in steps]).filter("v IS NOT NULL")
    # the value sent up by one is the one before
    slope = lambda i: (F.coalesce(f"_{i}f", "v") - F.coalesce(f"_{i}b", "v")) / F.greatest(F.when(F.col(f"_{i}f").isNull() | F.col(f"_{i}b").isNull(), 1.0).otherwise(2.0), F.lit(1.0))
    return got.select(*by, *axes, "v", *[slope(i).alias(f"g{a}") for i, a in enumerate(axes)])


def _bundles(df: DataFrame, axes: list[str], by: list[str]) -> DataFrame:
    """(axes, c): the values at a cell and at the next ones on each axis, 2^d in all, null where there is none."""
    d = len(axes)
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(k >> i & 1).alias(f"o{i}") for i in range(d)]) for k in range(1 << d)])
    sent = df.withColumn("_o", F.explode(offsets)).select(*by, *[(F.col(a) - F.col(f"_o.o{i}")).alias(a) for i, a in enumerate(axes)], "_o.k", "v")
    return sent.groupBy(*by, *axes).agg(F.array(*[F.max(F.when(F.col("k") == k, F.col("v"))) for k in range(1 << d)]).alias("c"))


def _read(axes: list[str]) -> Column:
    """The fixed image between cells from a bundle c at the floor of _p<axis>; null where a corner that counts is absent."""
    out = F.lit(0.0)
    for k in range(1 << len(axes)):
        w = F.lit(1.0)
        for i, a in enumerate(axes):
            part = F.col(f"_p{a}") - F.col(a)
            w = w * (part if k >> i & 1 else 1 - part)
        out = out + F.when(w > 0, w * F.col("c")[k]).otherwise(0.0)
    return out


def align(volumes: DataFrame, fixed: DataFrame, kind: str = "rigid", key: str | None = None, levels: tuple[int, ...] = (2, 1), steps: int = 20, share: float = 1.0, photometric: bool = False, by_key: bool = False, start: dict | None = None, shaped: Callable[[dict], dict] | None = None) -> Aligned:
    """The maps of the volumes (key, axes, v) to the fixed image (axes, v; with by_key also the key).

    levels: factors of block means, coarse to fine. share: of the cells of the finest level, by a digest. photometric: a volume may be a gain and an offset
    away, solved for with the map. start: key to a map. shaped: takes the maps of all keys after each step and gives them back (regularised).
    """
    if kind not in KINDS:
        raise ValueError(f"no kind {kind}")
    axes = [a for a in axes_of(fixed) if a != key]
    d, by = len(axes), ["_k"]
    volumes = volumes.select((F.col(key) if key else F.lit(0)).cast("bigint").alias("_k"), *axes, "v")
    fixed = fixed.select(*([F.col(key).cast("bigint").alias("_k")] if by_key else []), *axes, "v")
    fixed_by = by if by_key else []
    box = volumes.agg(*[f(a) for a in axes for f in (F.min, F.max)]).first()
    if box[0] is None:
        return Aligned(axes, kind, np.zeros(d))
    low, high = np.array(box[::2], float), np.array(box[1::2], float)
    out = Aligned(axes, kind, (low + high) / 2)
    keys = [r[0] for r in volumes.select("_k").distinct().collect()]
    whole = {k: np.vstack([np.asarray((start or {}).get(k, np.eye(d, d + 1)), float), np.eye(1, d + 1, d)]) for k in keys}
    for level, factor in enumerate(levels):
        at = lambda m, f=factor: _in_blocks(m, f)
        centre, radius = (out.centre - (factor - 1) / 2) / factor, max(1.0, float((high - low).max()) / 2 / factor)
        corners = np.array([[(low, high)[c >> i & 1][i] for i in range(d)] for c in range(1 << d)])
        cells = _gradients(_coarse(volumes, axes, by, factor), axes, by)
        if share < 1 and factor == 1:
            cells = cells.filter(F.pmod(F.xxhash64(*axes), F.lit(1_000_000)) < share * 1_000_000)
        cells, around = checkpointed(cells), checkpointed(_bundles(_coarse(fixed, axes, fixed_by, factor), axes, fixed_by))
        active, seen = set(keys), {k: [] for k in keys}
        for _ in range(steps):
            sums = _sums(cells, around, axes, kind, {k: at(whole[k]) for k in active}, centre, radius, photometric, by_key)
            out.steps += 1
            moved = {}
            for k in sorted(active):
                n, square, h, b = sums.get(k, (0, 0.0, None, None))
                if n <= (0 if h is None else len(b)):
                    active.discard(k)
                    continue
                seen[k].append(square / n)
                out.metric[k] = (out.metric.get(k, (square / n,))[0], square / n)
                p = np.linalg.lstsq(h + 1e-12 * np.trace(h) * np.eye(len(h)), b, rcond=None)[0]
                p = p[: len(p) - 2] if photometric else p
                new = _of_blocks(at(whole[k]) @ np.linalg.inv(_small(kind, p, d, centre, radius)), factor)
                far = np.abs(corners @ (new - whole[k])[:d, :d].T + (new - whole[k])[:d, d]).max()
                moved[k] = new
                flat = len(seen[k]) > WINDOW and seen[k][-WINDOW - 1] - min(seen[k][-WINDOW:]) <= SLOPE * seen[k][-WINDOW - 1]
                if far < STILL or flat:
                    active.discard(k)
            whole.update(moved)
            if shaped is not None:
                whole = {k: np.vstack([m, np.eye(1, d + 1, d)]) for k, m in shaped({k: m[:d] for k, m in whole.items()}).items()}
                active = set(keys) if moved and len(active) else active
            if not active:
                break
        if level == len(levels) - 1:
            last = _sums(cells, around, axes, kind, {k: at(m) for k, m in whole.items()}, centre, radius, photometric, by_key)
            for k in keys:
                n, square = last.get(k, (0, 0.0))[:2]
                out.metric[k] = (out.metric.get(k, (math.nan,))[0], square / n if n else math.nan)
    out.maps = {k: m[:d] for k, m in whole.items()}
    return out


def _in_blocks(m: np.ndarray, factor: int) -> np.ndarray:
    """A map of cells as one of blocks, whose middles lie (factor - 1) / 2 after their first cells."""
    d, o = len(m) - 1, (factor - 1) / 2
    out = m.copy()
    out[:d, d] = (m[:d, d] + m[:d, :d] @ np.full(d, o) - o) / factor
    return out


def _of_blocks(m: np.ndarray, factor: int) -> np.ndarray:
    d, o = len(m) - 1, (factor - 1) / 2
    out = m.copy()
    out[:d, d] = m[:d, d] * factor - m[:d, :d] @ np.full(d, o) + o
    return out


def _sums(cells: DataFrame, around: DataFrame, axes: list[str], kind: str, maps: dict, centre: np.ndarray, radius: float, photometric: bool, by_key: bool) -> dict:
    """key to (cells, sum of squares, matrix, right side) of a step; one join and one aggregation by key."""
    d = len(axes)
    spark = cells.sparkSession
    table = spark.createDataFrame([(int(k), m[:d].ravel().tolist()) for k, m in maps.items()], "_k bigint, _m array<double>")
    rows = cells.join(table, "_k")
    place = [sum((F.col("_m")[i * (d + 1) + j] * F.col(a) for j, a in enumerate(axes)), F.col("_m")[i * (d + 1) + d]) for i in range(d)]
    y = [((F.col(a) - float(centre[i])) / radius) for i, a in enumerate(axes)]
    motions = _motions(kind, [F.col(f"g{a}") for a in axes], y) + ([F.col("v"), F.lit(1.0)] if photometric else [])
    k = len(motions)
    rows = rows.select("_k", "v", *[p.alias(f"_p{a}") for p, a in zip(place, axes, strict=True)], *[m.alias(f"j{i}") for i, m in enumerate(motions)])
    rows = rows.select("*", *[F.floor(f"_p{a}").cast("bigint").alias(a) for a in axes])
    both = rows.join(unbroadcast(around), [*(["_k"] if by_key else []), *axes]).withColumn("r", _read(axes) - F.col("v")).filter("r IS NOT NULL")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = both.groupBy("_k").agg(F.count("r").alias("n"), F.sum(F.col("r") * F.col("r")).alias("s"), *[F.sum(F.col(f"j{i}") * F.col(f"j{j}")) for i, j in pairs], *[F.sum(F.col(f"j{i}") * F.col("r")) for i in range(k)]).collect()
    out = {}
    for row in got:
        h = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[3 : 3 + len(pairs)], strict=True):
            h[i, j] = h[j, i] = x
        out[row["_k"]] = row["n"], row["s"], h, np.array(row[3 + len(pairs) :], float)
    return out


def motion_correction(series: DataFrame, fixed: DataFrame | None = None, kind: str = "rigid", rounds: int = 2, key: str = "t", **options) -> Aligned:
    """The maps of all volumes of a series to the fixed image; without one, to the mean of the series, taken again from the aligned volumes in each further round."""
    axes = [a for a in axes_of(series) if a != key]
    got, target = None, fixed
    for k in range(1 if fixed is not None else rounds):
        if fixed is None:
            at = series if got is None else resampled(series, got, key)
            target = checkpointed(at.groupBy(*axes).agg(F.avg("v").alias("v")))
        got = align(series, target, kind, key, start=got.maps if got else None, **options)
        del k
    return got


def resampled(volumes: DataFrame, found: Aligned, key: str | None = None) -> DataFrame:
    """(key, axes, v): each volume read at the fixed image's cells, linearly, over the box of the volumes."""
    axes, d = found.axes, len(found.axes)
    spark = volumes.sparkSession
    values = volumes.select((F.col(key) if key else F.lit(0)).cast("bigint").alias("_k"), *axes, F.col("v").cast("double").alias("v"))
    back = spark.createDataFrame([(int(k), np.linalg.inv(np.vstack([m, np.eye(1, d + 1, d)]))[:d].ravel().tolist()) for k, m in found.maps.items()], "_k bigint, _m array<double>")
    rows = values.select("_k", *axes).join(back, "_k")
    place = [sum((F.col("_m")[i * (d + 1) + j] * F.col(a) for j, a in enumerate(axes)), F.col("_m")[i * (d + 1) + d]) for i in range(d)]
    # places within rounding of a cell are that cell
    near = lambda p: F.when(F.abs(p - F.round(p)) < 1e-9, F.round(p)).otherwise(p)
    rows = rows.select("_k", *[F.col(a).alias(f"_{a}") for a in axes], *[near(p).alias(f"_p{a}") for p, a in zip(place, axes, strict=True)])
    rows = rows.select("*", *[F.floor(f"_p{a}").cast("bigint").alias(a) for a in axes])
    out = rows.join(unbroadcast(_bundles(values, axes, ["_k"])), ["_k", *axes]).withColumn("v", _read(axes)).filter("v IS NOT NULL")
    return out.select(*([F.col("_k").alias(key)] if key else []), *[F.col(f"_{a}").alias(a) for a in axes], "v")


def slice_regularised(volume: DataFrame, fixed: DataFrame, degree: int = 2, kind: str = "translation", key: str = "z", **options) -> Aligned:
    """A map of each slice to the fixed image's slice of the same key, whose shifts are polynomials of the key: fitted again after each step.

    kind: translation; slices that see little take the course of the others.
    """
    if kind != "translation":
        raise ValueError("slices are shifted only")

    def fitted(maps: dict) -> dict:
        keys = sorted(maps)
        shifts = np.array([maps[k][:, -1] for k in keys])
        z = np.array(keys, float)
        z = (z - z.mean()) / max(1.0, np.ptp(z) / 2)
        basis = np.vander(z, min(degree, len(keys) - 1) + 1)
        course = basis @ np.linalg.lstsq(basis, shifts, rcond=None)[0]
        return {k: np.hstack([maps[k][:, :-1], c[:, None]]) for k, c in zip(keys, course, strict=True)}

    return align(volume, fixed, kind, key, by_key=True, shaped=fitted, **options)


def searched(moving: DataFrame, fixed: DataFrame, kind: str = "rigid", turns: int = 12, shifts: int = 3, reach: float = 0.25, factor: int = 2, best: int = 3, **options) -> Aligned:
    """The map of a volume found from many starts: turns about the centre (in three dimensions about each axis) times shifts, scored in one plan on block means; the best are refined together, and the best of those stays.

    reach: the farthest shift as a share of the image. The result has the key 0.
    """
    axes = axes_of(fixed)
    d = len(axes)
    box = moving.agg(*[f(a) for a in axes for f in (F.min, F.max)]).first()
    low, high = np.array(box[::2], float), np.array(box[1::2], float)
    centre = (low + high) / 2
    angles = [2 * math.pi * i / turns for i in range(turns)]
    rotations = [rotation([a]) for a in angles] if d == 2 else [rotation([a if i == j else 0.0 for j in range(3)]) for i in range(3) for a in angles[1 if i else 0 :]]
    steps = np.linspace(-reach, reach, shifts) if shifts > 1 else np.zeros(1)
    grids = np.stack(np.meshgrid(*[steps] * d, indexing="ij"), -1).reshape(-1, d) * (high - low)
    starts = {i: np.hstack([r, (centre - r @ centre + s)[:, None]]) for i, (r, s) in enumerate((r, s) for r in rotations for s in grids)}
    spark = moving.sparkSession
    ids = lambda keys: F.explode(F.array(*[F.lit(int(k)) for k in keys])).alias("_c")
    copies = lambda df, keys: df.select(ids(keys), *axes, "v")
    del spark
    # scoring is a step that isn't taken
    small = _coarse(moving, axes, [], factor)
    cells = checkpointed(_gradients(copies(small, starts).withColumnRenamed("_c", "_k"), axes, ["_k"]))
    around = checkpointed(_bundles(_coarse(fixed, axes, [], factor), axes, []))
    blocks = {k: _in_blocks(np.vstack([m, np.eye(1, d + 1, d)]), factor) for k, m in starts.items()}
    sums = _sums(cells, around, axes, "translation", blocks, centre / factor, 1.0, False, False)
    n = small.count()
    # a start that leaves most of the image behind is no candidate
    order = sorted((s[1] / s[0], k) for k, s in sums.items() if s[0] >= n / 3)[:best]
    if not order:
        return align(moving, fixed, kind, **options)
    kept = {k: starts[k] for _, k in order}
    got = align(copies(moving, kept), fixed, kind, "_c", start=kept, **options)
    k = min((m[1] if not math.isnan(m[1]) else math.inf, k) for k, m in got.metric.items())[1]
    return Aligned(got.axes, kind, got.centre, {0: got.maps[k]}, {0: got.metric[k]}, got.steps)
