"""Thickness of a tissue by a flow that carries its inner boundary to its outer one.

The inner tissue is moved through the middle one by a velocity that changes over unit time, in ``steps`` steps. A round integrates the
velocity, compares the moved inner tissue with both tissues together after every step, and adds to that step's velocity a smoothed push
along the moved boundary's normal; rounds end when the tissues agree at the end of the flow. A cell's thickness is the way, within
the tissue, of the point of the inner boundary whose path first reaches it.

A flow goes no further than ``prior`` cells: there a cell's velocity counts no more. So a tile with that much around it holds all that
its cells depend on, and is solved for a round in one Arrow batch; between rounds cells are exchanged, a shuffle a round.

Edge cases: cells that are absent, or null in both tissues, belong to neither; tissue that no boundary reaches within the prior has
thickness 0; an image without middle tissue gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import axes_of
from gridloom.plans.lineage import checkpointed

#: Cells along a tile's side, by the number of axes.
TILE = {1: 4096, 2: 64, 3: 32}


def interpolated(f: np.ndarray, place: list[np.ndarray]) -> np.ndarray:
    """f between cells, linearly; beyond its border its border."""
    at = [np.clip(p, 0, n - 1) for p, n in zip(place, f.shape, strict=True)]
    low = [np.minimum(p.astype(np.int64), max(n - 2, 0)) for p, n in zip(at, f.shape, strict=True)]
    part = [p - q for p, q in zip(at, low, strict=True)]
    out = np.zeros(at[0].shape)
    for corner in range(1 << f.ndim):
        up = [corner >> i & 1 for i in range(f.ndim)]
        weight = np.ones_like(out)
        for i, u in enumerate(up):
            weight = weight * (part[i] if u else 1 - part[i])
        out += weight * f[tuple(np.minimum(q + u, n - 1) for q, u, n in zip(low, up, f.shape, strict=True))]
    return out


def smoothed(f: np.ndarray, sigma: float) -> np.ndarray:
    r = math.ceil(3 * sigma)
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    for axis in range(f.ndim):
        wide = np.pad(f, [(r, r) if i == axis else (0, 0) for i in range(f.ndim)])
        f = sum(k * np.take(wide, range(i, i + f.shape[axis]), axis) for i, k in enumerate(kernel))
    return f


def _slopes(f: np.ndarray) -> list[np.ndarray]:
    return [np.gradient(f, axis=i) if n > 1 else np.zeros_like(f) for i, n in enumerate(f.shape)]


def _length(parts: list[np.ndarray], spacing: list[float]) -> np.ndarray:
    return np.sqrt(sum((h * p) ** 2 for h, p in zip(spacing, parts, strict=True)))


class Flow:
    """The flow over one array of cells: inner and middle tissue and velocities (steps, axes, cells)."""

    def __init__(self, inner: np.ndarray, middle: np.ndarray, velocity: np.ndarray, prior: float, spacing: list[float]):
        self.inner, self.middle, self.v, self.prior, self.spacing = inner, middle, velocity, prior, spacing
        self.both = np.clip(inner + middle, 0, 1)
        self.at = np.meshgrid(*[np.arange(float(n)) for n in inner.shape], indexing="ij")

    def moved(self):
        """After each step: its number, the moved inner tissue, the displacement to its origin, and where the flow still goes on."""
        d, steps = self.inner.ndim, len(self.v)
        back, way = [np.zeros(self.inner.shape) for _ in range(d)], np.zeros(self.inner.shape)
        for k in range(steps):
            free = way < self.prior
            step = [np.clip(self.v[k, i] / steps, -1, 1) * free for i in range(d)]
            place = [x - s for x, s in zip(self.at, step, strict=True)]
            back = [interpolated(b, place) - s for b, s in zip(back, step, strict=True)]
            way = interpolated(way, place) + _length(step, [1.0] * d)
            yield k, interpolated(self.inner, [x + b for x, b in zip(self.at, back, strict=True)]), back, way < self.prior

    def pushed(self, rate: float, sigma: float) -> tuple[np.ndarray, np.ndarray]:
        """The velocities after a round, and what the moved tissue lacks at the end."""
        out, lack = self.v.copy(), None
        for k, inner, _, free in self.moved():
            lack = self.both - inner
            slopes = _slopes(inner)
            size = np.sqrt(sum(s * s for s in slopes))
            push = np.where(size > 1e-3, lack * free / np.maximum(size, 1e-3), 0)
            for i, s in enumerate(slopes):
                out[k, i] += rate * smoothed(-s * push, sigma)
        return out, np.abs(lack)

    def thickness(self) -> np.ndarray:
        d, steps = self.inner.ndim, len(self.v)
        origin, hit = [x.copy() for x in self.at], np.zeros(self.inner.shape, bool)
        for _, inner, back, _ in self.moved():
            new = (inner >= 0.5) & ~hit & (self.middle > 0.5)
            for i in range(d):
                origin[i][new] = (self.at[i] + back[i])[new]
            hit |= new
        place, cells, way = [x.copy() for x in self.at], np.zeros(self.inner.shape), np.zeros(self.inner.shape)
        for k in range(steps):
            step = [np.clip(interpolated(self.v[k, i], place) / steps, -1, 1) * (cells < self.prior) for i in range(d)]
            within = interpolated(self.both, [p + s / 2 for p, s in zip(place, step, strict=True)])
            way += _length(step, self.spacing) * within
            cells += _length(step, [1.0] * d)
            place = [p + s for p, s in zip(place, step, strict=True)]
        return np.where(hit, interpolated(way, origin), 0.0)


def _tile(axes: list[str], steps: int, prior: float, spacing: list[float], solve: Callable[[Flow], tuple[list[np.ndarray], np.ndarray | None]], names: list[str]):
    """Solves a tile: cells (axes, inner, middle, vel, own) to its own ones with further columns; the velocity is replaced where solve gives one."""
    d = len(axes)

    def run(table: pa.Table) -> pa.Table:
        place = [table.column(a).to_numpy() for a in axes]
        low = [p.min() for p in place]
        shape = tuple(int(p.max() - m) + 1 for p, m in zip(place, low, strict=True))
        at = tuple((p - m).astype(np.int64) for p, m in zip(place, low, strict=True))
        inner, middle, velocity = np.zeros(shape), np.zeros(shape), np.zeros((steps, d, *shape))
        inner[at], middle[at] = table.column("inner").to_numpy(), table.column("middle").to_numpy()
        vel = table.column("vel").combine_chunks()
        held = np.flatnonzero(vel.is_valid().to_numpy(zero_copy_only=False))
        if len(held):
            velocity[(slice(None), slice(None), *(a[held] for a in at))] = np.moveaxis(vel.flatten().to_numpy().reshape(-1, steps, d), 0, -1)
        values, new = solve(Flow(inner, middle, velocity, prior, spacing))
        mine = np.flatnonzero(table.column("own").to_numpy())
        own = tuple(a[mine] for a in at)
        out = table.take(pa.array(mine, pa.int64()))
        if new is not None:
            flat = np.ascontiguousarray(np.moveaxis(new[(slice(None), slice(None), *own)], -1, 0)).ravel()
            ends = pa.array(np.arange(len(mine) + 1) * steps * d, pa.int32())
            out = out.set_column(out.schema.get_field_index("vel"), "vel", pa.ListArray.from_arrays(ends, pa.array(flat)))
        for name, value in zip(names, values, strict=True):
            out = out.append_column(name, pa.array(value[own]))
        return out.drop_columns(["own"])

    return run


def propagated_thickness(df: DataFrame, prior: int = 10, steps: int = 20, rounds: int = 60, rate: float = 1.0, sigma: float = 1.5, lack: float = 0.03, spacing: tuple[float, ...] = (), tile: int | None = None, inner: str = "inner", middle: str = "middle") -> DataFrame:
    """(axes, thickness) of the cells that are mostly middle tissue.

    df: axes and the shares of the inner and the middle tissue. ``prior`` bounds the way in cells, ``rate`` and ``sigma`` scale and smooth a round's push;
    rounds end when the moved tissue lacks less than ``lack`` of the middle one on average.
    """
    axes = axes_of(df)
    side, spacing = tile or TILE[len(axes)], list(spacing) or [1.0] * len(axes)
    tiles = [f"_t{a}" for a in axes]
    share = lambda c: F.least(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    kept = [*axes, "inner", "middle", "vel"]
    state = df.select(*[F.col(a).cast("bigint").alias(a) for a in axes], share(inner).alias("inner"), share(middle).alias("middle"), F.lit(None).cast("array<double>").alias("vel"))
    kinds = ", ".join([*(f"{a} bigint" for a in axes), "inner double, middle double, vel array<double>", *(f"{t} bigint" for t in tiles)])

    def at_tiles(rows: DataFrame, reach: int) -> DataFrame:
        """rows at each tile that they lie in or within reach of."""
        out = rows
        for a, t in zip(axes, tiles, strict=True):
            out = out.withColumn(t, F.explode(F.sequence(F.floor((F.col(a) - reach) / side).cast("bigint"), F.floor((F.col(a) + reach) / side).cast("bigint"))))
        own = F.lit(True)
        for a, t in zip(axes, tiles, strict=True):
            own = own & (F.floor(F.col(a) / side) == F.col(t))
        return out.withColumn("own", own)

    def solved(rows: DataFrame, reach: int, solve, names: list[str]) -> DataFrame:
        # tiles without middle tissue within reach have no velocity, and those without cells of their own give no rows
        busy = at_tiles(rows.filter("middle > 0").select(*axes), reach).select(*tiles).distinct()
        owned = rows.select(*[F.floor(F.col(a) / side).cast("bigint").alias(t) for a, t in zip(axes, tiles, strict=True)]).distinct()
        busy = busy.join(owned, tiles, "left_semi")
        work = at_tiles(rows, reach).join(busy, tiles, "left_semi").select(*kept, *tiles, "own")
        schema = kinds + "".join(f", {n} double" for n in names)
        return work.groupBy(*tiles).applyInArrow(_tile(axes, steps, float(prior), spacing, solve, names), schema)

    def a_round(flow: Flow):
        velocity, left = flow.pushed(rate, sigma)
        return [left], velocity

    reach = prior + math.ceil(3 * sigma) + 4
    for _ in range(rounds):
        now = checkpointed(solved(state, reach, a_round, ["left"]))
        left = now.filter("middle > 0").agg(F.avg("left")).first()[0]
        if left is None:
            break
        state = now.select(*kept)  # cells of other tiles never matter again
        if left < lack:
            break
    out = solved(state, 2 * prior + 4, lambda flow: ([flow.thickness()], None), ["thickness"])
    return out.filter("middle > 0.5").select(*axes, "thickness")
