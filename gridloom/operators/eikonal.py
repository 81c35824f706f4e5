"""Fronts that move with a given speed in every direction: the first-order upwind solution of |grad T| = slowness.

A tile is marched by a priority queue in one Arrow batch, with its surrounding ring of cells from the neighbouring tiles entering the queue
at their times. A cell's time follows from the least time on each axis: the sum of ((T - a) / h)^2 over the axes whose a is below
T is the squared slowness. Beside the time travel a number (extended along the front, weighted as the gradient is) and a tag (that of the
earliest neighbour). Tiles whose ring has changed are marched again; what a cell becomes depends on earlier
cells alone, so the rounds end at what one queue over the whole image gives, also under a constraint of topology.

Under ``strict`` topology a cell is taken only if it is simple, so that the region reached never closes a hole, opens one or joins two parts;
a cell that isn't is left out for good.

Edge cases: cells of no or negative speed, or null, are walls; of several seeds in a cell the earliest counts; equal times go by
place; cells beyond ``stop`` aren't reached; no seeds give no rows.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import axes_of, box
from gridloom.operators.fronts import TILE
from gridloom.plans.lineage import checkpointed

NEW = 1e-12
#: Times closer than this on both sides of an axis are one time: what travels with them is averaged.
SAME = 1e-9


def _updated(near: list[list[tuple[float, float, int]]], slow: float, spacing: list[float]) -> tuple[float, float, int]:
    """(time, value, tag) of a cell from its known neighbours (time, value, tag) on each axis."""
    sides = []
    for h, known in zip(spacing, near, strict=True):
        if known:
            t = min(k[0] for k in known)
            close = [k for k in known if k[0] <= t + SAME]
            sides.append((t, h, sum(k[1] for k in close) / len(close)))
    sides.sort()
    first = min(k[0] for known in near for k in known)
    tag = min(k[2] for known in near for k in known if k[0] <= first + SAME)
    time, used = math.inf, 0
    a = b = 0.0
    c = -slow * slow
    for t, h, _ in sides:
        if t >= time:
            break
        # a T^2 - 2 b T + c = 0
        a, b, c = a + 1 / (h * h), b + t / (h * h), c + t * t / (h * h)
        square = b * b - a * c
        if square < 0:
            break
        time, used = (b + math.sqrt(square)) / a, used + 1
    weights = [(time - t) / (h * h) for t, h, _ in sides[:used]]
    total = sum(weights)
    value = sum(w * s[2] for w, s in zip(weights, sides, strict=False)) / total if total > 0 else sides[0][2]
    return time, value, tag


class Simple:
    """Whether adding a cell changes the topology of a region, by the cell's neighbourhood: the region joins by corners, the rest by faces."""

    def __init__(self, d: int):
        axes = [""] * d
        self.offsets = box(axes, 1, centre=False)
        at = {o: i for i, o in enumerate(self.offsets)}
        self.face = [sum(map(abs, o)) == 1 for o in self.offsets]
        # the rest is followed through cells that share a face or, in three dimensions, an edge with the cell
        self.open = [sum(map(abs, o)) <= 2 for o in self.offsets]
        steps = box(axes, 1, centre=False)
        moved = lambda o, s: tuple(x + y for x, y in zip(o, s, strict=True))
        self.corner_next = [[at[m] for s in steps if (m := moved(o, s)) in at] for o in self.offsets]
        self.face_next = [[at[m] for s in steps if sum(map(abs, s)) == 1 and (m := moved(o, s)) in at] for o in self.offsets]

    def _parts(self, cells: set[int], following: list[list[int]]) -> list[list[int]]:
        left, found = set(cells), []
        while left:
            stack = [left.pop()]
            part = list(stack)
            while stack:
                for j in following[stack.pop()]:
                    if j in left:
                        left.discard(j)
                        stack.append(j)
                        part.append(j)
            found.append(part)
        return found

    def __call__(self, place: tuple[int, ...], region: dict) -> bool:
        inside = {i for i, o in enumerate(self.offsets) if tuple(x + y for x, y in zip(place, o, strict=True)) in region}
        if len(self._parts(inside, self.corner_next)) != 1:
            return False
        outside = {i for i in range(len(self.offsets)) if i not in inside and self.open[i]}
        return sum(any(self.face[i] for i in part) for part in self._parts(outside, self.face_next)) == 1


def _tile(axes: list[str], spacing: list[float], stop: float, strict: bool):
    """Marches one tile: its own cells and, with own false, the known cells around it; gives its own cells with ``moved``."""
    d = len(axes)
    unit = [tuple(int(i == k) for i in range(d)) for k in range(d)]
    simple = Simple(d) if strict else None

    def run(table: pa.Table) -> pa.Table:
        places = list(zip(*(table.column(a).to_pylist() for a in axes), strict=True))
        names = ("own", "s", "seed", "seed_value", "seed_tag", "time", "value", "tag")
        rows = dict(zip(places, zip(*(table.column(c).to_pylist() for c in names), strict=True), strict=True))
        known: dict = {}
        trial: dict = {}
        shut: set = set()
        heap: list = []
        for p, (own, _, seed, value, tag, time, v, g) in rows.items():
            best = (seed, value, tag) if own else (time, v, g)
            if best[0] is not None and best[0] <= stop:
                trial[p] = best
                heapq.heappush(heap, (best[0], p))

        def beside(p: tuple, sign: int, k: int) -> tuple:
            return tuple(x + sign * y for x, y in zip(p, unit[k], strict=True))

        while heap:
            t, p = heapq.heappop(heap)
            if p in known or p in shut or t != trial[p][0]:
                continue
            own, seed = rows[p][0], rows[p][2]
            if own and simple is not None and seed is None and not simple(p, known):
                shut.add(p)
                continue
            known[p] = trial[p]
            for k in range(d):
                for sign in (-1, 1):
                    q = beside(p, sign, k)
                    if q not in rows or q in known or q in shut or not rows[q][0]:
                        continue
                    near = [[known[r] for r in (beside(q, -1, i), beside(q, 1, i)) if r in known] for i in range(d)]
                    new = _updated(near, rows[q][1], spacing)
                    if new[0] <= stop and (q not in trial or new[0] < trial[q][0]):
                        trial[q] = new
                        heapq.heappush(heap, (new[0], q))
                    elif q in trial and new[0] <= trial[q][0] + NEW:
                        trial[q] = (trial[q][0], *new[1:])  # another neighbour of the same time
        mine = [i for i, own in enumerate(table.column("own").to_pylist()) if own]
        out = [known.get(places[i], (None, None, None)) for i in mine]
        old = [rows[places[i]][5:8] for i in mine]

        def differs(a: tuple, b: tuple) -> bool:
            if a[0] is None or b[0] is None:
                return (a[0] is None) != (b[0] is None)
            return abs(a[0] - b[0]) > NEW or abs(a[1] - b[1]) > NEW or a[2] != b[2]

        kept = table.take(pa.array(mine, pa.int64()))
        kinds = {"time": pa.float64(), "value": pa.float64(), "tag": pa.int64()}
        for i, (c, kind) in enumerate(kinds.items()):
            kept = kept.set_column(kept.schema.get_field_index(c), c, pa.array([o[i] for o in out], kind))
        return kept.set_column(kept.schema.get_field_index("moved"), "moved", pa.array([differs(a, b) for a, b in zip(out, old, strict=True)], pa.bool_()))

    return run


def march(cells: DataFrame, seeds: DataFrame, stop: float = float("inf"), spacing: tuple[float, ...] = (), strict: bool = False, tile: int | None = None) -> DataFrame:
    """(axes, time, value, tag) of the cells that the front reaches.

    cells: axes and s, the slowness, above 0. seeds: axes, time, value (a number) and tag (a whole number).
    """
    axes = axes_of(cells)
    side, spacing = tile or TILE[len(axes)], list(spacing) or [1.0] * len(axes)
    tiles = [f"_t{a}" for a in axes]
    least = F.min(F.struct(F.col("time").cast("double").alias("seed"), F.col("value").cast("double").alias("seed_value"), F.col("tag").cast("bigint").alias("seed_tag"))).alias("b")
    first = seeds.groupBy(*axes).agg(least).select(*axes, "b.*")
    state = cells.filter("s > 0").select(*axes, F.col("s").cast("double").alias("s")).join(first, axes, "left")
    state = state.withColumns({t: F.floor(F.col(a) / side).cast("bigint") for a, t in zip(axes, tiles, strict=True)})
    null = lambda kind: F.lit(None).cast(kind)
    state = checkpointed(state.withColumns({"time": null("double"), "value": null("double"), "tag": null("bigint"), "moved": F.lit(False), "own": F.lit(True)}))
    active = state.filter("seed IS NOT NULL").select(*tiles).distinct()

    def sent(rows: DataFrame) -> DataFrame:
        """rows at the tiles that they touch from outside."""
        out = rows
        for a, t in zip(axes, tiles, strict=True):
            at = F.pmod(F.col(a), F.lit(side))
            step = F.filter(F.array(F.lit(0), F.when(at == 0, -1), F.when(at == side - 1, 1)), lambda x: x.isNotNull())
            out = out.withColumn(f"_d{t}", F.explode(step))
        away = F.lit(False)
        for t in tiles:
            away = away | (F.col(f"_d{t}") != 0)
        return out.filter(away).withColumns({t: F.col(t) + F.col(f"_d{t}") for t in tiles}).drop(*[f"_d{t}" for t in tiles])

    while not active.isEmpty():
        ring = sent(state.filter("time IS NOT NULL")).withColumn("own", F.lit(False)).select(state.columns)
        work = state.unionByName(ring).join(active, tiles, "left_semi").select(state.columns)
        solved = work.groupBy(*tiles).applyInArrow(_tile(axes, spacing, stop, strict), state.schema)
        state = checkpointed(state.join(active, tiles, "left_anti").select(state.columns).withColumn("moved", F.lit(False)).unionByName(solved))
        active = sent(state.filter("moved")).select(*tiles).distinct()
    return state.filter("time IS NOT NULL").select(*axes, "time", "value", "tag")
