"""Shortest paths over cells, tile by tile: arrival times of fronts and labels that travel with them.

A tile is solved to its fixpoint in one Arrow batch by a priority queue; between rounds only cells on
tile borders send their time on. So rounds grow with the number of tiles that a path crosses, not with
its cells, only tiles that a border improves are solved again, and a tile bounds a task.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import axes_of, faces, scattered
from gridloom.plans.lineage import checkpointed

#: Cells along a tile's side, by the number of axes.
TILE = {1: 4096, 2: 64, 3: 16, 4: 8}
#: Tiles along an axis beyond which they get longer, and the cells up to which a tile may grow so.
TILES, TILE_CELLS = 16, 250_000
NEW = 1e-12


def sides(cells: DataFrame, axes: list[str]) -> list[int]:
    """Cells along each side of a tile: TILE, or more on an axis so long that a front would cross many tiles, one a round."""
    row = cells.agg(*[(F.max(a) - F.min(a) + 1).alias(a) for a in axes]).first()
    extent, base = [int(n or 1) for n in row], TILE[len(axes)]
    out = [base] * len(axes)
    for i in sorted(range(len(axes)), key=lambda i: -extent[i]):
        rest = math.prod(min(n, s) for j, (n, s) in enumerate(zip(extent, out, strict=True)) if j != i)
        out[i] = max(base, min(-(-extent[i] // TILES), TILE_CELLS // rest))
    return out


def _local(axes: list[str], stop: float):
    """Solves one tile: rows (axes, s, time, tag, ...) with some times known."""

    def run(table: pa.Table) -> pa.Table:
        at = {p: i for i, p in enumerate(zip(*(table.column(a).to_pylist() for a in axes), strict=True))}
        where = list(at)
        slow = table.column("s").to_pylist()
        time = [np.inf if t is None else t for t in table.column("time").to_pylist()]
        tag = table.column("tag").to_pylist()
        heap = [(t, tag[i], i) for i, t in enumerate(time) if t < np.inf]
        heapq.heapify(heap)
        steps = [(k, d) for k in range(len(axes)) for d in (-1, 1)]
        while heap:
            t, g, i = heapq.heappop(heap)
            if (t, g) != (time[i], tag[i]):
                continue
            p = where[i]
            for k, d in steps:
                j = at.get((*p[:k], p[k] + d, *p[k + 1 :]))
                if j is None:
                    continue
                new = t + (slow[i] + slow[j]) / 2
                if new <= stop and (new < time[j] - NEW or abs(new - time[j]) <= NEW and g < tag[j]):
                    time[j], tag[j] = new, g
                    heapq.heappush(heap, (new, g, j))
        out = table.set_column(table.schema.get_field_index("time"), "time", pa.array([None if t == np.inf else t for t in time], pa.float64()))
        return out.set_column(out.schema.get_field_index("tag"), "tag", pa.array(tag, pa.int64()))

    return run


def _best(time: Column, tag: Column) -> Column:
    return F.min(F.struct(time.alias("time"), tag.alias("tag")))


def travel(cells: DataFrame, seeds: DataFrame, stop: float = float("inf"), tile: int | None = None) -> DataFrame:
    """(axes, time, tag) of the cells that the seeds reach by face steps of cost (s + s') / 2; of equal times the least tag.

    cells: axes and s > 0; seeds: axes, time and tag (a number). Cells beyond ``stop`` are not reached.
    """
    axes = axes_of(cells)
    side = dict(zip(axes, [tile] * len(axes) if tile else sides(cells, axes), strict=True))
    tiles = [f"_t{a}" for a in axes]
    first = seeds.groupBy(*axes).agg(_best(F.col("time").cast("double"), F.col("tag").cast("bigint")).alias("b")).select(*axes, "b.time", "b.tag")
    state = cells.select(*axes, F.col("s").cast("double").alias("s")).join(first, axes, "left")
    state = checkpointed(state.withColumns({t: F.floor(F.col(a) / side[a]).cast("bigint") for a, t in zip(axes, tiles, strict=True)}))
    active = state.filter("time IS NOT NULL").select(*tiles).distinct()
    edge = F.lit(False)
    for a in axes:
        edge = edge | F.pmod(F.col(a), F.lit(side[a])).isin(0, side[a] - 1)
    while True:
        solved = state.join(active, tiles, "left_semi").groupBy(*tiles).applyInArrow(_local(axes, stop), state.schema)
        state = checkpointed(state.join(active, tiles, "left_anti").unionByName(solved))
        sent = scattered(state.filter(edge & F.col("time").isNotNull()).select(*axes, F.col("s").alias("_s"), F.col("time").alias("_t"), F.col("tag").alias("_g"), *[F.col(t).alias(f"_{t}") for t in tiles]), faces(axes), axes)
        across = F.lit(False)
        for t in tiles:
            across = across | (F.col(f"_{t}") != F.col(t))
        got = sent.join(state, axes).filter(across).groupBy(*axes, "s", "time", "tag", *tiles).agg(_best(F.col("_t") + (F.col("_s") + F.col("s")) / 2, F.col("_g")).alias("n"))
        sooner = F.col("time").isNull() | (F.col("n.time") < F.col("time") - NEW) | ((F.abs(F.col("n.time") - F.col("time")) <= NEW) & (F.col("n.tag") < F.col("tag")))
        better = checkpointed(got.filter(sooner & (F.col("n.time") <= stop)).select(*axes, "s", F.col("n.time").alias("time"), F.col("n.tag").alias("tag"), *tiles))
        if better.isEmpty():
            return state.filter("time IS NOT NULL").select(*axes, "time", "tag")
        state = state.join(better.select(*axes), axes, "left_anti").unionByName(better.select(state.columns))
        active = better.select(*tiles).distinct()
