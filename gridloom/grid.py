"""Grids as relations: one row per cell with integer axes and a value, and a small geometry.

An image is a DataFrame with axis columns out of ``x y z t`` and value columns; the background label is
0. A cell that is absent has no row. Geometry is metadata of a few numbers, kept on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add, mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z", "t")


@dataclass(frozen=True)
class Geometry:
    """Size, spacing, origin and row-major direction cosines of a grid."""

    size: tuple[int, ...]
    spacing: tuple[float, ...] = ()
    origin: tuple[float, ...] = ()
    direction: tuple[tuple[float, ...], ...] = field(default=())

    def __post_init__(self) -> None:
        n = len(self.size)
        object.__setattr__(self, "spacing", tuple(self.spacing) or (1.0,) * n)
        object.__setattr__(self, "origin", tuple(self.origin) or (0.0,) * n)
        object.__setattr__(self, "direction", tuple(map(tuple, self.direction)) or tuple(tuple(float(i == j) for j in range(n)) for i in range(n)))

    @property
    def axes(self) -> tuple[str, ...]:
        return AXES[: len(self.size)]

    @property
    def cell_volume(self) -> float:
        return reduce(mul, self.spacing, 1.0)

    def physical(self) -> list[Column]:
        """Physical coordinates of the axis columns: origin + direction . (spacing * index)."""
        return [reduce(add, [F.lit(d * s) * F.col(a) for d, s, a in zip(row, self.spacing, self.axes, strict=True)], F.lit(o)) for row, o in zip(self.direction, self.origin, strict=True)]


def axes_of(df: DataFrame) -> list[str]:
    return [a for a in AXES if a in df.columns]


def scan_order(df: DataFrame) -> list[Column]:
    """x fastest, then y, z, t."""
    return [F.col(a) for a in reversed(axes_of(df))]


def numbered(df: DataFrame, name: str = "i", by: list[str] | None = None) -> DataFrame:
    """Adds the place of each cell in scan order, from 0, without a single-partition window.

    Cells are counted per slice of the slowest axis by a partial aggregation, and places within a
    slice are added to the slices before it; so a slice, not the image, bounds a task.
    """
    axes = axes_of(df)
    slow, by = axes[-1], by or []
    if len(axes) == 1:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*scan_order(df))) - 1)
    counts = df.groupBy(*by, slow).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy(slow)) - F.col("_n")).drop("_n")
    within = Window.partitionBy(*by, slow).orderBy(*scan_order(df))
    return df.withColumn("_k", F.row_number().over(within)).join(before, [*by, slow]).withColumn(name, F.col("_before") + F.col("_k") - 1).drop("_before", "_k")


def box(axes: list[str], radius: int, centre: bool = True) -> list[tuple[int, ...]]:
    """Offsets of a box neighbourhood."""
    out: list[tuple[int, ...]] = [()]
    for _ in axes:
        out = [(*o, d) for o in out for d in range(-radius, radius + 1)]
    return out if centre else [o for o in out if any(o)]


def ball(axes: list[str], radius: int) -> list[tuple[int, ...]]:
    return [o for o in box(axes, radius) if sum(d * d for d in o) <= radius * radius]


def cross(axes: list[str], radius: int) -> list[tuple[int, ...]]:
    return [o for o in box(axes, radius) if sum(d != 0 for d in o) <= 1]


def annulus(axes: list[str], radius: int, thickness: int = 1) -> list[tuple[int, ...]]:
    return [o for o in box(axes, radius) if (radius - thickness) ** 2 < sum(d * d for d in o) <= radius * radius]


def faces(axes: list[str]) -> list[tuple[int, ...]]:
    return [o for o in box(axes, 1) if sum(map(abs, o)) == 1]


def unbroadcast(df: DataFrame) -> DataFrame:
    """A table of cells for a join by axes: it is never broadcast, since cells that are few bytes when compressed are many in the driver."""
    return df.hint("merge")


def dealt(df: DataFrame, axes: list[str] | None = None) -> DataFrame:
    """Cells dealt over a few tasks a core by blocks of 64 cells along each axis, before a step that multiplies them.

    A file of few bytes is one task's input, and the rows made of its cells would all be held by that task; a
    block's cells stay together, so that partial aggregations of neighbours still shrink them.
    """
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *[F.floor(F.col(a) / 64) for a in axes or axes_of(df)])


#: Offsets from which ``scattered`` deals the cells first.
_MANY = 8


def scattered(df: DataFrame, offsets: list[tuple[int, ...]], axes: list[str], extra: dict | None = None) -> DataFrame:
    """Each cell once per offset, moved there: row at p - o stands for the neighbour at offset o of p.

    A neighbourhood sum is then one aggregation by the axes with a partial step, and needs no
    self-join; the rows multiply by the number of offsets before that step, so cells are dealt first where these are many.
    """
    df = dealt(df, axes) if len(offsets) >= _MANY else df
    names = [f"_{a}" for a in axes]
    fields = [F.struct(*[F.lit(int(d)).alias(n) for d, n in zip(o, names, strict=True)], *[F.lit(v[i]).alias(k) for k, v in (extra or {}).items()]) for i, o in enumerate(offsets)]
    out = df.withColumn("_o", F.explode(F.array(*fields)))
    moved = {a: F.col(a) - F.col(f"_o.{n}") for a, n in zip(axes, names, strict=True)}
    return out.withColumns({**{k: F.col(f"_o.{k}") for k in extra or {}}, "_self": reduce(lambda p, q: p & q, [F.col(f"_o.{n}") == 0 for n in names])}).withColumns(moved).drop("_o")
