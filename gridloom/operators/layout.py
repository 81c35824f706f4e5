"""Geometry and layout: index arithmetic on the axis columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import AXES, axes_of


def make_image(spark: SparkSession, size: tuple[int, ...], value: float = 0.0) -> DataFrame:
    """A constant image; one distributed range, split into axes."""
    n = 1
    for s in size:
        n *= s
    out, i = spark.range(n), F.col("id")
    columns = []
    for a, s in zip(AXES, size, strict=False):
        columns.append((i % s).alias(a))
        i = F.floor(i / s)
    return out.select(*columns, F.lit(float(value)).alias("v"))


def extract_region(df: DataFrame, lo: dict[str, int], hi: dict[str, int]) -> DataFrame:
    for a in lo:
        df = df.filter(F.col(a).between(lo[a], hi[a]))
    return df


def extract_slice(df: DataFrame, axis: str, k: int) -> DataFrame:
    return df.filter(F.col(axis) == k).drop(axis)


def pad(df: DataFrame, size: dict[str, int], width: int, value: float = 0.0) -> DataFrame:
    """Widened by ``width`` cells on each side, filled with value; a negative width crops. Indices start at 0 again."""
    axes = axes_of(df)
    moved = df.select(*[(F.col(a) + width).alias(a) for a in axes], "v")
    for a in axes:
        moved = moved.filter((F.col(a) >= 0) & (F.col(a) < size[a] + 2 * width))
    if width <= 0:
        return moved
    grid = make_image(df.sparkSession, tuple(size[a] + 2 * width for a in axes), value).withColumnRenamed("v", "_f")
    return grid.join(moved, axes, "left").select(*axes, F.coalesce("v", "_f").alias("v"))


def permute_flip(df: DataFrame, order: list[str], flips: dict[str, int]) -> DataFrame:
    """order: the source axis of each new axis; flips: new axis to its size, for those to reverse."""
    axes = axes_of(df)
    rest = [c for c in df.columns if c not in axes]
    out = df.select(*[F.col(src).alias(a) for a, src in zip(axes, order, strict=True)], *rest)
    for a, n in flips.items():
        out = out.withColumn(a, n - 1 - F.col(a))
    return out


def paste(base: DataFrame, top: DataFrame, offset: dict[str, int], background: float = 0.0) -> DataFrame:
    """Cells of ``top`` that aren't background, moved by offset, over those of ``base``; only where base has cells."""
    axes = axes_of(base)
    moved = top.filter(F.col("v") != background).select(*[(F.col(a) + offset.get(a, 0)).alias(a) for a in axes], F.col("v").alias("_t"))
    return base.join(moved, axes, "left").select(*axes, F.coalesce("_t", "v").alias("v"))


def translate(df: DataFrame, shift: dict[str, int]) -> DataFrame:
    """Moved by whole cells; cells that nothing reaches are 0, cells that leave the image go."""
    axes = axes_of(df)
    moved = df.select(*[(F.col(a) + shift.get(a, 0)).alias(a) for a in axes], F.col("v").alias("_m"))
    return df.select(*axes).join(moved, axes, "left").select(*axes, F.coalesce("_m", F.lit(0.0)).alias("v"))


def cyclic_shift(df: DataFrame, axis: str, n: int, size: int) -> DataFrame:
    return df.withColumn(axis, F.pmod(F.col(axis) + n, F.lit(size)))


def replicate(df: DataFrame, axis: str, n: int) -> DataFrame:
    """Copied n times along a new axis."""
    return df.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))


def stack(images: list[DataFrame], axis: str, lengths: list[int]) -> DataFrame:
    """Images one after the other along an axis, which they may have or lack."""
    out, at = None, 0
    for df, n in zip(images, lengths, strict=True):
        moved = df.withColumn(axis, (F.col(axis) if axis in df.columns else F.lit(0)) + F.lit(at).cast("bigint"))
        out = moved if out is None else out.unionByName(moved)
        at += n
    return out


def tile(df: DataFrame, image: str, columns: int, size: tuple[int, int]) -> DataFrame:
    """Images numbered from 0 laid out in rows of ``columns`` tiles."""
    return df.select((F.col("x") + (F.col(image) % columns) * size[0]).alias("x"), (F.col("y") + F.floor(F.col(image) / columns) * size[1]).cast("bigint").alias("y"), "v")


def mosaic(df: DataFrame, axis: str, columns: int, size: tuple[int, int]) -> DataFrame:
    """The slices of a volume tiled."""
    a, b = [c for c in axes_of(df) if c != axis][:2]
    return tile(df.select(F.col(axis).alias("_i"), F.col(a).alias("x"), F.col(b).alias("y"), "v"), "_i", columns, size)


def center_on(fixed: DataFrame, moving: DataFrame, middle: dict[str, int]) -> DataFrame:
    """``moving`` shifted by whole cells so that its centre of mass lies at ``middle``, on fixed's cells."""
    axes = axes_of(fixed)
    at = moving.agg(*[F.round(F.sum(F.col(a) * F.col("v")) / F.sum("v")).cast("bigint").alias(f"_{a}") for a in axes])
    moved = moving.crossJoin(F.broadcast(at)).select(*[(F.col(a) - F.col(f"_{a}") + middle[a]).alias(a) for a in axes], F.col("v").alias("_m"))
    return fixed.select(*axes).join(moved, axes, "left").select(*axes, F.coalesce("_m", F.lit(0.0)).alias("v"))


def warped_grid(df: DataFrame, step: int) -> DataFrame:
    """1 on grid lines each ``step`` cells, else 0."""
    on = F.lit(False)
    for a in axes_of(df):
        on = on | (F.col(a) % step == 0)
    return df.withColumn("v", on.cast("double"))


def resample(df: DataFrame, size: dict[str, int], new: dict[str, int], linear: bool = True) -> DataFrame:
    """The image on a grid of another size over the same extent, centre to centre of the corner cells; linear or nearest.

    Output cells look up their 2^D corners: one join a corner set, no scan of the image per cell.
    """
    axes = axes_of(df)
    grid = make_image(df.sparkSession, tuple(new[a] for a in axes)).drop("v")
    pos = {a: F.col(a) * (size[a] - 1) / max(1, new[a] - 1) for a in axes}
    if not linear:
        at = grid.withColumns({f"_{a}": F.least(F.floor(pos[a] + 0.5), F.lit(size[a] - 1)).cast("bigint") for a in axes})
        return at.join(df.select(*[F.col(a).alias(f"_{a}") for a in axes], "v"), [f"_{a}" for a in axes]).select(*axes, "v")
    parts = F.array(F.struct(F.lit(1.0).alias("w"), *[F.lit(0).cast("bigint").alias(f"_{a}") for a in axes]))
    for a in axes:
        low = F.floor(pos[a]).cast("bigint")
        f = pos[a] - low
        up = F.least(low + 1, F.lit(size[a] - 1))
        set_ = lambda p, w, k, a=a: F.struct((p["w"] * w).alias("w"), *[(k if b == a else p[f"_{b}"]).alias(f"_{b}") for b in axes])
        parts = F.concat(F.transform(parts, _corner(set_, 1 - f, low)), F.transform(parts, _corner(set_, f, up)))
    corners = grid.withColumn("_c", F.explode(parts)).select(*axes, "_c.*").filter("w > 0")
    got = corners.join(df.select(*[F.col(a).alias(f"_{a}") for a in axes], "v"), [f"_{a}" for a in axes])
    return got.groupBy(*axes).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def _corner(make, weight, index):
    return lambda p: make(p, weight, index)


def tri_planar(df: DataFrame, x: int, y: int, z: int) -> DataFrame:
    """The three middle slices as one table: plane, a, b, v."""
    part = lambda name, axis, k, a, b: df.filter(F.col(axis) == k).select(F.lit(name).alias("plane"), F.col(a).alias("a"), F.col(b).alias("b"), "v")
    return part("x", "x", x, "y", "z").union(part("y", "y", y, "x", "z")).union(part("z", "z", z, "x", "y"))
