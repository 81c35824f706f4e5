"""Operations on connected regions and fronts, and per-volume alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Geometry, axes_of, box, faces, scattered, unbroadcast
from gridloom.operators.eikonal import march
from gridloom.operators.fronts import travel
from gridloom.operators.iterative import component_sizes
from gridloom.operators.label import geometry_measures
from gridloom.plans.lineage import checkpointed


def component_features(df: DataFrame, geometry: Geometry, label: str = "label") -> DataFrame:
    """(axes, label, volume, perimeter_ratio, eccentricity, elongation): features of each face-connected component of one label, on its cells."""
    axes = axes_of(df)
    live = checkpointed(df.filter(F.col(label) != 0).select(*axes, F.col(label).alias("label")))
    # components never join two labels: the label is one more axis far apart
    coded = live.select(F.col(axes[0]), *[F.col(a) for a in axes[1:]], (F.col("label") * 2).alias("t"))
    sized = component_sizes(coded).withColumn("label", (F.col("t") / 2).cast("bigint")).drop("t")
    sized = checkpointed(sized.withColumn("id", F.xxhash64("component")))
    shape = geometry_measures(sized, geometry, "id").select(F.col("label").alias("id"), "volume", "eccentricity", "elongation")
    near = scattered(sized.select(*axes, F.col("id").alias("_i")), faces(axes), axes).groupBy(*axes).agg(F.collect_list("_i").alias("_n"))
    open_ = sized.join(near, axes, "left").select("id", (len(faces(axes)) - F.size(F.filter(F.coalesce("_n", F.array().cast("array<bigint>")), lambda x: x == F.col("id")))).alias("o")).groupBy("id").agg(F.sum("o").alias("perimeter"))
    out = sized.join(shape, "id").join(open_, "id")
    return out.select(*axes, "label", "volume", (F.col("volume") / F.col("perimeter")).alias("perimeter_ratio"), "eccentricity", "elongation")


def fast_marching(speed: DataFrame, seeds: DataFrame, stop: float = float("inf"), v: str = "v", spacing: tuple[float, ...] = (), topology: str | None = None) -> DataFrame:
    """(axes, time): arrival time of a front that moves from the seeds with the speed v, over cells of positive speed.

    With topology "strict" the region reached neither joins parts nor closes or opens holes.
    """
    if topology not in (None, "strict"):
        raise ValueError(f"no topology {topology}")
    axes = axes_of(speed)
    slow = speed.filter(F.col(v) > 0).select(*axes, (1 / F.col(v)).alias("s"))
    start = seeds.select(*axes).distinct().withColumns({"time": F.lit(0.0), "value": F.lit(0.0), "tag": F.lit(0)})
    return march(slow, start, stop, spacing, topology == "strict").select(*axes, "time")


def fast_marching_extension(speed: DataFrame, seeds: DataFrame, aux: str = "aux", stop: float = float("inf"), v: str = "v", spacing: tuple[float, ...] = ()) -> DataFrame:
    """(axes, time, aux): the arrival time, and the seeds' aux extended along the front, constant on its paths."""
    axes = axes_of(speed)
    slow = speed.filter(F.col(v) > 0).select(*axes, (1 / F.col(v)).alias("s"))
    start = seeds.select(*axes, F.lit(0.0).alias("time"), F.col(aux).cast("double").alias("value"), F.lit(0).alias("tag"))
    return march(slow, start, stop, spacing).select(*axes, "time", F.col("value").alias(aux))


def propagate_by_front(speed: DataFrame, seeds: DataFrame, label: str = "label", stop: float = float("inf"), v: str = "v", spacing: tuple[float, ...] = ()) -> DataFrame:
    """(axes, label, time): each cell of positive speed takes the label of the seeds whose front reaches it first, of equal times the least."""
    axes = axes_of(speed)
    slow = speed.filter(F.col(v) > 0).select(*axes, (1 / F.col(v)).alias("s"))
    start = seeds.filter(F.col(label) != 0).select(*axes, F.lit(0.0).alias("time"), F.lit(0.0).alias("value"), F.col(label).cast("bigint").alias("tag"))
    return march(slow, start, stop, spacing).select(*axes, F.col("tag").alias(label), "time")


def city_block_arrival(speed: DataFrame, seeds: DataFrame, stop: float = float("inf"), v: str = "v") -> DataFrame:
    """(axes, time): arrival time along face steps that cost the mean of the two slownesses."""
    axes = axes_of(speed)
    slow = speed.filter(F.col(v) > 0).select(*axes, (1 / F.col(v)).alias("s"))
    return travel(slow, seeds.select(*axes).distinct().withColumns({"time": F.lit(0.0), "tag": F.lit(0)}), stop).select(*axes, "time")


def lesion_fill(df: DataFrame, mask: str, v: str = "v") -> DataFrame:
    """v, with each lesion component's cells replaced by the mean of its ring of neighbours (radius 1, or 2 for components under five cells) that reach the component's mean."""
    axes = axes_of(df)
    sized = component_sizes(df.filter(F.col(mask) != 0)).withColumn("id", F.xxhash64("component"))
    lesion = checkpointed(sized.select(*axes, "id", "size").join(df.select(*axes, F.col(v).cast("double").alias("v")), axes))
    mean = lesion.groupBy("id", "size").agg(F.avg("v").alias("m"))
    offsets = box(axes, 2, centre=False)
    reach = [max(abs(d) for d in o) for o in offsets]
    ring = scattered(lesion.select(*axes, F.col("id").alias("_id"), F.col("size").alias("_size")), offsets, axes, {"_r": reach}).filter(F.col("_r") <= F.when(F.col("_size") < 5, 2).otherwise(1))
    donors = df.filter(F.col(mask) == 0).select(*axes, F.col(v).cast("double").alias("v")).join(ring.select(*axes, F.col("_id").alias("id")).distinct(), axes).join(mean, "id")
    fill = donors.groupBy("id").agg(F.avg(F.when(F.col("v") >= F.col("m"), F.col("v"))).alias("_d"), F.avg("v").alias("_e"))
    new = lesion.select(*axes, "id").join(fill, "id").select(*axes, F.coalesce("_d", "_e").alias("_f"))
    return df.join(new, axes, "left").select(*axes, F.coalesce("_f", F.col(v).cast("double")).alias("v"))


def motion_correct(series: DataFrame, reach: int, v: str = "v") -> DataFrame:
    """(t, one shift s<axis> per axis, metric): each volume's whole-cell shift to the mean image, by mean squares; all volumes and shifts in one aggregation."""
    axes = [a for a in axes_of(series) if a != "t"]
    mean = series.groupBy(*axes).agg(F.avg(v).alias("_m"))
    offsets = box(axes, reach)
    names = {f"s{a}": [o[i] for o in offsets] for i, a in enumerate(axes)}
    moved = scattered(series.select(*axes, "t", F.col(v).alias("_v")), offsets, axes, names)
    cost = mean.join(unbroadcast(moved), axes).groupBy("t", *names).agg(F.avg((F.col("_m") - F.col("_v")) ** 2).alias("metric"))
    best = cost.groupBy("t").agg(F.min(F.struct("metric", *[F.abs(n).alias(f"_{n}") for n in names], *names)).alias("b"))
    return best.select("t", *[F.col(f"b.{n}").alias(n) for n in names], F.col("b.metric").alias("metric"))


def colormap(df: DataFrame, stops: list[tuple[float, int, int, int]], v: str = "v") -> DataFrame:
    """r, g, b of each cell by linear interpolation between colour stops over the image's range."""
    from gridloom.functions.stats import piecewise

    s = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    at = [x for x, *_ in stops]
    return df.crossJoin(F.broadcast(s)).withColumns({c: F.floor(piecewise(share, at, [float(q[i + 1]) for q in stops])).cast("bigint") for i, c in enumerate("rgb")}).drop("_lo", "_hi")


def mesh_points(df: DataFrame, geometry: Geometry, level: float, v: str = "v") -> DataFrame:
    """Physical points where the image crosses a level between two face neighbours along an axis."""
    from pyspark.sql import Window

    axes = axes_of(df)
    parts = None
    for a in axes:
        w = Window.partitionBy(*[b for b in axes if b != a]).orderBy(a)
        near = df.withColumns({"_n": F.lead(v).over(w), "_k": F.lead(a).over(w)}).filter((F.col("_k") == F.col(a) + 1) & ((F.col(v) < level) != (F.col("_n") < level)))
        moved = near.withColumn(a, F.col(a) + (F.lit(level) - F.col(v)) / (F.col("_n") - F.col(v)))
        part = moved.select(F.lit(a).alias("axis"), *[p.alias(f"p{b}") for b, p in zip(geometry.axes, geometry.physical(), strict=True)])
        parts = part if parts is None else parts.union(part)
    return parts
