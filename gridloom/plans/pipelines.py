"""Whole studies composed of the engine's operators: each takes and returns DataFrames of cells."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Geometry, axes_of, unbroadcast
from gridloom.operators import bias, imageset, iterative, label, mixture, models, neighborhood, points, registration, surface, timeseries, transforms
from gridloom.operators.thickness import propagated_thickness
from gridloom.plans.lineage import checkpointed

#: Stages by the name of a preset.
PRESETS = {
    "translation": [("Translation", {})],
    "rigid": [("Translation", {"steps": 4}), ("Rigid", {})],
    "affine": [("Translation", {"steps": 4}), ("Rigid", {}), ("Affine", {})],
    "syn": [("Translation", {"steps": 4}), ("Rigid", {}), ("Affine", {}), ("SyN", {"rounds": 5, "metric": "cc"})],
    "quick": [("Translation", {"steps": 4}), ("SyN", {"rounds": 2})],
    "bspline": [("Translation", {"steps": 4}), ("Rigid", {}), ("BSplineSyN", {"rounds": 5, "metric": "cc"})],
    "intermodality": [("Translation", {"metric": "mi", "steps": 6}), ("Rigid", {"metric": "mi"}), ("SyN", {"rounds": 3, "metric": "cc"})],
}


def _map(f: DataFrame, image: DataFrame) -> DataFrame:
    return transforms.warp_field(image, f)


def _warp_labels(labels: DataFrame, f: DataFrame) -> DataFrame:
    axes = axes_of(f)
    return transforms.warp_labels(labels, f, {a: F.col(a) + F.col(f"u{a}") for a in axes})


def pairwise(fixed: DataFrame, moving: DataFrame, preset: str = "syn", levels: tuple[tuple[int, float], ...] = ((1, 0.0),)) -> tuple[DataFrame, DataFrame]:
    """(field, warped moving image) by a preset's stages."""
    field, _ = registration.register(fixed, moving, PRESETS[preset], levels)
    field = checkpointed(field)
    return field, _map(field, moving)


def over_set(df: DataFrame, run: Callable[[DataFrame], DataFrame], image: str = "image") -> DataFrame:
    """run on each image of a set, whose numbers are a bounded list; the results with the image's number."""
    names = sorted(r[0] for r in df.select(image).distinct().collect())
    parts = [run(df.filter(F.col(image) == k).drop(image)).withColumn(image, F.lit(k).cast(df.schema[image].dataType)) for k in names]
    return reduce(DataFrame.unionByName, parts)


def slice_by_slice(df: DataFrame, axis: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run on each slice across an axis, put together again."""
    return over_set(df, run, axis)


def unbiased_pairwise(a: DataFrame, b: DataFrame, rounds: int = 3) -> DataFrame:
    """The mean of two images where both have moved half the way to each other."""
    one, two = registration.symmetric(a, b, rounds).parts
    x, y = _map(one, a), _map(two, b).withColumnRenamed("v", "w")
    axes = axes_of(a)
    return x.join(unbroadcast(y), axes).select(*axes, ((F.col("v") + F.col("w")) / 2).alias("v"))


def shape_update(template: DataFrame, fields: list[DataFrame], step: float = 0.25) -> DataFrame:
    """The template moved against the mean of the fields that take it into the images, by a share of it."""
    axes = axes_of(template)
    every = reduce(DataFrame.union, [f.select(*axes, *[f"u{a}" for a in axes]) for f in fields])
    mean = every.groupBy(*axes).agg(*[(-step * F.avg(f"u{a}")).alias(f"u{a}") for a in axes])
    return _map(checkpointed(mean), template)


def template(images: list[DataFrame], rounds: int = 2, preset: str = "quick", step: float = 0.25) -> DataFrame:
    """The images' mean shape and value: in each round all are taken to the template so far, averaged, and the mean is moved back by the mean field."""
    axes = axes_of(images[0])
    mean = lambda parts: reduce(DataFrame.union, [p.select(*axes, "v") for p in parts]).groupBy(*axes).agg(F.avg("v").alias("v"))
    now = checkpointed(mean(images))
    for _ in range(rounds):
        pairs = [pairwise(now, m, preset) for m in images]
        now = checkpointed(shape_update(checkpointed(mean([w for _, w in pairs])), [f for f, _ in pairs], step))
    return now


def cook_priors(labels: DataFrame, sigma: float = 1.0, image: str = "image") -> DataFrame:
    """(axes, label, p): the share of a cohort's label images, smoothed and brought to a sum of one."""
    axes = axes_of(labels)
    share = checkpointed(imageset.average_labels(labels, image=image))
    grid = labels.select(*axes).distinct()
    parts = []
    for k in sorted(r[0] for r in share.select("label").distinct().collect()):
        one = grid.join(share.filter(F.col("label") == k).select(*axes, "p"), axes, "left").select(*axes, F.coalesce("p", F.lit(0.0)).alias("v"))
        parts.append(neighborhood.gaussian(one, sigma).select(*axes, F.lit(k).cast("bigint").alias("label"), F.col("v").alias("p")))
    every = checkpointed(reduce(DataFrame.union, parts))
    total = every.groupBy(*axes).agg(F.sum("p").alias("_t"))
    return every.join(total, axes).select(*axes, "label", F.when(F.col("_t") > 0, F.col("p") / F.greatest("_t", F.lit(1.0))).otherwise(0.0).alias("p"))


def segment_corrected(image: DataFrame, classes: int = 3, rounds: int = 2, priors: DataFrame | None = None, mask: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, corrected image): in turn the bias field is taken out and the image segmented; after the first round the field is fitted where the segmentation is sure."""
    axes = axes_of(image)
    now, sure, labels = image, mask, None
    for _ in range(rounds):
        flat = checkpointed(bias.correct(now, levels=2, rounds=4, mask=sure).select(*axes, "v"))
        options = mixture.Options(classes=classes, rounds=4, prior_weight=0.25 if priors is not None else 0.0)
        labels = checkpointed(mixture.segment(flat, ["v"], options, priors)[0])
        now = image.select(*axes, "v").join(labels.select(*axes, (F.col("p") > 0.5).cast("int").alias("_sure")), axes, "left").withColumn("_sure", F.coalesce("_sure", F.lit(0)))
        sure = "_sure"
    return labels, flat


def brain_extraction(image: DataFrame, model: DataFrame, model_mask: DataFrame, size: dict[str, int], preset: str = "quick") -> DataFrame:
    """(axes, v): a 0/1 mask: the template's mask taken to the image, then eroded, its largest part kept, grown again and filled."""
    axes = axes_of(image)
    field, _ = pairwise(image, model, preset)
    mask = _warp_labels(model_mask.select(*axes, F.col("v").cast("bigint").alias("label")), field).select(*axes, F.col("label").cast("double").alias("v"))
    core = checkpointed(neighborhood.binary_morphology(checkpointed(mask), "erode", 1))
    largest = iterative.largest_component(core, 0.5, 1).withColumn("_k", F.lit(1.0))
    whole = image.select(*axes).join(largest, axes, "left").select(*axes, F.coalesce("_k", F.lit(0.0)).alias("v"))
    return iterative.fill_holes(checkpointed(neighborhood.binary_morphology(whole, "dilate", 1)).withColumn("v", F.col("v").cast("double")), size)


def cortical_thickness(image: DataFrame, inner: int = 3, between: int = 2, outer: int = 1, classes: int = 3, rounds: int = 60, laplace: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(thickness, volumes by label): segmentation with bias correction, then the thickness of a class between two others, by a flow (``options`` of ``propagated_thickness``) or of the Laplace form."""
    labels, _ = segment_corrected(image, classes, 1)
    volumes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("cells"))
    if laplace:
        return models.thickness(labels, inner, outer, between, rounds), volumes
    shares = labels.select(*axes_of(image), (F.col("label") == inner).cast("double").alias("inner"), (F.col("label") == between).cast("double").alias("middle"))
    return propagated_thickness(shares, rounds=rounds, **options).withColumnRenamed("thickness", "v"), volumes


def longitudinal_thickness(visits: list[DataFrame], rounds: int = 1, **options) -> list[DataFrame]:
    """The thickness of each visit, taken to the subject's own template first."""
    own = template(visits, rounds)
    return [cortical_thickness(pairwise(own, v, "quick")[1], **options)[0] for v in visits]


def joint_label_fusion(target: DataFrame, atlases: list[tuple[DataFrame, DataFrame]], preset: str = "quick", radius: int = 1, vote: bool = False) -> DataFrame:
    """(axes, label): each atlas (image, labels) is taken to the target and the labels fused by joint weights, or by majority."""
    axes = axes_of(target)
    parts = []
    for k, (image, labels) in enumerate(atlases):
        field, warped = pairwise(target, image, preset)
        moved = _warp_labels(labels, field)
        parts.append(checkpointed(warped.join(unbroadcast(moved), axes).select(F.lit(k).alias("image"), *axes, "v", "label")))
    every = reduce(DataFrame.union, parts)
    return imageset.majority_vote(every).select(*axes, "label") if vote else models.joint_fusion(target, every, radius)


def perfusion(series: DataFrame, m0: float, pseudo_continuous: bool = True, v: str = "v") -> DataFrame:
    """(cells, cbf): control less label volumes to flow; cells whose series is constant are left out."""
    sd = timeseries.temporal_sd(series, v).filter("sd > 0")
    cells = [a for a in axes_of(series) if a != "t"]
    live = series.join(sd.select(*cells), cells, "left_semi")
    return timeseries.pcasl(live, m0, v) if pseudo_continuous else timeseries.pasl(live, m0, v)


def bold_network(series: DataFrame, cut: float, label_: str = "label", components: int = 2, v: str = "v") -> DataFrame:
    """(node, degree, rank) of the network of regions whose noise-corrected signals correlate by more than ``cut``."""
    cells = [a for a in axes_of(series) if a != "t"]
    noise = checkpointed(timeseries.comp_cor(series.drop(label_), components, v=v))
    left = timeseries.residual(series.drop(label_), noise, ["global", *[f"comp{i + 1}" for i in range(components)]], v)
    r = timeseries.region_correlation(left.join(series.select(*cells, label_).distinct(), cells), label_)
    return points.network_measures(r.filter(F.col("r") > cut).select(F.col("a").alias("u"), F.col("b").alias("v")))


def deformation_magnitude(field: DataFrame, kind: str = "euclidean") -> DataFrame:
    """(axes, v): a field's length, or the gradient or Laplacian of it."""
    axes = axes_of(field)
    size = field.select(*axes, F.sqrt(sum((F.col(f"u{a}") ** 2 for a in axes), F.lit(0.0))).alias("v"))
    return {"euclidean": lambda: size, "gradient": lambda: neighborhood.gradient_magnitude(size, None), "laplacian": lambda: neighborhood.laplacian(size, None)}[kind]()


def geodesic(a: DataFrame, b: DataFrame, share: float, rounds: int = 3) -> DataFrame:
    """The image a share of the way from one to another: both moved along one velocity, and mixed."""
    axes = axes_of(a)
    (velocity,) = registration.exponential(a, b, rounds).parts
    part = lambda k: transforms.exponential(velocity.select(*axes, *[(k * F.col(f"u{x}")).alias(f"u{x}") for x in axes]), 3)
    one, two = _map(part(-share), a), _map(part(1 - share), b).withColumnRenamed("v", "w")
    return one.join(two, axes).select(*axes, ((1 - share) * F.col("v") + share * F.col("w")).alias("v"))


def asymmetry(image: DataFrame, axis: str, preset: str = "quick") -> DataFrame:
    """(axes, v): the image less its mirror image across its middle, after the mirror image is taken to it."""
    axes = axes_of(image)
    ends = image.agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
    mirror = image.crossJoin(F.broadcast(ends)).withColumn(axis, F.col("_lo") + F.col("_hi") - F.col(axis)).select(*axes, "v")
    _, warped = pairwise(image, mirror, preset)
    return image.select(*axes, "v").join(unbroadcast(warped.withColumnRenamed("v", "w")), axes).select(*axes, (F.col("v") - F.col("w")).alias("v"))


def landmark_match(fixed: DataFrame, moving: DataFrame, fixed_labels: DataFrame, moving_labels: DataFrame, spans: int = 4) -> DataFrame:
    """The moving image taken to the fixed one by the spline field of their landmarks."""
    from gridloom.operators import spline

    return _map(checkpointed(spline.landmark_field(fixed_labels, moving_labels, fixed, spans)), moving)


def guided(fixed: DataFrame, moving: DataFrame, fixed_labels: DataFrame, moving_labels: DataFrame, weight: float = 0.5, rounds: int = 3) -> DataFrame:
    """A field from the image and its labels together: both are one image of weighted values."""
    axes = axes_of(fixed)
    both = lambda i, k: i.join(k, axes).select(*axes, ((1 - weight) * F.col("v") + weight * F.col("label")).alias("v"))
    return registration.symmetric(checkpointed(both(fixed, fixed_labels)), checkpointed(both(moving, moving_labels)), rounds).forward


def object_skeleton(image: DataFrame, level: float) -> DataFrame:
    """The skeleton of what reaches a level, of its largest part."""
    largest = iterative.largest_component(image, level, 1)
    return surface.skeleton(largest.withColumn("v", F.lit(1)))


def best_smoothing(image: DataFrame, reference: DataFrame, sigmas: tuple[float, ...]) -> float:
    """The sigma whose smoothed image is nearest to a reference, by mean squares."""
    axes = axes_of(image)
    cost = lambda s: neighborhood.gaussian(image, s).join(reference.withColumnRenamed("v", "w"), axes).agg(F.avg((F.col("v") - F.col("w")) ** 2)).first()[0]
    return min(sigmas, key=cost)


def statistics(df: DataFrame, v: str = "v") -> DataFrame:
    """mean, median and sd of a column of numbers."""
    return df.agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"))


def volumes(labels: DataFrame, geometry: Geometry) -> DataFrame:
    return label.geometry_measures(labels, geometry).select("label", "volume")
