"""Operations by their command names: ``run(name, image, *arguments)`` over DataFrames.

An operand is a number or an image; images that a command would read from files are DataFrames here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import stats
from gridloom.grid import Geometry, axes_of
from gridloom.operators import align, bias, imageset, iterative, label, layout, mixture, models, neighborhood, pixel, points, regions, registration, spline, surface, tensor, timeseries, transforms
from gridloom.operators.thickness import propagated_thickness

Image = DataFrame


def _pair(a: Image, b: Image | float) -> tuple[Image, str | float]:
    """Two images joined with the second's value as w, or the first and a number."""
    return (pixel.aligned(a.drop("w"), b), "w") if isinstance(b, DataFrame) else (a, float(b))


def _binary(op: str) -> Callable[..., Image]:
    def run(a: Image, b: Image | float = 1.0) -> Image:
        df, other = _pair(a, b)
        return pixel.binary(df, op, "v", other).select(*axes_of(a), F.col("out").alias("v"))

    return run


def _out(df: Image) -> Image:
    return df.select(*axes_of(df), F.col("out").alias("v"))


def _morph(op: str) -> Callable[..., Image]:
    return lambda a, radius=1, foreground=1.0, shape="ball": neighborhood.binary_morphology(a, op, int(radius), shape, float(foreground))


OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    **{name: _binary(op) for name, op in {"m": "m", "+": "add", "-": "sub", "^": "pow", "exp": "exp", "max": "max", "abs": "abs", "addtozero": "addtozero", "overadd": "overadd", "Decision": "decision"}.items()},
    "/": lambda a, b: _out(pixel.divide_carried(_pair(a, b)[0] if isinstance(b, DataFrame) else a.withColumn("w", F.lit(float(b))))),
    "total": lambda a, b, geometry: pixel.total(_pair(a, b)[0], geometry).select("total", "volume"),
    "mean": lambda a, b, geometry: pixel.total(_pair(a, b)[0], geometry).select("mean"),
    "Neg": lambda a: _out(pixel.negate(a)),
    "Byte": lambda a: _out(pixel.byte(a)),
    "RescaleImage": lambda a, lo, hi: _out(pixel.rescale(a, float(lo), float(hi))),
    "WindowImage": lambda a, lo, hi, out_lo, out_hi: _out(pixel.window(a, *map(float, (lo, hi, out_lo, out_hi)))),
    "SigmoidImage": lambda a, alpha=1.0, beta=0.0: _out(pixel.sigmoid(a, float(alpha), float(beta))),
    "Normalize": lambda a, by_mean=False: _out(pixel.normalize(a, by_mean=bool(by_mean))),
    "ThresholdAtMean": lambda a, percent: _out(pixel.threshold_at_mean(a, float(percent))),
    "ThresholdImage": lambda a, lo, hi, inside=1, outside=0: _out(pixel.threshold(a, float(lo), float(hi), int(inside), int(outside))),
    "FlattenImage": lambda a, percent: _out(pixel.flatten_image(a, float(percent))),
    "Finite": lambda a, value=0.0: _out(pixel.finite(a, float(value))),
    "ReplaceVoxelValue": lambda a, lo, hi, value: _out(pixel.replace_value(a, float(lo), float(hi), float(value))),
    "TruncateImageIntensity": lambda a, lo=0.025, hi=0.975, bins=64: _out(pixel.truncate_intensity(a, float(lo), float(hi), int(bins))),
    "CorruptImage": lambda a, noise=1.0, smooth=0.0, seed=0: neighborhood.gaussian(_out(pixel.add_noise(a, "uniform", seed, sd=float(noise))), float(smooth)) if float(smooth) > 0 else _out(pixel.add_noise(a, "uniform", seed, sd=float(noise))),
    "Where": lambda a, value: pixel.where(a, float(value)),
    "MTR": lambda a, b, mask: _out(pixel.mtr(pixel.aligned(pixel.aligned(a, b, "v", "w"), mask, "v", "mask"), "v", "w", "mask")),
    "CoordinateComponentImages": lambda a, geometry: pixel.coordinate_components(a, geometry),
    "SetOrGetPixel": lambda a, index, value=None: a.filter(" AND ".join(f"{k} = {int(i)}" for k, i in index.items())) if value is None else _out(pixel.set_pixel(a, index, float(value))),
    "G": lambda a, sigma, geometry=None: neighborhood.gaussian(a, float(sigma), geometry),
    "Convolve": lambda a, kernel, normalize=True: neighborhood.convolve(a, kernel, normalize),
    "Grad": lambda a, sigma=1.0, geometry=None: neighborhood.gradient_magnitude(a, float(sigma), geometry),
    "Laplacian": lambda a, sigma=1.0, geometry=None: neighborhood.laplacian(a, float(sigma), geometry),
    "Canny": lambda a, sigma=1.0, low=0.0, high=0.0: models.canny(a, float(sigma), float(low), float(high)),
    "Sharpen": lambda a, geometry=None: neighborhood.sharpen(a, geometry),
    "UnsharpMask": lambda a, amount=0.5, radius=1.0, threshold=0.0: neighborhood.unsharp_mask(a, float(amount), float(radius), float(threshold)),
    "MD": _morph("dilate"),
    "ME": _morph("erode"),
    "MO": _morph("open"),
    "MC": _morph("close"),
    "GD": lambda a, radius=1: neighborhood.gray_dilate(a, int(radius)),
    "GE": lambda a, radius=1: neighborhood.gray_erode(a, int(radius)),
    "GO": lambda a, radius=1: neighborhood.gray_open(a, int(radius)),
    "GC": lambda a, radius=1: neighborhood.gray_close(a, int(radius)),
    "D": lambda a, spacing=None: iterative.distance_map(a, spacing=spacing),
    "MaurerDistance": lambda a, foreground=1.0, spacing=None: iterative.signed_distance(a, float(foreground), spacing=spacing),
    "PeronaMalik": lambda a, rounds, conductance=0.25: iterative.perona_malik(a, int(rounds), float(conductance)),
    "InPaint": lambda a, rounds=1: iterative.inpaint(a, int(rounds)),
    "NeighborhoodStats": lambda a, radius=1: neighborhood.neighborhood_stats(a, int(radius)),
    "HistogramMatch": lambda a, reference, points=64, bins=255: _out(stats.match_histogram(a, reference, int(points), int(bins))),
    "HistogramEqualization": lambda a, bins=255: _out(stats.equalize_histogram(a, int(bins))),
    "PValueImage": lambda a, dof: a.select(*axes_of(a), stats.p_value("v", float(dof)).alias("v")),
    "FillHoles": lambda a, size: iterative.fill_holes(a, size),
    "GetLargestComponent": lambda a, min_size=50: iterative.largest_component(a, min_size=int(min_size)),
    "LabelClustersUniquely": lambda a, min_size=1, full=False: iterative.label_clusters(a.filter("v <> 0"), int(min_size), bool(full)),
    "PropagateLabelsThroughMask": lambda mask, seeds, rounds=None: iterative.propagate_labels(mask.filter("v > 0"), seeds, rounds),
    "FastMarchingSegmentation": lambda speed, seeds, stop=float("inf"), topology=0: regions.fast_marching(speed, seeds, float(stop), topology="strict" if int(topology) else None),
    "FastMarchingExtension": lambda speed, seeds, aux="aux", stop=float("inf"): regions.fast_marching_extension(speed, seeds, aux, float(stop)),
    "LesionFilling": lambda a, mask: regions.lesion_fill(pixel.aligned(a, mask, "v", "mask"), "mask"),
    "BlobDetector": lambda a, n, sigmas=(1.0, 2.0, 4.0): models.blobs(a, tuple(sigmas), int(n)),
    "LabelStats": lambda a, geometry, name="label": label.label_stats(a, geometry, name),
    "ROIStatistics": lambda a, geometry, names=None, name="label": label.roi_statistics(a, geometry, names, name),
    "LabelThickness": lambda a, geometry, name="label": neighborhood.label_thickness(a, geometry, name),
    "LabelSurfaceArea": lambda a, geometry, name="label": neighborhood.surface_area(a, geometry, name),
    "LabelOverlapMeasures": lambda a: label.label_overlap(a),
    "LabelGeometryMeasures": lambda a, geometry, name="label": label.geometry_measures(a, geometry, name),
    "ImageIntensityStatistics": lambda a, name="label": label.intensity_statistics(a, name),
    "EnumerateLabelInterfaces": lambda a, name="label": neighborhood.label_interfaces(a, name),
    "RemoveLabelInterfaces": lambda a, name="label": neighborhood.remove_interfaces(a, name),
    "ExtractContours": lambda a, name="label", full=True: neighborhood.label_contour(a, name, bool(full)),
    "PearsonCorrelation": lambda a, b: label.pearson(pixel.aligned(a, b)),
    "NormalizedCorrelation": lambda a, b: label.similarity(pixel.aligned(a, b)).select("ncc"),
    "Mattes": lambda a, b, bins=32: label.mutual_information(pixel.aligned(a, b), bins=int(bins)),
    "NeighborhoodCorrelation": lambda a, b, radius=5: neighborhood.local_correlation(pixel.aligned(a, b), int(radius)),
    "CorrelationUpdate": lambda a, b, radius=1: neighborhood.correlation_update(pixel.aligned(a, b), int(radius)),
    "MinMaxMean": lambda a, geometry: label.min_max_mean(a, geometry),
    "MajorityVoting": lambda a, fraction=0.0: imageset.majority_vote(a, fraction=float(fraction)),
    "AverageLabels": lambda a: imageset.average_labels(a),
    "MostLikely": lambda a, sigma: imageset.most_likely(a, float(sigma)),
    "PureTissueN4WeightMask": lambda a: imageset.pure_tissue(a),
    "AverageImages": lambda a, normalize=False: imageset.average_images(a, bool(normalize)),
    "StudentsTestOnImages": lambda a, first=0, second=1: imageset.students_t(a, a=first, b=second),
    "Project": lambda a, axis, how="sum": imageset.project(a, axis, how),
    "ConvertImageSetToMatrix": lambda a, mask=None: imageset.set_to_matrix(a, mask),
    "TimeSeriesSubset": lambda a, n, length: timeseries.subset(a, int(n), int(length)),
    "TimeSeriesSimpleSubtraction": lambda a, mean=False: timeseries.simple_subtraction(a, mean=bool(mean)),
    "TimeSeriesInterpolationSubtraction": lambda a: timeseries.interpolation_subtraction(a),
    "TimeSeriesMask": lambda a, mask: timeseries.mask_series(a, mask, m="v" if "v" in mask.columns else "mask"),
    "TimeSeriesDisassemble": lambda a, t: a.filter(F.col("t") == int(t)).drop("t"),
    "TimeSeriesAssemble": lambda *images: layout.stack(list(images), "t", [1] * len(images)),
    "TimeSeriesToMatrix": lambda a: timeseries.to_matrix(a),
    "TimeSeriesRegionCorr": lambda a, min_size=0: timeseries.region_correlation(a, min_size=int(min_size)),
    "ComputeTimeSeriesLeverage": lambda a, k: timeseries.leverage(a, int(k)),
    "SplitAlternatingTimeSeries": lambda a, length, odd=False: timeseries.split_alternating(a, bool(odd), int(length)),
    "AverageOverDimension": lambda a: timeseries.average_over(a),
    "CompCorrAuto": lambda a, components=4: timeseries.comp_cor(a, int(components)),
    "PASL": lambda a, m0: timeseries.pasl(a, float(m0)),
    "pCASL": lambda a, m0: timeseries.pcasl(a, float(m0)),
    "SliceTimingCorrection": lambda a, shift, axis: timeseries.slice_timing(a, float(shift), axis),
    "TensorFA": lambda a: tensor.fa(a),
    "TensorMeanDiffusion": lambda a: a.withColumn("out", tensor.mean_diffusion("t")),
    "TensorAxialDiffusion": lambda a: tensor.axial(a),
    "TensorRadialDiffusion": lambda a: tensor.radial(a),
    "TensorEigenvalue": lambda a, k: tensor.eigenvalue(a, int(k)),
    "TensorColor": lambda a: tensor.color(a),
    "KinematicTensor": lambda a, mode="l": tensor.strain(a, mode),
    "PadImage": lambda a, size, width, value=0.0: layout.pad(a, size, int(width), float(value)),
    "Translate": lambda a, shift: layout.translate(a, shift),
    "ExtractSlice": lambda a, axis, k: layout.extract_slice(a, axis, int(k)),
    "ShiftImageSlicesInTime": lambda a, n, size, axis="t": layout.cyclic_shift(a, axis, int(n), int(size)),
    "ReplicateImage": lambda a, n, axis="t": layout.replicate(a, axis, int(n)),
    "ResampleImage": lambda a, size, new, linear=True: layout.resample(a, size, new, bool(linear)),
    "CreateJacobianDeterminantImage": lambda a, log=False: transforms.jacobian(a, bool(log)),
    "InvId": lambda a, b: transforms.inverse_error(a, b),
    "ReflectionMatrix": lambda a, axis: transforms.reflection(a, axis),
    "DenoiseImage": lambda a, patch=1, search=2: models.denoise(a, int(patch), int(search)),
    "TensorFANumerator": lambda a: tensor.fa(a).withColumn("out", F.col("numerator")),
    "TensorFADenominator": lambda a: tensor.fa(a).withColumn("out", F.col("denominator")),
    "TensorIOTest": lambda a: a,
    "ValidTensor": lambda a: tensor.valid(a),
    "SmoothTensorImage": lambda a, sigma=1.0: tensor.smooth(a, float(sigma)),
    "4DTensorTo3DTensor": lambda a: tensor.from_volumes(a),
    "ComponentTo3DTensor": lambda a: a.withColumn("t", tensor.from_components(*tensor.COMPONENTS)),
    "ExtractComponentFrom3DTensor": lambda a, name: a.withColumn("out", tensor.component("t", name)),
    "FSLTensorToITK": lambda a, det=1.0: tensor.from_volumes(a).withColumn("t", tensor.reflect("t", float(det))),
    "ITKTensorToFSL": lambda a, det=1.0: tensor.to_volumes(a.withColumn("t", tensor.reflect("t", float(det)))),
    "TensorMask": lambda a, mask, isotropic=None: tensor.mask(a.join(mask.select(*axes_of(mask), F.col("v").alias("mask")), axes_of(mask)), "mask", isotropic=isotropic),
    "TensorToVector": lambda a: a.withColumn("out", tensor.principal_direction("t")),
    "TensorToVectorComponent": lambda a, k: a.withColumn("out", tensor.principal_direction("t")[int(k)] if int(k) < 3 else F.col("t")[int(k) - 3]),
    "TensorToLocalSpace": lambda a, direction: tensor.rotate(a, [list(r) for r in zip(*direction, strict=True)]),
    "TensorToPhysicalSpace": lambda a, direction: tensor.rotate(a, direction),
    "FuseNImagesIntoNDVectorField": lambda *parts: transforms.make_field(list(parts)),
    "vmresample": lambda a, shift, columns: transforms.warp_values(a, a, {x: F.col(x) + float(shift.get(x, 0.0)) for x in axes_of(a)}, list(columns)),
    "mresample": lambda a, size, new, linear=True: layout.resample(a, size, new, bool(linear)),
    "nvols": lambda a: timeseries.volumes(a),
    "ThreeTissueConfounds": lambda a, csf=3, wm=1, components=2: timeseries.tissue_confounds(a, csf=int(csf), wm=int(wm), components=int(components)),
    "TimeSeriesRegionSCCA": lambda a, length: timeseries.region_similarity(a, int(length)),
    "MatchBlobs": lambda a, b, features, scale=1.0: points.match_blobs(a, b, list(features), float(scale)),
    "Lipschitz": lambda a: transforms.lipschitz_all(a),
    "STAPLE": lambda a, raters: iterative.staple(a, int(raters))[0],
    "PoissonDiffusion": lambda a, source="s", name="l", rounds=500: iterative.poisson_diffusion(a, source, name, int(rounds)),
    "SmoothImage": lambda a, sigma=1.0, geometry=None: neighborhood.gaussian(a, float(sigma), geometry),
    "SurfaceBasedSmoothing": lambda a, rounds=1: surface.smooth_in_mask(a, "mask", int(rounds)),
    "SurfaceCurvature": lambda a: surface.curvature(a),
    "N4BiasFieldCorrection": lambda a, levels=4, rounds=50: bias.correct(a, int(levels), int(rounds)),
    "N3BiasFieldCorrection": lambda a, spans=4, rounds=50: bias.correct_single(a, int(spans), int(rounds)),
    "SmoothDisplacementField": lambda a, sigma: transforms.smooth_field(a, float(sigma)),
    "SimulateDisplacementField": lambda a, seed=0, kind="bspline": transforms.simulate_field(a, int(seed), kind=kind),
    "CreateDisplacementField": lambda *parts, still=False: transforms.make_field(list(parts), still),
    "FitBSplineToPoints": lambda a, coords, values, spans, levels=1: spline.fit_points(a, list(coords), list(values), tuple(spans), int(levels)),
    "SuperResolution": lambda samples, grid, spans=8, levels=3: spline.super_resolution(samples, grid, int(spans), int(levels)),
    "IntegrateVectorField": lambda a, seeds, steps: transforms.integrate(a, seeds, int(steps)),
    "ComposeMultiTransform": lambda grid, stack: transforms.field_of(grid, list(stack)),
    "CreateJacobianDeterminantImageGeometric": lambda a: transforms.geometric_jacobian(a),
    "WarpTimeSeriesImageMultiTransform": lambda a, grid, m: transforms.warp_series(a, grid, m),
    "WarpTensorImageMultiTransform": lambda a, grid, m: transforms.warp_tensors(a, grid, m),
    "MixtureSegmentation": lambda a, options=None, priors=None: mixture.segment(a, ["v"], options or mixture.Options(), priors)[0],
    "DiceAndMinDistSum": lambda a, b: label.dice_table(pixel.aligned(a, b, "v", "w").select(F.col("v").cast("bigint").alias("la"), F.col("w").cast("bigint").alias("lb"))),
    "CorrelationVoting": lambda target, labelled, radius=5: neighborhood.correlation_voting(target, labelled, int(radius)),
    "TriPlanarView": lambda a, x, y, z: layout.tri_planar(a, int(x), int(y), int(z)),
    "ClusterThresholdVariate": lambda a, mask, min_size: iterative.cluster_threshold(pixel.aligned(a, mask, "v", "mask"), "mask", int(min_size)),
    "RandomlySampleImageSetToCSV": lambda images, n, seed=0: imageset.random_samples(images, int(n), int(seed)),
    "ConvertImageSetToEigenvectors": lambda matrix, k: models.principal_components(matrix, int(k)),
    "Demons": lambda fixed, moving, rounds=3, sigma=1.0: models.register_demons(fixed, moving, int(rounds), float(sigma)),
    "SpatialMutualInformation": lambda a, b, bins=32: label.spatial_mutual_information(pixel.aligned(a, b, "v", "w"), bins=int(bins)),
    "TimeSeriesRegionSCCA": lambda series, share_a=0.5, share_b=0.5, rounds=5: timeseries.region_sparse_cca(series, float(share_a), float(share_b), int(rounds))[0],
    "MotionCorr": lambda series, fixed=None, kind="rigid": align.motion_correction(series, fixed, str(kind)).table(series.sparkSession),
    "SliceRegularizedRegistration": lambda moving, fixed, degree=2: align.slice_regularised(moving, fixed, int(degree)).table(moving.sparkSession, "z"),
    "AI": lambda moving, fixed, kind="rigid", turns=12: align.searched(moving, fixed, str(kind), int(turns)).table(moving.sparkSession, "id"),
    "KellyKapowski": lambda a, prior=10, rounds=45, sigma=1.5: propagated_thickness(a, int(prior), rounds=int(rounds), sigma=float(sigma)),
    "LaplacianThickness": lambda a, inner, outer, between, rounds=30: models.thickness(a, int(inner), int(outer), int(between), int(rounds)),
    **{name: (lambda fixed, moving, name=name, **k: registration.MODELS[name](fixed, moving, **k).forward) for name in registration.MODELS},
}


def run(name: str, image: DataFrame, *arguments, **options) -> DataFrame:
    if name not in OPERATIONS:
        raise ValueError(f"no operation {name!r}; there are {', '.join(sorted(OPERATIONS))}")
    return OPERATIONS[name](image, *arguments, **options)


def bracketed(text: str) -> tuple[str, list[str]]:
    """``Name[a,b,c]`` as its name and arguments; ``AxBxC`` arguments stay as they are."""
    name, _, rest = text.strip().partition("[")
    return name.strip(), [x.strip() for x in rest.rstrip("]").split(",")] if rest else []


def geometry(size: str, spacing: str = "", origin: str = "") -> Geometry:
    """From ``AxBxC`` texts."""
    numbers = lambda t, kind: tuple(kind(x) for x in t.split("x")) if t else ()
    return Geometry(numbers(size, int), numbers(spacing, float), numbers(origin, float))
