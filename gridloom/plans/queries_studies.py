"""Queries of the composed studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.grid import unbroadcast
from gridloom.plans import pipelines
from gridloom.plans.queries_fields import _biased, _shape
from gridloom.plans.queries_models import FIELD, field
from gridloom.plans.registry import Registry
from gridloom.sources import fixtures as fx

REGISTRY = Registry(digits=6)
add = REGISTRY.add
P = fx.PART_SQL


@add("deformation_magnitude", "x y", "v", f"{FIELD} :: SELECT x, y, sqrt(ux * ux + uy * uy) AS v FROM f")
def _(spark, sf):
    return pipelines.deformation_magnitude(field(spark, sf).select("x", "y", "ux", "uy"))


_ML = f"{FIELD}, m AS (SELECT x, y, sqrt(ux * ux + uy * uy) AS v FROM f), n AS (SELECT x, y, v, lag(v) OVER wx AS l, lead(v) OVER wx AS r, lag(v) OVER wy AS u, lead(v) OVER wy AS d FROM m WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y))"


@add("deformation_laplacian", "x y", "v", f"{_ML} :: SELECT x, y, coalesce(l, v) + coalesce(r, v) + coalesce(u, v) + coalesce(d, v) - 4 * v AS v FROM n")
def _(spark, sf):
    return pipelines.deformation_magnitude(field(spark, sf).select("x", "y", "ux", "uy"), "laplacian")


@add("slice_by_slice", "x y", "v", f"{fx.EMBED_SQL}, m AS (SELECT x, y, avg(v) AS v FROM eset GROUP BY x, y), s AS (SELECT y, min(v) AS lo, max(v) AS hi FROM m GROUP BY y) :: SELECT x, y, (v - lo) / (hi - lo) AS v FROM m JOIN s USING (y)")
def _(spark, sf):
    from gridloom.operators import pixel

    mean = fx.embed_set(spark, sf).groupBy("x", "y").agg(F.avg("v").alias("v"))
    return pipelines.slice_by_slice(mean, "y", lambda s: pixel.rescale(s, 0.0, 1.0).select("x", F.col("out").alias("v")))


@add("study_perfusion", "x", "cbf", f"{fx.EVENT_SQL}, live AS (SELECT x FROM ser GROUP BY x HAVING stddev_pop(v) > 0), d AS (SELECT a.x, a.t, p.v - a.v AS d FROM ser a JOIN live USING (x) JOIN ser p ON p.x = a.x AND p.t = a.t - 1 WHERE a.t % 2 = 1) :: SELECT x, avg(d * 0.9 / (4 * 0.85 * 0.001 * 1300 * (exp(-2800 / 1650.0) - exp(-700 / 1300.0)))) AS cbf FROM d GROUP BY x")
def _(spark, sf):
    return pipelines.perfusion(fx.event_series(spark, sf), 0.001)


@add("study_statistics", "", "mean median sd", "SELECT avg(o_totalprice) AS mean, median(o_totalprice) AS median, stddev_samp(o_totalprice) AS sd FROM orders", 4)
def _(spark, sf):
    return pipelines.statistics(fx.table(spark, sf, "orders"), "o_totalprice")


@add("template_of_copies", "", "far", "SELECT 0.0 AS far", 3)
def _(spark, sf):
    one = _shape(spark, sf, 0.0)
    got = pipelines.template([one, one], 1, "translation").withColumnRenamed("v", "w")
    return one.join(unbroadcast(got), ["x", "y"]).agg(F.max(F.abs(F.col("v") - F.col("w"))).alias("far"))


@add("label_fusion_of_a_copy", "x y label", "", f"{P} :: SELECT x, y, CAST(exp(-pow(x - 22, 2) / 60.0 - pow(y - 1.5, 2) / 30.0) > 0.5 AS BIGINT) AS label FROM img")
def _(spark, sf):
    one = _shape(spark, sf, 0.0)
    labels = one.select("x", "y", (F.col("v") > 0.5).cast("bigint").alias("label"))
    return pipelines.joint_label_fusion(one, [(one, labels), (one, labels)], "translation", vote=True)


@add("extraction_of_a_copy", "x y", "v", f"{P} :: SELECT x, y, CAST(x BETWEEN 10 AND 30 AS DOUBLE) AS v FROM img", 6)
def _(spark, sf):
    one = _shape(spark, sf, 0.0)
    mask = one.select("x", "y", F.col("x").between(10, 30).cast("double").alias("v"))
    return pipelines.brain_extraction(one, one, mask, {"x": 50, "y": one.agg(F.max("y")).first()[0] + 1}, "translation")


@add("segmentation_with_correction", "found", "", "SELECT TRUE AS found")
def _(spark, sf):
    """Two planted levels under a planted bias are told apart in nearly all cells."""
    a = _biased(spark, sf)
    labels, _ = pipelines.segment_corrected(a.select("x", "y", "v"), 2, 2)
    true = a.select("x", "y", F.when(F.col("true") == 100, 1).otherwise(2).alias("t"))
    return labels.join(true, ["x", "y"]).agg((F.avg((F.col("label") == F.col("t")).cast("double")) > 0.98).alias("found"))


@add("priors_of_a_cohort", "n", "low", f"{fx.EMBED_SQL} :: SELECT count(*) AS n, 1.0 AS low FROM (SELECT DISTINCT x, y FROM eset)")
def _(spark, sf):
    e = fx.embed_set(spark, sf).groupBy(F.col("grp").alias("image"), "x", "y").agg(F.avg("v").alias("v"))
    p = pipelines.cook_priors(e.withColumn("label", F.when(F.col("v") > 0, 2).otherwise(1).cast("bigint")))
    total = p.groupBy("x", "y").agg(F.sum("p").alias("s"))
    return total.agg(F.count(F.lit(1)).alias("n"), F.min(F.round("s", 9)).alias("low"))


@add("symmetric_image_asymmetry", "", "far", "SELECT 0.0 AS far", 3)
def _(spark, sf):
    image = fx.part_image(spark, sf).select("x", "y", F.exp(-((F.col("x") - 24.5) ** 2) / 60).alias("v"))
    return pipelines.asymmetry(image, "x", "translation").agg(F.max(F.abs("v")).alias("far"))


@add("halfway_image", "between", "", "SELECT TRUE AS between")
def _(spark, sf):
    """The image halfway has its centre between the two images' centres."""
    a, b = _shape(spark, sf, 0.0), _shape(spark, sf, 2.0)
    centre = lambda df: df.agg(F.sum(F.col("x") * F.col("v")) / F.sum("v")).first()[0]
    at = centre(pipelines.geodesic(a, b, 0.5, 1))
    return spark.createDataFrame([(bool(centre(a) < at < centre(b)),)], "between boolean")


@add("smoothing_found", "", "sigma", "SELECT 2.0 AS sigma")
def _(spark, sf):
    from gridloom.operators import neighborhood

    a = fx.part_image(spark, sf).select("x", "y", F.col("w").alias("v"))
    return spark.createDataFrame([(pipelines.best_smoothing(a, neighborhood.gaussian(a, 2.0), (1.0, 2.0, 3.0)),)], "sigma double")
