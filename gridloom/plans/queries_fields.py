"""Queries of tensors, splines, bias fields, registration, mixtures, surfaces and warps of all kinds of images."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import unbroadcast
from gridloom.operators import bias, iterative, mixture, points, registration, sparse, spline, surface, tensor, timeseries, transforms
from gridloom.operators.models import covariance
from gridloom.plans.queries_models import FIELD, T, field, tensors
from gridloom.plans.registry import Registry
from gridloom.sources import files
from gridloom.sources import fixtures as fx

REGISTRY = Registry(digits=6)
add = REGISTRY.add
P = fx.PART_SQL
S = fx.EVENT_SQL


# Tensors I + u u' (see queries_models).
@add("tensor_fa_numerator", "id", "numerator", f"{T} :: SELECT id, s * sqrt(2.0 / 3) AS numerator FROM e", 5)
def _(spark, sf):
    return tensor.fa(tensors(spark, sf))


@add("tensor_fa_denominator", "id", "denominator", f"{T} :: SELECT id, sqrt(2 + (1 + s) * (1 + s)) AS denominator FROM e")
def _(spark, sf):
    return tensor.fa(tensors(spark, sf))


def _shifted(spark, sf):
    """u u' plus the fourth entry times I: eigenvalues d, d and d + s."""
    e = fx.table(spark, sf, "embeddings")
    a, b, c, d = (F.col("embedding")[i].cast("double") for i in range(4))
    return e.select(F.col("vec_id").alias("id"), F.array(d + a * a, a * b, a * c, d + b * b, b * c, d + c * c).alias("t"))


@add("tensor_valid", "id valid", "", "SELECT vec_id AS id, embedding[4] > 1e-9 AS valid FROM embeddings")
def _(spark, sf):
    return tensor.valid(_shifted(spark, sf))


@add("tensor_volumes", "id t", "v", f"{T} :: SELECT id, CAST(k AS BIGINT) AS t, [1 + a * a, a * b, a * c, 1 + b * b, b * c, 1 + c * c][k + 1] AS v FROM e, range(6) r(k)")
def _(spark, sf):
    return tensor.to_volumes(tensors(spark, sf).select("id", "t"))


def _on_grid(spark, sf):
    """Diagonal tensors on the part grid: exp(w / 10), exp(x / 50), 1."""
    return fx.part_image(spark, sf).select("x", "y", F.array(F.exp(F.col("w") / 10), F.lit(0.0), F.lit(0.0), F.exp(F.col("x") / 50), F.lit(0.0), F.lit(1.0)).alias("t"))


@add("tensor_of_volumes", "x y", "xx yy zz", f"{P} :: SELECT x, y, exp(w / 10) AS xx, exp(x / 50.0) AS yy, 1.0 AS zz FROM img")
def _(spark, sf):
    seven = tensor.to_volumes(_on_grid(spark, sf)).withColumn("t", F.col("t") + 1)
    first = fx.part_image(spark, sf).select("x", "y", F.lit(0).cast("bigint").alias("t"), F.lit(9.0).alias("v"))
    got = tensor.from_volumes(seven.unionByName(first))
    return got.select("x", "y", *[tensor.component("t", n).alias(n) for n in ("xx", "yy", "zz")])


@add("tensor_volumes_reflected", "id t", "v", f"{T} :: SELECT id, CAST(k AS BIGINT) AS t, [1 + a * a, -(a * b), -(a * c), 1 + b * b, b * c, 1 + c * c][k + 1] AS v FROM e, range(6) r(k)")
def _(spark, sf):
    return tensor.to_volumes(tensors(spark, sf).select("id", tensor.reflect("t", 1.0).alias("t")))


_GK = "k AS (SELECT d, exp(-d * d / 2.0) AS g FROM (SELECT unnest([-4, -3, -2, -1, 0, 1, 2, 3, 4]) AS d))"
_SMOOTH = f"{P}, {_GK}, gx AS (SELECT a.x, a.y, sum(b.w * g) / sum(g) AS w FROM img a, k JOIN img b ON b.x = a.x + d AND b.y = a.y GROUP BY a.x, a.y), gy AS (SELECT a.x, a.y, sum(b.w * g) / sum(g) AS w FROM gx a, k JOIN gx b ON b.y = a.y + d AND b.x = a.x GROUP BY a.x, a.y)"


@add("tensor_smooth", "x y", "xx zz", f"{_SMOOTH} :: SELECT x, y, exp(w / 10) AS xx, 1.0 AS zz FROM gy", 4)
def _(spark, sf):
    return tensor.smooth(_on_grid(spark, sf), 1.0).select("x", "y", *[tensor.component("t", n).alias(n) for n in ("xx", "zz")])


# A quarter turn about z takes the principal direction, and so the tensor, with it.
@add("tensor_reorient", "id", "xx xy xz yy yz zz", f"{T} :: SELECT id, 1 + b * b AS xx, -(a * b) AS xy, -(b * c) AS xz, 1 + a * a AS yy, a * c AS yz, 1 + c * c AS zz FROM e")
def _(spark, sf):
    turn = F.array(*map(F.lit, (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    got = tensors(spark, sf).select("id", tensor.reorient("t", turn).alias("t"))
    return got.select("id", *[tensor.component("t", n).alias(n) for n in tensor.COMPONENTS])


@add("rotation_between_vectors", "id", "px py pz", "e AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS p, CAST(embedding[5] AS DOUBLE) AS q, CAST(embedding[6] AS DOUBLE) AS r FROM embeddings) :: SELECT id, p * sqrt((a * a + b * b + c * c) / (p * p + q * q + r * r)) AS px, q * sqrt((a * a + b * b + c * c) / (p * p + q * q + r * r)) AS py, r * sqrt((a * a + b * b + c * c) / (p * p + q * q + r * r)) AS pz FROM e")
def _(spark, sf):
    cut = lambda lo: F.transform(F.slice("embedding", lo, 3), lambda x: x.cast("double"))
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), cut(1).alias("a"), cut(4).alias("b"))
    r = e.withColumn("r", tensor.rotation_between("a", "b"))
    at = [F.col("r")[3 * i] * F.col("a")[0] + F.col("r")[3 * i + 1] * F.col("a")[1] + F.col("r")[3 * i + 2] * F.col("a")[2] for i in range(3)]
    return r.select("id", *[v.alias(n) for v, n in zip(at, ("px", "py", "pz"), strict=True)])


# Warps of vectors, series and tensors; stacks of maps and fields.
_QUARTER = "g AS (SELECT x, y, b.i AS x2, b.j AS y2, b.w AS k FROM img, (VALUES (0, 0, 0.375), (1, 0, 0.125), (0, 1, 0.375), (1, 1, 0.125)) b(i, j, w))"


@add("warp_vectors", "x y", "a b", f"{P}, {_QUARTER} :: SELECT g.x, g.y, coalesce(sum(k * i.v), 0) AS a, coalesce(sum(k * i.w), 0) AS b FROM g LEFT JOIN img i ON i.x = g.x + x2 AND i.y = g.y + y2 GROUP BY g.x, g.y")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", F.col("v").alias("a"), F.col("w").alias("b"))
    return transforms.warp_values(a, a, {"x": F.col("x") + 0.25, "y": F.col("y") + 0.5}, ["a", "b"])


@add("warp_series", "x y t", "v", f"{P} :: SELECT g.x, g.y, CAST(t AS BIGINT) AS t, coalesce(i.w + t, 0) AS v FROM img g CROSS JOIN range(3) r(t) LEFT JOIN img i ON i.x = g.x + 2 AND i.y = g.y")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", "w")
    series = a.withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint")))).select("x", "y", "t", (F.col("w") + F.col("t")).alias("v"))
    return transforms.warp_series(series, a, [[1.0, 0.0, 2.0], [0.0, 1.0, 0.0]])


@add("warp_tensors", "x y", "xx yy zz", f"{P} :: SELECT g.x, g.y, CASE WHEN i.x IS NULL THEN 1 ELSE exp(i.x / 50.0) END AS xx, CASE WHEN i.x IS NULL THEN 1 ELSE exp(i.w / 10) END AS yy, 1.0 AS zz FROM img g LEFT JOIN img i ON i.x = g.y AND i.y = 3 - g.x", 5)
def _(spark, sf):
    t = _on_grid(spark, sf)
    got = transforms.warp_tensors(t, t.select("x", "y"), [[0.0, 1.0, 0.0], [-1.0, 0.0, 3.0]])
    return got.select("x", "y", *[tensor.component("t", n).alias(n) for n in ("xx", "yy", "zz")])


@add("field_of_stack", "x y", "ux uy", f"{P} :: SELECT x, y, 2 * (x + 0.5) + 1 - x AS ux, CASE WHEN x + 0.5 <= 49 THEN 2.0 ELSE 2.0 END - y + y AS uy FROM img")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y")
    still = a.select("x", "y", F.lit(0.5).alias("ux"), F.lit(0.0).alias("uy"))
    return transforms.field_of(a, [[[2.0, 0.0, 1.0], [0.0, 1.0, 2.0]], still])


@add("stack_of_map_then_field", "x y", "ux uy", f"{P} :: SELECT x, y, 1.0 + CASE WHEN x < 49 THEN 0.25 ELSE 0.0 END AS ux, 0.0 AS uy FROM img")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y")
    return transforms.field_of(a, [a.select("x", "y", F.lit(0.25).alias("ux"), F.lit(0.0).alias("uy")), [[1.0, 0.0, 1.0], [0.0, 1.0, 0.0]]])


@add("transform_description", "", "determinant shift stretch degrees", "SELECT 4.0 AS determinant, sqrt(5.0) AS shift, 2.0 AS stretch, degrees(atan2(0.6, 0.8)) AS degrees")
def _(spark, sf):
    d = transforms.describe([[1.6, -1.2, 2.0], [1.2, 1.6, -1.0]])
    return spark.createDataFrame([tuple(d[k] for k in ("determinant", "shift", "stretch", "degrees"))], "determinant double, shift double, stretch double, degrees double")


@add("transform_difference", "", "mean max", f"{P}, d AS (SELECT sqrt(pow(0.1 * x + 1, 2) + pow(0.2 * y, 2)) AS d FROM img) :: SELECT avg(d) AS mean, max(d) AS max FROM d")
def _(spark, sf):
    p = fx.part_image(spark, sf).select(F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    return transforms.difference([[1.1, 0.0, 1.0], [0.0, 1.2, 0.0]], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], p)


@add("transform_average", "row", "a b c", "SELECT * FROM (VALUES (0, 1.25, 0.0, 1.0), (1, 0.0, 1.0, 0.5)) t(row, a, b, c)")
def _(spark, sf):
    m = transforms.average([[[1.0, 0.0, 0.0], [0.0, 1.0, 2.0]], [[4.0 / 3, 0.0, 4.0 / 3], [0.0, 1.0, 0.0]]], [1.0, 3.0])
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "row int, a double, b double, c double")


@add("transform_average_no_rigid", "row", "a b c", "SELECT * FROM (VALUES (0, 1.5, 0.0, 0.0), (1, 0.0, 2.0, 0.0)) t(row, a, b, c)")
def _(spark, sf):
    m = transforms.average_no_rigid([[[0.0, -3.0, 7.0], [2.0, 0.0, 1.0]], [[1.0, 0.0, 5.0], [0.0, 1.0, 0.0]]])
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "row int, a double, b double, c double")


@add("transform_stack_text", "k row", "a b c", "SELECT * FROM (VALUES (0, 0, 0.8, -0.6, 2.0), (0, 1, 0.6, 0.8, -1.0), (1, 0, 1.0, 0.0, 3.0), (1, 1, 0.0, 1.0, 4.0)) t(k, row, a, b, c)")
def _(spark, sf):
    stack = files.parse_transforms(files.format_transforms([[[0.8, -0.6, 2.0], [0.6, 0.8, -1.0]], [[1.0, 0.0, 3.0], [0.0, 1.0, 4.0]]]))
    return spark.createDataFrame([(k, i, *map(float, r)) for k, m in enumerate(stack) for i, r in enumerate(m)], "k int, row int, a double, b double, c double")


_EDGE = "b AS (SELECT max(x) AS mx, max(y) AS my FROM img)"


@add("make_displacement_field", "x y", "ux uy", f"{P}, {_EDGE} :: SELECT x, y, CASE WHEN x IN (0, mx) OR y IN (0, my) THEN 0 ELSE v END AS ux, CASE WHEN x IN (0, mx) OR y IN (0, my) THEN 0 ELSE w END AS uy FROM img, b")
def _(spark, sf):
    a = fx.part_image(spark, sf)
    return transforms.make_field([a.select("x", "y", "v"), a.select("x", "y", F.col("w").alias("v"))], still_border=True)


@add("smooth_displacement_field", "x y", "ux uy", f"{_SMOOTH}, {_EDGE} :: SELECT x, y, CASE WHEN x IN (0, mx) OR y IN (0, my) THEN 0 ELSE w END AS ux, 0.0 AS uy FROM gy, b")
def _(spark, sf):
    return transforms.smooth_field(fx.part_image(spark, sf).select("x", "y", F.col("w").alias("ux"), F.lit(0.0).alias("uy")), 1.0)


@add("simulated_field_border", "", "border n", f"{P}, {_EDGE} :: SELECT 0.0 AS border, count(*) AS n FROM img, b WHERE x IN (0, mx) OR y IN (0, my)")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y")
    f = transforms.simulate_field(a, 3, kind="exponential", smoothing=1.0)
    ends = a.agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    edge = f.crossJoin(F.broadcast(ends)).filter("x = 0 OR y = 0 OR x = mx OR y = my")
    return edge.agg(F.max(F.abs("ux") + F.abs("uy")).alias("border"), F.count(F.lit(1)).alias("n"))


@add("simulated_field", "x y", "ux uy", None)
def _(spark, sf):
    return transforms.simulate_field(fx.part_image(spark, sf).select("x", "y"), 3)


@add("geometric_jacobian", "x y", "v", f"{FIELD}, b AS (SELECT max(x) AS mx, max(y) AS my FROM f) :: SELECT x, y, 1.1 * 1.05 + 0.02 * 0.01 AS v FROM f, b WHERE x < mx AND y < my")
def _(spark, sf):
    return transforms.geometric_jacobian(field(spark, sf).select("x", "y", "ux", "uy"))


@add("vector_direction_kept", "x y", "a b", f"{FIELD}, q AS (SELECT x, y, v, 1.1 * v + 0.02 AS p, -0.01 * v + 1.05 AS q FROM f) :: SELECT x, y, p * sqrt((v * v + 1) / (p * p + q * q)) AS a, q * sqrt((v * v + 1) / (p * p + q * q)) AS b FROM q")
def _(spark, sf):
    f = field(spark, sf)
    return transforms.keep_direction(f, f.select("x", "y", F.col("v").alias("a"), F.lit(1.0).alias("b")))


@add("integrate_velocity", "x y", "ux uy", f"{P} :: SELECT x, y, CASE WHEN x >= 1 THEN -0.5 ELSE -0.25 END AS ux, 0.0 AS uy FROM img WHERE x >= 1")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y")
    v = lambda c: a.select("x", "y", F.lit(c).alias("ux"), F.lit(0.0).alias("uy"))
    return transforms.integrate_velocity([v(0.0), v(-1.0)], a, 4).filter("x >= 1")


@add("rotate_directions", "t", "dx dy dz", "SELECT CAST(i AS BIGINT) AS t, -sin(0.1 * i) AS dx, cos(0.1 * i) AS dy, CAST(i AS DOUBLE) AS dz FROM range(20) r(i)")
def _(spark, sf):
    t, zero, one = F.col("id"), F.lit(0.0), F.lit(1.0)
    d = spark.range(20).select(t.alias("t"), zero.alias("dx"), one.alias("dy"), t.cast("double").alias("dz"))
    c, s = F.cos(0.1 * t), F.sin(0.1 * t)
    return transforms.rotate_directions(d, spark.range(20).select(t.alias("t"), F.array(c, -s, zero, s, c, zero, zero, zero, one).alias("r")))


@add("lipschitz_all_pairs", "x y", "v", f"{P} :: SELECT a.x, a.y, max(abs(a.v - b.v) / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS v FROM img a JOIN img b ON NOT (a.x = b.x AND a.y = b.y) GROUP BY a.x, a.y")
def _(spark, sf):
    return transforms.lipschitz_all(fx.part_image(spark, sf).select("x", "y", F.col("v").alias("ux"), F.lit(0.0).alias("uy")), 8)


# Splines.
_BASIS = "CASE j WHEN 0 THEN pow(1 - u, 3) / 6 WHEN 1 THEN (3 * pow(u, 3) - 6 * u * u + 4) / 6 WHEN 2 THEN (-3 * pow(u, 3) + 3 * u * u + 3 * u + 1) / 6 ELSE pow(u, 3) / 6 END"


def _curve(name: str, value: str, out: str, spans: int, source: str) -> str:
    """SQL of one level: value of ``source`` (x and that value) on a lattice of spans, as table ``out`` (x, fit)."""
    return f"{out}t AS (SELECT x, {value} AS v, least((x - 0.0) / 49 * {spans}, {spans} - 1e-9) AS t FROM {source}), {out}k AS (SELECT x, v, CAST(floor(t) AS INT) + j AS c, {_BASIS} AS w FROM (SELECT x, v, t, t - floor(t) AS u, j FROM {out}t, range(4) r(j))), {out}z AS (SELECT x, sum(w * w) AS z FROM {out}k GROUP BY x), {out}l AS (SELECT c, sum(w * w * w * v / z) / sum(w * w) AS phi FROM {out}k JOIN {out}z USING (x) GROUP BY c), {out} AS (SELECT {out}k.x, any_value({out}k.v) AS v, sum(w * phi) AS fit FROM {out}k JOIN {out}l USING (c) GROUP BY {out}k.x)"


_SPLINE = f"{P}, pts AS (SELECT x, avg(w) AS a FROM img GROUP BY x), {_curve('one', 'a', 'one', 4, 'pts')}, {_curve('two', 'v - fit', 'two', 8, 'one')}"


@add("spline_curve", "x", "fit", f"{_SPLINE} :: SELECT x, one.fit + two.fit AS fit FROM one JOIN two USING (x)")
def _(spark, sf):
    p = fx.part_image(spark, sf).groupBy("x").agg(F.avg("w").alias("a"))
    return spline.fit_points(p, ["x"], ["a"], (4,), 2).withColumn("fit", F.col("fit")[0])


@add("spline_interpolation", "x y", "v", f"{P} :: SELECT a.x, a.y, b.w AS v FROM img a JOIN img b ON b.x = a.x + 1 AND b.y = a.y")
def _(spark, sf):
    got = spline.interpolate(fx.part_image(spark, sf).select("x", "y", F.col("w").alias("v")), {"x": 1.0})
    return got.filter("x < 49")


@add("spline_interpolation_half", "x", "v", "SELECT CAST(i AS BIGINT) AS x, CAST(3 * (i + 0.5) + 2 AS DOUBLE) AS v FROM range(10, 40) r(i)", 5)
def _(spark, sf):
    line = spark.range(50).select(F.col("id").alias("x"), (3.0 * F.col("id") + 2).alias("v"))
    return spline.interpolate(line, {"x": 0.5}).filter("x >= 10 AND x < 40")


@add("spline_field", "x y", "ux uy", None)
def _(spark, sf):
    return spline.smooth_field(field(spark, sf).select("x", "y", "ux", "uy"), 4, 2)


@add("landmark_spline_field", "label", "miss", f"{P} :: SELECT DISTINCT la AS label, 0.0 AS miss FROM img WHERE la IN (7, 23)", 2)
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", F.when(F.col("la").isin(7, 23), F.col("la")).otherwise(0).alias("label"))
    one = a.filter("label <> 0").groupBy("label").agg(F.min(F.struct("y", "x")).alias("p")).select("label", "p.x", "p.y")
    f = spline.landmark_field(one, one.withColumn("x", F.col("x") + F.when(F.col("label") == 7, 1).otherwise(2)), a, 8, 4)
    at = one.join(f, ["x", "y"])
    return at.select("label", F.abs(F.col("ux") - F.when(F.col("label") == 7, 1).otherwise(2)).alias("miss"))


@add("super_resolution", "", "n close", f"{P} :: SELECT CAST(count(*) * 2 - count(DISTINCT y) AS DOUBLE) AS n, 1.0 AS close FROM img")
def _(spark, sf):
    smooth = lambda x, y: F.sin(x / 8) + F.cos(y / 6)
    a = fx.part_image(spark, sf).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    samples = a.union(a.select(F.least(F.col("x") + 0.5, F.lit(49.0)), F.col("y"))).withColumn("v", smooth(F.col("x"), F.col("y")))
    fine = a.union(a.filter("x < 49").select(F.col("x") + 0.5, F.col("y"))).distinct()
    got = spline.super_resolution(samples, fine, 8, 3)
    return got.agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("v") - smooth(F.col("x"), F.col("y")))) < 0.2).cast("double").alias("close"))


# Bias fields: a planted smooth factor on two levels is found and taken out.
def _biased(spark, sf):
    x = F.col("x") / 49 - 0.5
    level = F.when(F.pmod(F.col("la"), F.lit(2)) == 0, 100.0).otherwise(200.0)
    return fx.part_image(spark, sf).select("x", "y", level.alias("true"), (level * F.exp(0.4 * x)).alias("v"))


def _bias_left(spark, sf, f):
    a = _biased(spark, sf)
    got = f(a.select("x", "y", "v")).join(a.select("x", "y", "true"), ["x", "y"])
    spread = lambda c: F.stddev_pop(F.col(c) / F.col("true")) / F.avg(F.col(c) / F.col("true"))
    return got.withColumn("raw", F.col("v") * F.col("field")).agg((spread("v") < 0.5 * spread("raw")).alias("better"))


@add("bias_splines", "better", "", "SELECT TRUE AS better")
def _(spark, sf):
    return _bias_left(spark, sf, lambda a: bias.correct(a, levels=2, rounds=4))


@add("bias_single_lattice", "better", "", "SELECT TRUE AS better")
def _(spark, sf):
    return _bias_left(spark, sf, lambda a: bias.correct_single(a, spans=2, rounds=4))


# Registration: a planted map or shift is found.
def _side_by_side(fixed: DataFrame, read: DataFrame, moving: DataFrame) -> DataFrame:
    """The fixed image's v, the moved one's m and the moving one's o by cell; cells are never broadcast."""
    return fixed.join(unbroadcast(read), ["x", "y"]).join(unbroadcast(moving.withColumnRenamed("v", "o")), ["x", "y"])


def _shape(spark, sf, dx: float, dy: float = 0.0):
    return fx.part_image(spark, sf).select("x", "y", F.exp(-((F.col("x") - 22 - dx) ** 2) / 60 - (F.col("y") - 1.5 - dy) ** 2 / 30).alias("v"))


def _linear(name: str, kind: str, metric: str) -> None:
    @add(f"register_{name}", "found", "", "SELECT TRUE AS found")
    def _(spark, sf):
        fixed, moving = _shape(spark, sf, 0.0), _shape(spark, sf, 2.0)
        m, _, _ = registration.linear(fixed, moving, kind, metric, levels=((1, 0.0),), steps=6)
        ends = registration.scores(fixed, moving, [[[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], m], "msq")
        return spark.createDataFrame([(bool(ends[1] < 0.2 * ends[0]),)], "found boolean")


for _name, _kind, _metric in (("shift_by_correlation", "translation", "gc"), ("rigid", "rigid", "msq"), ("similarity", "similarity", "msq"), ("affine_by_search", "affine", "msq"), ("composite_affine", "composite_affine", "msq"), ("shift_by_information", "translation", "mi")):
    _linear(_name, _kind, _metric)


def _deformable(name: str, **options) -> None:
    @add(f"register_{name.lower()}", "better", "", "SELECT TRUE AS better")
    def _(spark, sf):
        fixed, moving = _shape(spark, sf, 0.0), _shape(spark, sf, 1.5)
        got = registration.MODELS[name](fixed, moving, **{"rounds": 1, **options}).forward
        read = transforms.warp_field(moving, got).withColumnRenamed("v", "m")
        rows = _side_by_side(fixed, read, moving)
        return rows.agg((F.avg((F.col("v") - F.col("m")) ** 2) < F.avg((F.col("v") - F.col("o")) ** 2)).alias("better"))


_deformable("GaussianDisplacementField")
_deformable("BSplineDisplacementField")
_deformable("BSpline")
_deformable("SyN")
_deformable("BSplineSyN")
_deformable("Exponential")
_deformable("BSplineExponential")
_deformable("TimeVaryingVelocityField")
_deformable("TimeVaryingBSplineVelocityField")


@add("register_syn_by_correlation", "better", "", "SELECT TRUE AS better")
def _(spark, sf):
    fixed, moving = _shape(spark, sf, 0.0), _shape(spark, sf, 1.5)
    got = registration.symmetric(fixed, moving, 1, metric="cc").forward
    read = transforms.warp_field(moving, got).withColumnRenamed("v", "m")
    rows = _side_by_side(fixed, read, moving)
    return rows.agg((F.corr("v", "m") > F.corr("v", "o")).alias("better"))


@add("register_stages", "better", "", "SELECT TRUE AS better")
def _(spark, sf):
    fixed, moving = _shape(spark, sf, 0.0), _shape(spark, sf, 3.0)
    got, _ = registration.register(fixed, moving, [("Translation", {"steps": 4}), ("SyN", {"rounds": 1})], ((1, 0.0),))
    read = transforms.warp_field(moving, got).withColumnRenamed("v", "m")
    rows = _side_by_side(fixed, read, moving)
    return rows.agg((F.avg((F.col("v") - F.col("m")) ** 2) < 0.5 * F.avg((F.col("v") - F.col("o")) ** 2)).alias("better"))


# Mixtures of several features, priors, outliers.
def _two(spark, sf):
    """Three classes planted on the part grid by label, told apart by two features together."""
    c = F.pmod(F.col("la"), F.lit(3))
    noise = (F.col("v") % 7) / 7
    return fx.part_image(spark, sf).select("x", "y", (c + 1).cast("bigint").alias("true"), (F.when(c == 0, 0.0).when(c == 1, 4.0).otherwise(8.0) + noise).alias("a"), (F.when(c == 1, 5.0).otherwise(0.0) + noise / 2).alias("b"))


def _mixture(name: str, f) -> None:
    @add(f"mixture_{name}", "x y label", "", f"{P} :: SELECT x, y, la % 3 + 1 AS label FROM img")
    def _(spark, sf):
        a = _two(spark, sf)
        return f(a)[0]


def _priors(a):
    return a.select("x", "y", F.col("true").alias("label"), F.lit(0.9).alias("p"))


_mixture("two_features", lambda a: mixture.segment(a, ["a", "b"], mixture.Options(rounds=3)))
_mixture("otsu_start", lambda a: mixture.segment(a, ["a"], mixture.Options(rounds=3, start="otsu")))
_mixture("prior_start", lambda a: mixture.segment(a, ["a"], mixture.Options(rounds=2, start="priors", prior_weight=0.5), _priors(a)))
_mixture("plato", lambda a: mixture.segment(a, ["a"], mixture.Options(rounds=2, prior_weight=0.3, posterior="plato"), _priors(a).withColumn("p", F.lit(1.0))))
_mixture("aristotle", lambda a: mixture.segment(a, ["a"], mixture.Options(rounds=2, prior_weight=0.3, posterior="aristotle"), _priors(a), _priors(a)))
_mixture("sigmoid", lambda a: mixture.segment(a, ["a"], mixture.Options(rounds=2, prior_weight=0.3, posterior="sigmoid"), _priors(a)))
_mixture("parzen", lambda a: mixture.segment(a, ["a", "b"], mixture.Options(rounds=2, likelihood="parzen")))
_mixture("annealed", lambda a: mixture.segment(a, ["a"], mixture.Options(rounds=3, annealing=(2.0, 0.8, 1.0))))
_mixture("conditional_modes", lambda a: mixture.segment(a, ["a"], mixture.Options(rounds=1, smoothing=0.2, icm=True)))
_mixture("winsorized", lambda a: mixture.segment(a, ["a"], mixture.Options(rounds=2, outliers="boxplot")))


_BX = f"{P}, o AS (SELECT x, y, CASE WHEN x = 0 AND y = 0 THEN 5000.0 ELSE w END AS v FROM img), s AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM o), h AS (SELECT k, (SELECT count(*) FROM o, s WHERE least(floor((v - lo) / (hi - lo) * 200), 199) < k) / (SELECT n FROM s) AS c0, (SELECT count(*) FROM o, s WHERE least(floor((v - lo) / (hi - lo) * 200), 199) <= k) / (SELECT n FROM s) AS c1 FROM range(200) b(k)), q AS (SELECT max(lo + (k + (0.25 - c0) / (c1 - c0)) * (hi - lo) / 200) FILTER (c0 <= 0.25 AND c1 > 0.25) AS q1, max(lo + (k + (0.75 - c0) / (c1 - c0)) * (hi - lo) / 200) FILTER (c0 <= 0.75 AND c1 > 0.75) AS q3 FROM h, s)"


@add("outliers_boxplot", "x y", "out", f"{_BX} :: SELECT x, y, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), v)) AS out FROM o, q")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", F.when((F.col("x") == 0) & (F.col("y") == 0), 5000.0).otherwise(F.col("w")).alias("v"))
    return mixture.boxplot(a)


@add("outliers_grubbs", "x y", "out", f"{P} :: SELECT x, y, CASE WHEN x = 0 AND y < 2 THEN NULL ELSE w END AS out FROM img")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", F.when((F.col("x") == 0) & (F.col("y") < 2), 5000.0 * (1 - 2 * F.col("y"))).otherwise(F.col("w")).alias("v"))
    return mixture.grubbs(a)


# Surfaces.
_CU = f"{P}, a AS (SELECT x, y, v, (coalesce(lead(v) OVER wx, v) - coalesce(lag(v) OVER wx, v)) / (count(*) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) - 1) AS gx, (coalesce(lead(v) OVER wy, v) - coalesce(lag(v) OVER wy, v)) / (count(*) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) - 1) AS gy FROM img WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y))"
_D2 = ", ".join(f"(coalesce(lead(g{c}) OVER w{d}, g{c}) - coalesce(lag(g{c}) OVER w{d}, g{c})) / (count(*) OVER (PARTITION BY {'y' if d == 'x' else 'x'} ORDER BY {d} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) - 1) AS g{c}{d}" for c in "xy" for d in "xy")


@add("level_curvature", "x y", "kappa", f"{_CU}, h AS (SELECT *, {_D2} FROM a WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y)) :: SELECT x, y, CASE WHEN gx * gx + gy * gy > 1e-12 THEN ((gx * gx + gy * gy) * (gxx + gyy) - (gx * gx * gxx + gx * gy * (gxy + gyx) + gy * gy * gyy)) / pow(gx * gx + gy * gy, 1.5) ELSE 0 END AS kappa FROM h")
def _(spark, sf):
    return surface.curvature(fx.part_image(spark, sf))


_TN = f"{P}, c AS (SELECT x, y FROM img WHERE w > 25), n AS (SELECT c.x, c.y, " + ", ".join(f"1 - count(*) FILTER (d.x = c.x + ({dx}) AND d.y = c.y + ({dy})) AS b{k}" for k, (dx, dy) in enumerate(surface._RING)) + " FROM c LEFT JOIN c d ON abs(d.x - c.x) <= 1 AND abs(d.y - c.y) <= 1 GROUP BY c.x, c.y), t AS (SELECT x, y, " + " + ".join(f"(b{k} - b{k} * b{(k + 1) % 8} * b{(k + 2) % 8})" for k in (0, 2, 4, 6)) + " AS number FROM n)"


@add("topological_numbers", "x y number simple", "", f"{_TN} :: SELECT x, y, CAST(number AS BIGINT) AS number, CAST(number = 1 AS BIGINT) AS simple FROM t")
def _(spark, sf):
    return surface.topological_numbers(fx.part_image(spark, sf).withColumn("v", (F.col("w") > 25).cast("int")))


@add("skeleton", "components thinner", "", "SELECT CAST(5 AS BIGINT) AS components, TRUE AS thinner")
def _(spark, sf):
    """The skeleton of five bars is five lines."""
    a = fx.part_image(spark, sf).select("x", "y", (F.col("x") % 10 < 7).cast("int").alias("v"))
    got = surface.skeleton(a, 8)
    left = iterative.connected_components(got, full=True).agg(F.count_distinct("component").alias("components"), F.count(F.lit(1)).alias("n"))
    return left.crossJoin(a.agg(F.sum("v").alias("all"))).select("components", (2 * F.col("n") < F.col("all")).alias("thinner"))


_SM = f"{P}, m AS (SELECT x, y, w AS v FROM img WHERE lb % 2 = 1), s AS (SELECT a.x, a.y, avg(b.v) AS v FROM m a JOIN m b ON abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY a.x, a.y)"


@add("smooth_in_mask", "x y", "v", f"{_SM} :: SELECT i.x, i.y, coalesce(s.v, i.w) AS v FROM img i LEFT JOIN s ON s.x = i.x AND s.y = i.y")
def _(spark, sf):
    return surface.smooth_in_mask(fx.part_image(spark, sf).withColumn("m", F.col("lb") % 2), "m", 1, "w")


_MG = f"{P}, {_GK}, m AS (SELECT x, y, w AS v FROM img WHERE lb % 2 = 1), gx AS (SELECT a.x, a.y, sum(b.v * g) / sum(g) AS v FROM m a, k JOIN m b ON b.x = a.x + d AND b.y = a.y GROUP BY a.x, a.y), gy AS (SELECT a.x, a.y, sum(b.v * g) / sum(g) AS v FROM gx a, k JOIN gx b ON b.y = a.y + d AND b.x = a.x GROUP BY a.x, a.y)"


@add("masked_gaussian", "x y", "v", f"{_MG} :: SELECT i.x, i.y, coalesce(s.v, 0) AS v FROM img i LEFT JOIN gy s ON s.x = i.x AND s.y = i.y")
def _(spark, sf):
    return surface.masked_gaussian(fx.part_image(spark, sf).withColumn("m", F.col("lb") % 2), "m", 1.0, "w")


# Time series.
_RE = f"{S}, g AS (SELECT t, avg(v) AS g FROM ser GROUP BY t), b AS (SELECT x, regr_slope(v, g) AS s, regr_intercept(v, g) AS i FROM ser JOIN g USING (t) GROUP BY x HAVING count(DISTINCT g) > 1)"


@add("residual_series", "x t", "v", f"{_RE} :: SELECT x, t, v - i - s * g AS v FROM ser JOIN g USING (t) JOIN b USING (x)", 4)
def _(spark, sf):
    s = fx.event_series(spark, sf)
    g = s.groupBy("t").agg(F.avg("v").alias("g"))
    many = s.groupBy("x").agg(F.count("t").alias("n")).filter("n > 1").select("x")
    return timeseries.residual(s.join(many, "x", "left_semi"), g, ["g"])


@add("tissue_confounds", "t", "global", f"{S} :: SELECT t, avg(v) AS global FROM ser WHERE x % 4 > 0 GROUP BY t", 7)
def _(spark, sf):
    return timeseries.tissue_confounds(fx.event_series(spark, sf).withColumn("label", F.col("x") % 4), components=1)


@add("region_similarity", "a b within", "", f"{S}, l AS (SELECT DISTINCT x % 4 AS l FROM ser WHERE x % 4 > 0) :: SELECT p.l AS a, q.l AS b, TRUE AS within FROM l p JOIN l q ON p.l < q.l")
def _(spark, sf):
    got = timeseries.region_similarity(fx.event_series(spark, sf).withColumn("label", F.col("x") % 4), 30)
    return got.withColumn("within", (F.col("r") > 0) & (F.col("r") <= 1))


@add("number_of_volumes", "n", "", f"{S} :: SELECT count(DISTINCT t) AS n FROM ser")
def _(spark, sf):
    return timeseries.volumes(fx.event_series(spark, sf))


# Decompositions of the embeddings' covariance.
def _cov(spark, sf, width: int = 16):
    m = fx.table(spark, sf, "embeddings").select(F.transform(F.slice("embedding", 1, width), lambda x: x.cast("double")).alias("values"))
    return covariance(m)[2]


_TRACE = "p AS (SELECT i, var_pop(CAST(embedding[i + 1] AS DOUBLE)) AS v FROM embeddings, range(16) r(i) GROUP BY i)"


@add("components_total_variance", "", "v", f"{_TRACE} :: SELECT sum(v) AS v FROM p")
def _(spark, sf):
    import numpy as np

    cov = _cov(spark, sf)
    _, w = sparse.deflated(cov, 16, lambda c: np.linalg.eigh(c)[1][:, -1])
    return spark.createDataFrame([(float(w.sum()),)], "v double")


def _identity(name: str, f, sql: str = "SELECT 0.0 AS e", digits: int = 5) -> None:
    @add(name, "", "e", sql, digits)
    def _(spark, sf):
        return spark.createDataFrame([(float(f(_cov(spark, sf))),)], "e double")


def _np():
    import numpy as np

    return np


_identity("pseudo_inverse_identity", lambda c: _np().abs(c @ sparse.pseudo_inverse(c) @ c - c).max())
_identity("power_iteration_residual", lambda c: _np().linalg.norm(c @ (v := sparse.power(c, 3000)) - (v @ c @ v) * v))
_identity("sparse_power_keeps", lambda c: (sparse.power_sparse(c, 4) != 0).sum(), "SELECT 4.0 AS e")
_identity("greedy_component_of_all", lambda c: sparse.energy(c, sparse.greedy(c, 16)) + _np().linalg.eigvalsh(c)[-1])
_identity("conjugate_component", lambda c: max(0.0, 0.95 * _np().linalg.eigvalsh(c)[-1] + sparse.energy(c, sparse.conjugate(c))))
_identity("reconstruction_of_all", lambda c: sparse.reconstruct(c, 16)[2])
_identity("explained_variance", lambda c: sparse.explained(c, _np().linalg.eigh(c)[1]).sum() - _np().trace(c))
_identity("canonical_pair_of_itself", lambda c: sparse.canonical(_np().block([[c, c], [c, c]]), 16)[0][0], "SELECT 1.0 AS e", 3)
_identity("golden_section", lambda c: sparse.golden_section(lambda x: (x - 2) ** 2, 0.0, 5.0), "SELECT 2.0 AS e")
_identity("unit_by_covariance", lambda c: (v := sparse.unit(_np().ones(16), c)) @ c @ v, "SELECT 1.0 AS e")


@add("component_diagnostics", "name", "r", "e AS (SELECT CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) AS s, CAST(embedding[3] AS DOUBLE) AS p, CAST(embedding[4] AS DOUBLE) AS q FROM embeddings) :: SELECT 'p' AS name, corr(s, p) AS r FROM e UNION ALL SELECT 'q', corr(s, q) FROM e")
def _(spark, sf):
    d = lambda i: F.col("embedding")[i].cast("double")
    return sparse.diagnostics(fx.table(spark, sf, "embeddings").select((d(0) + d(1)).alias("s"), d(2).alias("p"), d(3).alias("q")), "s", ["p", "q"])


@add("network_components", "", "e", "SELECT 0.0 AS e")
def _(spark, sf):
    from gridloom.operators.matrix import gram
    from gridloom.plans.queries_more import _columns

    return spark.createDataFrame([(sparse.network(gram(_columns(spark, sf), "x", "y"), 8, 1.0)[2],)], "e double")


# Point sets: suppliers on a grid of places, against themselves moved.
_PTS = "s AS (SELECT s_suppkey AS id, s_suppkey % 10 * 1.0 AS px, s_suppkey // 10 * 1.0 AS py FROM supplier), d AS (SELECT a.id, a.px, a.py, b.id AS t, b.px AS qx, b.py AS qy, sqrt(pow(a.px + 0.2 - b.px, 2) + pow(a.py - b.py, 2)) AS d FROM s a JOIN s b ON abs(a.px + 0.2 - b.px) <= 2 AND abs(a.py - b.py) <= 2)"


def _points(spark, sf):
    s = fx.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10 * 1.0).cast("double").alias("px"), (F.expr("s_suppkey div 10") * 1.0).cast("double").alias("py"))


def _moved(spark, sf):
    return _points(spark, sf).withColumn("px", F.col("px") + 0.2)


@add("nearest_points", "id rank near", "d", f"{_PTS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), t) AS k FROM d WHERE d <= 1.5) :: SELECT id, CAST(k AS INT) AS rank, t AS near, d FROM r WHERE k <= 3")
def _(spark, sf):
    return points.neighbours(_moved(spark, sf), _points(spark, sf), 3, 1.5).withColumnRenamed("to", "near")


_PI = repr(math.pi)


@add("point_density", "id", "density", f"{_PTS} :: SELECT id, sum(CASE WHEN d <= 2 THEN exp(-d * d / 0.5) / (2 * {_PI} * 0.25) ELSE 0 END) / (SELECT count(*) FROM s) AS density FROM d GROUP BY id")
def _(spark, sf):
    return points.density(_moved(spark, sf), _points(spark, sf), 0.5)


@add("point_set_expectation", "n", "metric", f"{_PTS}, e AS (SELECT id, any_value(px) + 0.2 AS px, any_value(py) AS py, sum(exp(-d * d / 0.5) * qx) / sum(exp(-d * d / 0.5)) AS ex, sum(exp(-d * d / 0.5) * qy) / sum(exp(-d * d / 0.5)) AS ey FROM d WHERE d <= 2 GROUP BY id) :: SELECT count(*) AS n, avg(sqrt(pow(px - ex, 2) + pow(py - ey, 2))) AS metric FROM e")
def _(spark, sf):
    return points.pse(_moved(spark, sf), _points(spark, sf), 0.5)


def _entropy(name: str, rows: str) -> str:
    return f"{name}d AS (SELECT a.i, sum(exp(-(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) / 0.5)) / (2 * {_PI} * 0.25) / (SELECT count(*) FROM {rows}) AS f FROM {rows} a JOIN {rows} b ON sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) <= 2 GROUP BY a.i), {name} AS (SELECT 1 - avg(f) AS h, count(*) AS n FROM {name}d)"


@add("point_set_divergence", "", "metric", f"{_PTS.split(', d AS')[0]}, a AS (SELECT 'a' || id AS i, px + 0.2 AS px, py FROM s), b AS (SELECT 'b' || id AS i, px, py FROM s), u AS (SELECT * FROM a UNION ALL SELECT * FROM b), {_entropy('hu', 'u')}, {_entropy('ha', 'a')}, {_entropy('hb', 'b')} :: SELECT hu.h - (ha.n * ha.h + hb.n * hb.h) / hu.n AS metric FROM hu, ha, hb")
def _(spark, sf):
    return points.jhct(_moved(spark, sf), _points(spark, sf), 0.5)


@add("point_set_divergence_by_label", "label", "metric", None)
def _(spark, sf):
    tag = lambda p: p.withColumn("label", (F.col("id") % 2).cast("bigint"))
    return points.jhct_by_label(tag(_moved(spark, sf)), tag(_points(spark, sf)), 0.5, [0, 1])


@add("point_intensity_metric", "n", "metric", "s AS (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier) :: SELECT count(*) AS n, 1.0 AS metric FROM s")
def _(spark, sf):
    p = _points(spark, sf).join(fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value")), "id").withColumns({"g0": F.lit(0.0), "g1": F.lit(1.0)})
    return points.igdm(p.withColumns({"px": F.col("px") + 0.2, "g1": F.lit(2.0)}), p, 0.9, 1.0, 100.0)


@add("match_blobs", "a b", "", "SELECT s_suppkey AS a, s_suppkey AS b FROM supplier WHERE s_suppkey < 20")
def _(spark, sf):
    p = _points(spark, sf).filter("id < 20")
    return points.match_blobs(p.withColumn("px", F.col("px") + 0.2), p, ["px", "py"], 1.0)


_NET = "e AS (SELECT DISTINCT s_nationkey AS u, c_nationkey AS v FROM supplier JOIN customer ON s_suppkey % 40 = c_custkey % 40 WHERE s_nationkey <> c_nationkey), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e)"


def _edges(spark, sf):
    s, c = fx.table(spark, sf, "supplier"), fx.table(spark, sf, "customer")
    return s.join(c, (s.s_suppkey % 40) == (c.c_custkey % 40)).select(F.col("s_nationkey").alias("u"), F.col("c_nationkey").alias("v")).filter("u <> v").distinct()


_RANKS = ", ".join(f"r{k} AS (SELECT b.v AS u, 0.15 / any_value(k.n) + 0.85 * sum(r.r / d.d) AS r FROM b JOIN r{k - 1} r ON r.u = b.u JOIN d ON d.u = b.u, k GROUP BY b.v)" for k in range(1, 6))


@add("network_measures", "node degree", "rank", f"{_NET}, d AS (SELECT u, count(*) AS d FROM b GROUP BY u), k AS (SELECT count(*) AS n FROM d), r0 AS (SELECT u, 1.0 / n AS r FROM d, k), {_RANKS} :: SELECT r5.u AS node, d.d AS degree, r5.r AS rank FROM r5 JOIN d USING (u)")
def _(spark, sf):
    return points.network_measures(_edges(spark, sf), 5)


@add("shortest_paths", "node", "distance", f"RECURSIVE {_NET}, r(u, d) USING KEY (u) AS (SELECT min(u), CAST(0 AS DOUBLE) FROM b UNION SELECT b.v, min(r.d + 1 + (b.u + b.v) % 3) FROM r JOIN b ON b.u = r.u LEFT JOIN recurring.r q ON q.u = b.v WHERE q.u IS NULL OR q.d > r.d + 1 + (b.u + b.v) % 3 GROUP BY b.v) :: SELECT u AS node, d AS distance FROM r")
def _(spark, sf):
    e = _edges(spark, sf)
    both = e.union(e.select("v", "u")).distinct().withColumn("cost", (1 + (F.col("u") + F.col("v")) % 3).cast("double"))
    return points.shortest_paths(both, both.agg(F.min("u")).first()[0])
