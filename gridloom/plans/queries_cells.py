"""Queries over one image: cell-wise, label, neighbourhood, layout and iterative operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.grid import Geometry
from gridloom.operators import iterative, label, layout, neighborhood, pixel
from gridloom.plans.registry import Registry
from gridloom.sources import fixtures as fx

REGISTRY = Registry()
add = REGISTRY.add
P = fx.PART_SQL
G = Geometry(size=(50, 1), spacing=(1.0, 2.0), origin=(10.0, -5.0))
UNIT = Geometry(size=(50, 1))
#: The same geometry in SQL.
PX, PY = "(10.0 + 1.0 * x)", "(-5.0 + 2.0 * y)"

# Cell-wise operations with a second image: name, SQL of the result.
_BINARY = {
    "m": "v * w", "add": "v + w", "sub": "v - w", "pow": None, "exp": None, "max": "greatest(v, w)", "abs": "abs(v)",
    "addtozero": "CASE WHEN v = 0 THEN v + w ELSE v END", "overadd": "CASE WHEN w <> 0 THEN w ELSE v END", "div": "CASE WHEN w > 0 THEN v / w END", "decision": "1 / (1 + exp(-(v - 0.25) / w))",
}


def _binary(op: str, sql: str) -> None:
    @add(f"pixel_{op}", "x y", "out", f"{P} :: SELECT x, y, {sql} AS out FROM img")
    def _(spark, sf):
        return pixel.binary(fx.part_image(spark, sf), op)


for _op, _sql in _BINARY.items():
    if _sql:
        _binary(_op, _sql)


@add("pixel_pow", "x y", "out", f"{P} :: SELECT x, y, pow(v / 1000, 0.5) AS out FROM img")
def _(spark, sf):
    return pixel.binary(fx.part_image(spark, sf).withColumn("v", F.col("v") / 1000), "pow", "v", 0.5)


@add("pixel_exp", "x y", "out", f"{P} :: SELECT x, y, exp(w / 50 * 0.5) AS out FROM img")
def _(spark, sf):
    return pixel.binary(fx.part_image(spark, sf).withColumn("v", F.col("w") / 50), "exp", "v", 0.5)


@add("pixel_scalar_multiply", "x y", "out", f"{P} :: SELECT x, y, v * 0.25 AS out FROM img")
def _(spark, sf):
    return pixel.binary(fx.part_image(spark, sf), "m", "v", 0.25)


CARRY = "CASE WHEN w > 25 THEN w - 25 ELSE 0 END"


@add("pixel_divide_carried", "x y", "out", f"{P}, q AS (SELECT x, y, CASE WHEN {CARRY} > 0 THEN v / ({CARRY}) END AS q FROM img) :: SELECT x, y, coalesce(last_value(q IGNORE NULLS) OVER (ORDER BY y, x ROWS UNBOUNDED PRECEDING), 0) AS out FROM q")
def _(spark, sf):
    return pixel.divide_carried(fx.part_image(spark, sf).withColumn("w", F.greatest(F.col("w") - 25, F.lit(0.0))))


@add("pixel_total", "", "total volume mean", f"{P} :: SELECT sum(v * w) AS total, sum(v * w) * 2 AS volume, sum(v * w) / count(*) AS mean FROM img", 2)
def _(spark, sf):
    return pixel.total(fx.part_image(spark, sf), G)


@add("pixel_neg", "x y", "out", f"{P} :: SELECT x, y, (1 - (v - lo) / (hi - lo)) * (hi - lo) AS out FROM img, (SELECT min(v) AS lo, max(v) AS hi FROM img)")
def _(spark, sf):
    return pixel.negate(fx.part_image(spark, sf))


@add("pixel_rescale", "x y", "out", f"{P} :: SELECT x, y, 10 + 90 * (v - lo) / (hi - lo) AS out FROM img, (SELECT min(v) AS lo, max(v) AS hi FROM img)")
def _(spark, sf):
    return pixel.rescale(fx.part_image(spark, sf), 10.0, 100.0)


@add("pixel_byte", "x y out", "", f"{P} :: SELECT x, y, CAST(floor(0.0 + 255.0 * ((w - lo) / (hi - lo))) AS BIGINT) AS out FROM img, (SELECT min(w) AS lo, max(w) AS hi FROM img)")
def _(spark, sf):
    return pixel.byte(fx.part_image(spark, sf), "w")


@add("pixel_normalize", "x y", "out", f"{P} :: SELECT x, y, (v - lo) / (hi - lo) AS out FROM img, (SELECT min(v) AS lo, greatest(max(v), 0) AS hi FROM img)")
def _(spark, sf):
    return pixel.normalize(fx.part_image(spark, sf))


@add("pixel_normalize_by_mean", "x y", "out", f"{P} :: SELECT x, y, v / m AS out FROM img, (SELECT avg(v) AS m FROM img WHERE w <> 1)")
def _(spark, sf):
    return pixel.normalize(fx.part_image(spark, sf).withColumn("mask", F.col("w") - 1), mask="mask")


@add("pixel_threshold_at_mean", "x y out", "", f"{P} :: SELECT x, y, CAST(v >= m * 1.1 AND v <= hi AS BIGINT) AS out FROM img, (SELECT avg(v) AS m, max(v) AS hi FROM img)")
def _(spark, sf):
    return pixel.threshold_at_mean(fx.part_image(spark, sf), 1.1)


@add("pixel_flatten", "x y", "out", f"{P} :: SELECT x, y, least(v, hi * 0.7) AS out FROM img, (SELECT max(v) AS hi FROM img)")
def _(spark, sf):
    return pixel.flatten_image(fx.part_image(spark, sf), 0.7)


@add("pixel_window", "x y", "out", f"{P} :: SELECT x, y, (greatest(1000, least(1500, v)) - 1000) / 500 * 255 AS out FROM img")
def _(spark, sf):
    return pixel.window(fx.part_image(spark, sf), 1000.0, 1500.0, 0.0, 255.0)


@add("pixel_sigmoid", "x y", "out", f"{P} :: SELECT x, y, 1 / (1 + exp(-(w - 25) / 5)) AS out FROM img")
def _(spark, sf):
    return pixel.sigmoid(fx.part_image(spark, sf), 5.0, 25.0, "w")


@add("pixel_finite", "x y", "out", f"{P} :: SELECT x, y, CASE WHEN w = 7 THEN -1 ELSE v END AS out FROM img")
def _(spark, sf):
    return pixel.finite(fx.part_image(spark, sf).withColumn("v", F.when(F.col("w") == 7, F.lit(float("nan"))).otherwise(F.col("v"))), -1.0)


@add("pixel_replace_value", "x y", "out", f"{P} :: SELECT x, y, CASE WHEN w BETWEEN 10 AND 20 THEN -5 ELSE w END AS out FROM img")
def _(spark, sf):
    return pixel.replace_value(fx.part_image(spark, sf), 10.0, 20.0, -5.0, "w")


@add("pixel_threshold", "x y out", "", f"{P} :: SELECT x, y, CAST(CASE WHEN w BETWEEN 10 AND 20 THEN 1 ELSE 0 END AS BIGINT) AS out FROM img")
def _(spark, sf):
    return pixel.threshold(fx.part_image(spark, sf), 10.0, 20.0, v="w")


@add("pixel_where", "n", "", f"{P} :: SELECT count(*) AS n FROM img WHERE abs(w - 20) < 1e-6 AND lb > 20")
def _(spark, sf):
    return pixel.where(fx.part_image(spark, sf).withColumn("mask", (F.col("lb") > 20).cast("int")), 20.0, "w", "mask")


_HIST = f"{P}, u AS (SELECT v FROM img WHERE v > 0), s AS (SELECT min(v) AS a, max(v) AS b, count(*) AS n FROM u), h AS (SELECT CAST(least(floor((v - a) / (b - a) * 64), 63) AS INT) AS k, a, b, n, count(*) AS c FROM u, s GROUP BY ALL), r AS (SELECT *, sum(c) OVER (ORDER BY k) AS cum FROM h)"
_Q = "(SELECT a + (k + ({p} * n - (cum - c)) / c) * (b - a) / 64 FROM r WHERE cum >= {p} * n ORDER BY k LIMIT 1)"


@add("pixel_truncate_intensity", "x y", "out", f"{_HIST} :: SELECT x, y, greatest({_Q.format(p=0.025)}, least({_Q.format(p=0.975)}, v)) AS out FROM img")
def _(spark, sf):
    return pixel.truncate_intensity(fx.part_image(spark, sf))


@add("pixel_coordinates", "x y", "px py", f"{P} :: SELECT x, y, {PX} AS px, {PY} AS py FROM img")
def _(spark, sf):
    return pixel.coordinate_components(fx.part_image(spark, sf), G)


@add("pixel_mtr", "x y", "out", f"{P} :: SELECT x, y, CASE WHEN lb > 20 THEN greatest(0, least(1, (v - w * 30) / v)) ELSE 0 END AS out FROM img")
def _(spark, sf):
    return pixel.mtr(fx.part_image(spark, sf).withColumns({"m1": F.col("w") * 30, "mask": (F.col("lb") > 20).cast("int")}), "v", "m1", "mask")


@add("pixel_set_pixel", "x y", "out", f"{P} :: SELECT x, y, CASE WHEN x = 3 AND y = 1 THEN -9 ELSE v END AS out FROM img")
def _(spark, sf):
    return pixel.set_pixel(fx.part_image(spark, sf), {"x": 3, "y": 1}, -9.0)


@add("pixel_image_compare", "n", "difference", f"{P} :: SELECT count(*) FILTER (abs(v - w * 40) > 200) AS n, sum(abs(v - w * 40)) FILTER (abs(v - w * 40) > 200) AS difference FROM img", 2)
def _(spark, sf):
    a = fx.part_image(spark, sf)
    return pixel.image_compare(a.select("x", "y", "v"), a.select("x", "y", (F.col("w") * 40).alias("v")), 200.0)


@add("vector_product_sum_difference", "x y", "p s d", f"{P} :: SELECT x, y, v * w AS p, v + w AS s, v - w AS d FROM img")
def _(spark, sf):
    a = fx.part_image(spark, sf).withColumns({"a": F.array("v", "w"), "b": F.array("w", "v")})
    return a.select("x", "y", pixel.vector("vm")[0].alias("p"), pixel.vector("vadd")[0].alias("s"), pixel.vector("vsub")[1].alias("_d"), F.lit(0.0)).select("x", "y", "p", "s", (-F.col("_d")).alias("d"))


@add("vector_total", "", "total", f"{P} :: SELECT 2 * sum(2 * v * w) AS total FROM img", 2)
def _(spark, sf):
    return pixel.vector_total(fx.part_image(spark, sf).withColumns({"a": F.array("v", "w"), "b": F.array("w", "v")}), G)


# Labels.
@add("label_stats", "label count", "x y mass volume", f"{P} :: SELECT la AS label, count(*) AS count, avg({PX}) AS x, avg({PY}) AS y, sum(v) AS mass, count(*) * 2.0 AS volume FROM img WHERE la <> 0 GROUP BY la")
def _(spark, sf):
    return label.label_stats(fx.part_image(spark, sf), G, "la")


@add("label_stats_lineitem", "label count", "mass", f"{fx.LINE_SQL} :: SELECT label, count(*) AS count, sum(v) AS mass FROM cells WHERE label <> 0 GROUP BY label")
def _(spark, sf):
    return label.label_stats(fx.line_labels(spark, sf), Geometry(size=()), "label")


@add("roi_statistics", "roi_number roi_name cluster_size", "mass mean com_x com_y", f"{P} :: SELECT lb AS roi_number, 'region ' || lb AS roi_name, count(*) FILTER (w > 10) AS cluster_size, sum(w) FILTER (w > 10) AS mass, avg(w) FILTER (w > 10) AS mean, avg({PX}) AS com_x, avg({PY}) AS com_y FROM img WHERE lb > 0 GROUP BY lb HAVING count(*) FILTER (w > 10) > 0")
def _(spark, sf):
    a = fx.part_image(spark, sf).withColumn("w", F.when(F.col("w") > 10, F.col("w")).otherwise(0.0))
    names = a.select(F.col("lb").alias("roi_number")).distinct().withColumn("roi_name", F.concat(F.lit("region "), F.col("roi_number").cast("string")))
    return label.roi_statistics(a, G, names, "lb", "w")


_OV = f"{P}, pair AS (SELECT la % 5 AS a, lb % 5 AS b FROM img), l AS (SELECT DISTINCT a AS label FROM pair WHERE a <> 0 UNION SELECT DISTINCT b FROM pair WHERE b <> 0), n AS (SELECT label, (SELECT count(*) FROM pair WHERE a = label) AS s, (SELECT count(*) FROM pair WHERE b = label) AS t, (SELECT count(*) FROM pair WHERE a = label AND b = label) AS i FROM l), z AS (SELECT * FROM n UNION ALL SELECT -1, sum(s), sum(t), sum(i) FROM n)"


@add("label_overlap", "label", "total_or_target jaccard dice volume_similarity false_negative false_positive", f"{_OV} :: SELECT CAST(label AS BIGINT) AS label, i / t AS total_or_target, i / (s + t - i) AS jaccard, 2 * i / (s + t) AS dice, 2 * (s - t) / (s + t) AS volume_similarity, (t - i) / t AS false_negative, (s - i) / s AS false_positive FROM z")
def _(spark, sf):
    return label.label_overlap(fx.part_image(spark, sf).select((F.col("la") % 5).alias("la"), (F.col("lb") % 5).alias("lb")))


@add("label_dice", "label", "dice ro percent_1 percent_2", f"{_OV} :: SELECT CAST(label AS BIGINT) AS label, 2 * i / (s + t) AS dice, i / (s + t - i) AS ro, i / s AS percent_1, i / t AS percent_2 FROM n WHERE s > 0 AND t > 0")
def _(spark, sf):
    return label.dice_table(fx.part_image(spark, sf).select((F.col("la") % 5).alias("la"), (F.col("lb") % 5).alias("lb")))


_IS = f"{fx.LINE_SQL}, b AS (SELECT label, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS s, sum(v) AS sum, min(v) AS lo, max(v) AS hi FROM cells GROUP BY label), m AS (SELECT label, sum(pow(v - mean, 3)) AS m3, sum(pow(v - mean, 4)) AS m4 FROM cells JOIN b USING (label) GROUP BY label), h AS (SELECT label, n, lo, hi, CAST(least(floor((v - lo) / (hi - lo) * 200), 199) AS INT) AS k, count(*) AS c FROM cells JOIN b USING (label) GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY label ORDER BY k) AS cum FROM h), q AS (SELECT label, -sum(c / n * log2(c / n)) AS entropy, min(lo + (k + 1) * (hi - lo) / 200) FILTER (cum / n >= 0.05) AS p05, min(lo + (k + 1) * (hi - lo) / 200) FILTER (cum / n >= 0.95) AS p95 FROM r GROUP BY label)"


@add("label_intensity_statistics", "label count", "mean sigma skewness kurtosis entropy sum p05 p95 min max", f"{_IS} :: SELECT label, n AS count, mean, s AS sigma, n / ((n - 1.0) * (n - 2)) * m3 / pow(s, 3) AS skewness, n * (n + 1.0) / ((n - 1.0) * (n - 2) * (n - 3)) * m4 / pow(s, 4) - 3 * (n - 1.0) * (n - 1) / ((n - 2.0) * (n - 3)) AS kurtosis, entropy, sum, p05, p95, lo AS min, hi AS max FROM b JOIN m USING (label) JOIN q USING (label)")
def _(spark, sf):
    return label.intensity_statistics(fx.line_labels(spark, sf))


_GM = f"{P}, p AS (SELECT lb, count(*) AS voxels, avg({PX}) AS cx, avg({PY}) AS cy, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, var_pop({PX}) AS a, var_pop({PY}) AS b, covar_pop({PX}, {PY}) AS c FROM img WHERE lb <> 0 GROUP BY lb), e AS (SELECT *, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c) AS big, greatest((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c), 0) AS small FROM p)"


@add("label_geometry", "label voxels min_x max_x min_y max_y", "volume centroid_x centroid_y major minor eccentricity", f"{_GM} :: SELECT lb AS label, voxels, min_x, max_x, min_y, max_y, voxels * 2.0 AS volume, cx AS centroid_x, cy AS centroid_y, 4 * sqrt(big) AS major, 4 * sqrt(small) AS minor, sqrt(1 - small / big) AS eccentricity FROM e")
def _(spark, sf):
    return label.geometry_measures(fx.part_image(spark, sf), G, "lb")


@add("count_voxel_difference", "", "total mean negative_percent", f"{P} :: SELECT sum(abs(v - w * 40)) AS total, avg(abs(v - w * 40)) AS mean, 100.0 * count(*) FILTER (v < w * 40) / count(*) AS negative_percent FROM img WHERE lb > 20", 2)
def _(spark, sf):
    return label.count_difference(fx.part_image(spark, sf).withColumns({"b": F.col("w") * 40, "mask": (F.col("lb") > 20).cast("int")}), "v", "b")


@add("min_max_mean", "", "min max mean variance sd com_x com_y", f"{P} :: SELECT min(v) AS min, max(v) AS max, avg(v) AS mean, var_pop(v) AS variance, stddev_samp(v) AS sd, sum({PX} * v) / sum(v) AS com_x, sum({PY} * v) / sum(v) AS com_y FROM img")
def _(spark, sf):
    return label.min_max_mean(fx.part_image(spark, sf), G)


@add("extract_region_by_label", "x y", "v", f"{P}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM img WHERE la = 3) :: SELECT x, y, v FROM img, b WHERE x BETWEEN x0 - 1 AND x1 + 1 AND y BETWEEN y0 - 1 AND y1 + 1")
def _(spark, sf):
    return label.label_region(fx.part_image(spark, sf), 3, "la", 1)


@add("pearson_correlation", "", "r", f"{P} :: SELECT corr(v, w) AS r FROM img WHERE lb > 20")
def _(spark, sf):
    return label.pearson(fx.part_image(spark, sf).withColumn("mask", (F.col("lb") > 20).cast("int")), mask="mask")


_SMI_CELLS = f"{P}, s AS (SELECT min(v) a0, max(v) a1, min(w) b0, max(w) b1 FROM img), q AS (SELECT x, y, CAST(least(floor((v - a0) / (a1 - a0) * 32), 31) AS INT) AS a, CAST(least(floor((w - b0) / (b1 - b0) * 32), 31) AS INT) AS b FROM img, s), k AS (SELECT a AS a0, b AS b0, lag(a) OVER wy AS au, lag(b) OVER wy AS bu, lag(a) OVER wx AS al, lag(b) OVER wx AS bl, lead(a) OVER wx AS ar, lead(b) OVER wx AS br FROM q WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y))"
_SMI_PAIRS = {"au b0": 0.5, "a0 bu": 0.5, "al b0": 0.5, "a0 bl": 0.5, "a0 b0": -1.0, "au br": -0.25, "ar bu": -0.25, "al bu": -0.25, "au bl": -0.25}
_SMI = " + ".join("{w} * (SELECT -sum(c / n * ln(c / n)) FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS n FROM k WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}))".format(w=w, a=p.split()[0], b=p.split()[1]) for p, w in _SMI_PAIRS.items())


@add("spatial_mutual_information", "", "smi", f"{_SMI_CELLS} :: SELECT {_SMI} AS smi")
def _(spark, sf):
    return label.spatial_mutual_information(fx.part_image(spark, sf))


@add("mutual_information", "", "mi", f"{P}, s AS (SELECT min(v) a0, max(v) a1, min(w) b0, max(w) b1, count(*) AS n FROM img), j AS (SELECT CAST(least(floor((v - a0) / (a1 - a0) * 32), 31) AS INT) AS i, CAST(least(floor((w - b0) / (b1 - b0) * 32), 31) AS INT) AS k, n, count(*) AS c FROM img, s GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY i) AS pi, sum(c) OVER (PARTITION BY k) AS pk FROM j) :: SELECT sum(c / n * ln(c * n / (pi * pk))) AS mi FROM m")
def _(spark, sf):
    return label.mutual_information(fx.part_image(spark, sf))


@add("image_similarity", "", "msq gc ncc ssd", f"{P} :: SELECT avg(pow(v - w, 2)) AS msq, corr(v, w) AS gc, pow(corr(v, w), 2) AS ncc, sum(pow(v - w, 2)) AS ssd FROM img", 1)
def _(spark, sf):
    return label.similarity(fx.part_image(spark, sf))


_OT = f"{P}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM img), h AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * 200), 199) AS INT) AS k, count(*) AS n, sum(v) AS t FROM img, s GROUP BY 1), c AS (SELECT j, coalesce(sum(n) FILTER (k < j), 0) AS n, coalesce(sum(t) FILTER (k < j), 0) AS t FROM range(201) b(j), h GROUP BY j), g AS (SELECT a.j AS i, b.j AS j, a.t * a.t / a.n + pow(b.t - a.t, 2) / (b.n - a.n) + pow(z.t - b.t, 2) / (z.n - b.n) AS gain FROM c a, c b, c z WHERE z.j = 200 AND a.j < b.j AND b.j < 200 AND a.n > 0 AND b.n > a.n AND z.n > b.n), m AS (SELECT i, j FROM g WHERE gain >= (SELECT max(gain) FROM g) * (1 - 1e-11) ORDER BY j, i LIMIT 1)"


@add("otsu_threshold", "x y out", "", f"{_OT} :: SELECT x, y, 1 + CAST(v >= lo + i * (hi - lo) / 200 AS BIGINT) + CAST(v >= lo + j * (hi - lo) / 200 AS BIGINT) AS out FROM img, s, m")
def _(spark, sf):
    return label.otsu(fx.part_image(spark, sf), 2)


_KM = f"RECURSIVE {P}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM img), r(a, b, c, k) AS (SELECT lo + (hi - lo) / 4, lo + (hi - lo) * 2 / 4, lo + (hi - lo) * 3 / 4, 0 FROM s UNION ALL SELECT coalesce(avg(v) FILTER (v <= (a + b) / 2), any_value(a)), coalesce(avg(v) FILTER (v > (a + b) / 2 AND v <= (b + c) / 2), any_value(b)), coalesce(avg(v) FILTER (v > (b + c) / 2), any_value(c)), any_value(k) + 1 FROM img, r WHERE k < 200 GROUP BY k), m AS (SELECT a, b, c FROM r WHERE k = 200)"


@add("kmeans_threshold", "x y out", "", f"{_KM} :: SELECT x, y, CAST(1 + CAST(v > (a + b) / 2 AS INT) + CAST(v > (b + c) / 2 AS INT) AS BIGINT) AS out FROM img, m")
def _(spark, sf):
    return label.kmeans(fx.part_image(spark, sf), 3)[0]


# Neighbourhoods.
_NB = f"{P}, o AS (SELECT a.x, a.y, a.v, a.w, a.la, b.v AS bv, b.w AS bw, b.la AS bl, b.x - a.x AS dx, b.y - a.y AS dy FROM img a JOIN img b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1)"


def _gray(name: str, f, sql: str) -> None:
    @add(name, "x y", "v", f"{_NB} :: {sql}")
    def _(spark, sf):
        return f(fx.part_image(spark, sf))


_gray("gray_dilate", neighborhood.gray_dilate, "SELECT x, y, max(bv) AS v FROM o GROUP BY x, y")
_gray("gray_erode", neighborhood.gray_erode, "SELECT x, y, min(bv) AS v FROM o GROUP BY x, y")
_TWICE = "SELECT a.x, a.y, {f}(b.v) AS v FROM ({inner}) a JOIN ({inner}) b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.x, a.y"
_gray("gray_open", neighborhood.gray_open, _TWICE.format(f="max", inner="SELECT x, y, min(bv) AS v FROM o GROUP BY x, y"))
_gray("gray_close", neighborhood.gray_close, _TWICE.format(f="min", inner="SELECT x, y, max(bv) AS v FROM o GROUP BY x, y"))


def _binary_morphology(op: str, sql: str, shape: str = "box") -> None:
    @add(f"binary_{op}_{shape}", "x y v", "", f"{_NB} :: {sql}")
    def _(spark, sf):
        a = fx.part_image(spark, sf).withColumn("v", (F.col("w") > 40).cast("double"))
        return neighborhood.binary_morphology(a, op, 1, shape)


_BIT = "CAST(bw > 40 AS BIGINT)"
_binary_morphology("dilate", f"SELECT x, y, max({_BIT}) AS v FROM o GROUP BY x, y")
_binary_morphology("erode", f"SELECT x, y, min({_BIT}) AS v FROM o GROUP BY x, y")
_binary_morphology("dilate", f"SELECT x, y, max({_BIT}) AS v FROM o WHERE dx = 0 OR dy = 0 GROUP BY x, y", "cross")
_binary_morphology("erode", f"SELECT x, y, min({_BIT}) AS v FROM o WHERE abs(dx) + abs(dy) <= 1 GROUP BY x, y", "ball")
_binary_morphology("open", _TWICE.format(f="max", inner=f"SELECT x, y, min({_BIT}) AS v FROM o GROUP BY x, y"))
_binary_morphology("close", _TWICE.format(f="min", inner=f"SELECT x, y, max({_BIT}) AS v FROM o GROUP BY x, y"))


@add("neighborhood_stats", "x y n", "mean min max variance sigma", f"{_NB} :: SELECT x, y, count(*) AS n, avg(bv) AS mean, min(bv) AS min, max(bv) AS max, var_samp(bv) AS variance, stddev_samp(bv) AS sigma FROM o GROUP BY x, y")
def _(spark, sf):
    return neighborhood.neighborhood_stats(fx.part_image(spark, sf), 1)


@add("neighborhood_entropy", "x y", "entropy", f"{_NB}, c AS (SELECT x, y, bl, count(*) AS c FROM o GROUP BY ALL), n AS (SELECT *, sum(c) OVER (PARTITION BY x, y) AS n FROM c) :: SELECT x, y, -sum(c / n * ln(c / n)) AS entropy FROM n GROUP BY x, y")
def _(spark, sf):
    return neighborhood.neighborhood_entropy(fx.part_image(spark, sf), 1, "la")


@add("median_filter", "x y", "v", f"{_NB} :: SELECT x, y, median(bv) AS v FROM o GROUP BY x, y")
def _(spark, sf):
    return neighborhood.median_filter(fx.part_image(spark, sf), 1)


@add("convolve", "x y", "v", f"{_NB} :: SELECT x, y, sum(bv * (2 - abs(dx)) * (2 - abs(dy))) / 16 AS v FROM o GROUP BY x, y", 7)
def _(spark, sf):
    return neighborhood.convolve(fx.part_image(spark, sf), {(i, j): float((2 - abs(i)) * (2 - abs(j))) for i in (-1, 0, 1) for j in (-1, 0, 1)})


_GK = "unnest([-4, -3, -2, -1, 0, 1, 2, 3, 4]) AS d"
_GAUSS = f"{P}, k AS (SELECT d, exp(-d * d / 2.0) AS g FROM (SELECT {_GK})), gx AS (SELECT a.x, a.y, sum(b.v * g) / sum(g) AS v FROM img a, k JOIN img b ON b.x = a.x + d AND b.y = a.y GROUP BY a.x, a.y), gy AS (SELECT a.x, a.y, sum(b.v * g) / sum(g) AS v FROM gx a, k JOIN gx b ON b.y = a.y + d AND b.x = a.x GROUP BY a.x, a.y)"


@add("gaussian_smooth", "x y", "v", f"{_GAUSS} :: SELECT x, y, v FROM gy")
def _(spark, sf):
    return neighborhood.gaussian(fx.part_image(spark, sf), 1.0)


_DIFF = "w1 AS (SELECT *, lag(v) OVER wx AS xl, lead(v) OVER wx AS xr, lag(v) OVER wy AS yl, lead(v) OVER wy AS yr FROM img WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y))"
_G1 = "coalesce((coalesce({a}r, v) - coalesce({a}l, v)) / nullif((CASE WHEN {a}l IS NULL THEN 0 ELSE 1 END + CASE WHEN {a}r IS NULL THEN 0 ELSE 1 END), 0), 0)"


@add("gradient_magnitude", "x y", "v", f"{P}, {_DIFF} :: SELECT x, y, sqrt(pow({_G1.format(a='x')}, 2) + pow({_G1.format(a='y')}, 2)) AS v FROM w1")
def _(spark, sf):
    return neighborhood.gradient_magnitude(fx.part_image(spark, sf), None)


@add("laplacian", "x y", "v", f"{P}, {_DIFF} :: SELECT x, y, coalesce(xl, v) + coalesce(xr, v) + coalesce(yl, v) + coalesce(yr, v) - 4 * v AS v FROM w1")
def _(spark, sf):
    return neighborhood.laplacian(fx.part_image(spark, sf), None)


@add("sharpen", "x y", "v", f"{P}, {_DIFF}, s AS (SELECT x, y, v, 5 * v - coalesce(xl, v) - coalesce(xr, v) - coalesce(yl, v) - coalesce(yr, v) AS s FROM w1), t AS (SELECT avg(v) AS m, avg(s) AS n, min(v) AS lo, max(v) AS hi FROM s) :: SELECT x, y, greatest(lo, least(hi, s + m - n)) AS v FROM s, t")
def _(spark, sf):
    return neighborhood.sharpen(fx.part_image(spark, sf))


@add("unsharp_mask", "x y", "v", f"{_GAUSS} :: SELECT img.x, img.y, CASE WHEN abs(img.v - gy.v) > 50 THEN img.v + 0.5 * (img.v - gy.v) ELSE img.v END AS v FROM img JOIN gy ON img.x = gy.x AND img.y = gy.y")
def _(spark, sf):
    return neighborhood.unsharp_mask(fx.part_image(spark, sf), 0.5, 1.0, 50.0)


@add("local_correlation", "x y", "v", f"{_NB} :: SELECT x, y, CASE WHEN var_pop(bv) > 1e-12 AND var_pop(bw) > 1e-12 THEN pow(covar_pop(bv, bw), 2) / (var_pop(bv) * var_pop(bw)) ELSE 0 END AS v FROM o GROUP BY x, y")
def _(spark, sf):
    return neighborhood.local_correlation(fx.part_image(spark, sf), 1)


_N5 = f"{P}, o AS (SELECT a.x, a.y, b.v AS bv, b.w AS bw FROM img a JOIN img b ON b.x BETWEEN a.x - 5 AND a.x + 5 AND b.y BETWEEN a.y - 5 AND a.y + 5)"


@add("local_correlation_radius_5", "x y", "v", f"{_N5} :: SELECT x, y, CASE WHEN var_pop(bv) > 1e-12 AND var_pop(bw) > 1e-12 THEN pow(covar_pop(bv, bw), 2) / (var_pop(bv) * var_pop(bw)) ELSE 0 END AS v FROM o GROUP BY x, y")
def _(spark, sf):
    return neighborhood.local_correlation(fx.part_image(spark, sf), 5)


@add("correlation_update", "x y", "v", f"{_NB} :: SELECT x, y, CASE WHEN count(*) = 9 THEN any_value(v - w) - avg(bv - bw) ELSE 0 END AS v FROM o GROUP BY x, y")
def _(spark, sf):
    return neighborhood.correlation_update(fx.part_image(spark, sf), 1)


@add("label_contour", "x y label", "", f"{_NB} :: SELECT x, y, CASE WHEN min(bl % 3) <> max(bl % 3) THEN any_value(la % 3) ELSE 0 END AS label FROM o GROUP BY x, y")
def _(spark, sf):
    return neighborhood.label_contour(fx.part_image(spark, sf).withColumn("la", F.col("la") % 3), "la")


@add("label_interfaces", "a b n", "", f"{_NB} :: SELECT la % 4 AS a, bl % 4 AS b, count(*) AS n FROM o WHERE abs(dx) + abs(dy) = 1 AND la % 4 < bl % 4 AND la % 4 <> 0 GROUP BY ALL")
def _(spark, sf):
    return neighborhood.label_interfaces(fx.part_image(spark, sf).withColumn("la", F.col("la") % 4), "la")


@add("remove_label_interfaces", "x y label", "", f"{_NB} :: SELECT x, y, CASE WHEN any_value(la % 3) <> 0 AND count(DISTINCT nullif(bl % 3, 0)) > 1 THEN 0 ELSE any_value(la % 3) END AS label FROM o GROUP BY x, y")
def _(spark, sf):
    return neighborhood.remove_interfaces(fx.part_image(spark, sf).withColumn("la", F.col("la") % 3), "la")


@add("label_surface_area", "label", "area", f"{_NB}, f AS (SELECT x, y, any_value(la % 4) AS l, count(*) FILTER (abs(dx) = 1 AND dy = 0 AND bl % 4 = la % 4) AS sx, count(*) FILTER (abs(dy) = 1 AND dx = 0 AND bl % 4 = la % 4) AS sy FROM o GROUP BY x, y) :: SELECT l AS label, sum((2 - sx) * 2.0 + (2 - sy) * 1.0) AS area FROM f WHERE l <> 0 GROUP BY l")
def _(spark, sf):
    return neighborhood.surface_area(fx.part_image(spark, sf).withColumn("la", F.col("la") % 4), G, "la")


@add("label_thickness", "label voxels edge", "thickness", f"{_NB}, f AS (SELECT x, y, any_value(la % 3) AS l, min(bl % 3) <> max(bl % 3) AS e FROM o WHERE dx = 0 OR dy = 0 GROUP BY x, y) :: SELECT l AS label, count(*) AS voxels, count(*) FILTER (e) AS edge, 2.0 * count(*) / count(*) FILTER (e) * pow(2, 0.3333) AS thickness FROM f WHERE l <> 0 GROUP BY l")
def _(spark, sf):
    return neighborhood.label_thickness(fx.part_image(spark, sf).withColumn("la", F.col("la") % 3), G, "la")


_CO = f"{P}, s AS (SELECT min(v) lo, max(v) hi FROM img), q AS (SELECT x, y, CAST(least(floor((v - lo) / (hi - lo) * 16), 15) AS INT) AS g FROM img, s), c1 AS (SELECT a.g AS i, b.g AS j FROM q a JOIN q b ON b.x = a.x + 1 AND b.y = a.y), c2 AS (SELECT i, j FROM c1 UNION ALL SELECT j, i FROM c1), p AS (SELECT i, j, count(*) / (SELECT count(*) FROM c2) AS p FROM c2 GROUP BY i, j), mu AS (SELECT sum(i * p) AS m FROM p)"


@add("texture_cooccurrence", "", "energy entropy correlation idm inertia cluster_shade cluster_prominence", f"{_CO} :: SELECT sum(p * p) AS energy, -sum(p * log2(p)) AS entropy, sum((i - m) * (j - m) * p) / sum((i - m) * (i - m) * p) AS correlation, sum(p / (1 + (i - j) * (i - j))) AS idm, sum((i - j) * (i - j) * p) AS inertia, sum(pow(i + j - 2 * m, 3) * p) AS cluster_shade, sum(pow(i + j - 2 * m, 4) * p) AS cluster_prominence FROM p, mu")
def _(spark, sf):
    return neighborhood.cooccurrence(fx.part_image(spark, sf), (1, 0))


_RL = f"{P}, s AS (SELECT min(v) lo, max(v) hi FROM img), q AS (SELECT x, y, CAST(least(floor((v - lo) / (hi - lo) * 3), 2) AS INT) AS g FROM img, s), n AS (SELECT *, x - row_number() OVER (PARTITION BY y, g ORDER BY x) AS run FROM q), r AS (SELECT g, count(*) AS l FROM n GROUP BY y, g, run), t AS (SELECT g, l, count(*) AS c FROM r GROUP BY g, l)"


@add("texture_run_length", "runs", "short_run_emphasis long_run_emphasis grey_level_nonuniformity run_length_nonuniformity", f"{_RL} :: SELECT CAST(sum(c) AS BIGINT) AS runs, sum(c / (l * l)) / sum(c) AS short_run_emphasis, sum(c * l * l) / sum(c) AS long_run_emphasis, (SELECT sum(s * s) / sum(s) FROM (SELECT sum(c) AS s FROM t GROUP BY g)) AS grey_level_nonuniformity, (SELECT sum(s * s) / sum(s) FROM (SELECT sum(c) AS s FROM t GROUP BY l)) AS run_length_nonuniformity FROM t")
def _(spark, sf):
    return neighborhood.run_lengths(fx.part_image(spark, sf), "x", 3)


@add("check_topology", "cells contacts euler", "", f"{P}, c AS (SELECT x, y FROM img WHERE w >= 25), k AS (SELECT (SELECT count(*) FROM c) AS cells, (SELECT count(*) FROM c a JOIN c b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) AS contacts, (SELECT count(*) FROM c a JOIN c b ON b.x = a.x + 1 AND b.y = a.y JOIN c d ON d.x = a.x AND d.y = a.y + 1 JOIN c e ON e.x = a.x + 1 AND e.y = a.y + 1) AS squares) :: SELECT cells, contacts, cells - contacts + squares AS euler FROM k")
def _(spark, sf):
    return neighborhood.topology(fx.part_image(spark, sf).select("x", "y", F.col("w").alias("v")), "v", 25.0)


# Layout.
@add("make_image", "x y z", "v", ":: SELECT i % 7 AS x, i // 7 % 5 AS y, i // 35 AS z, 3.5 AS v FROM range(105) t(i)".replace(":: ", ""))
def _(spark, sf):
    return layout.make_image(spark, (7, 5, 3), 3.5)


@add("extract_region", "x y", "v", f"{P} :: SELECT x, y, v FROM img WHERE x BETWEEN 10 AND 20 AND y BETWEEN 1 AND 2")
def _(spark, sf):
    return layout.extract_region(fx.part_image(spark, sf), {"x": 10, "y": 1}, {"x": 20, "y": 2})


@add("extract_slice", "x", "v", f"{P} :: SELECT x, v FROM img WHERE y = 2")
def _(spark, sf):
    return layout.extract_slice(fx.part_image(spark, sf), "y", 2)


_H = "h AS (SELECT max(y) + 1 AS h FROM img)"


def _height(df) -> int:
    return df.agg(F.max("y")).first()[0] + 1


@add("pad_image", "x y", "v", f"{P}, {_H}, g AS (SELECT x, unnest(range(h + 4)) AS y FROM range(54) t(x), h) :: SELECT g.x, g.y, coalesce(v, -1) AS v FROM g LEFT JOIN img ON img.x + 2 = g.x AND img.y + 2 = g.y")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", "v")
    return layout.pad(a, {"x": 50, "y": _height(a)}, 2, -1.0)


@add("permute_flip_axes", "x y", "v", f"{P} :: SELECT y AS x, 49 - x AS y, v FROM img")
def _(spark, sf):
    return layout.permute_flip(fx.part_image(spark, sf), ["y", "x"], {"y": 50})


@add("paste_image", "x y", "v", f"{P} :: SELECT a.x, a.y, CASE WHEN b.w IS NOT NULL AND b.w <> 0 THEN b.w ELSE a.v END AS v FROM img a LEFT JOIN img b ON b.x + 5 = a.x AND b.y + 1 = a.y AND b.w > 30")
def _(spark, sf):
    a = fx.part_image(spark, sf)
    return layout.paste(a.select("x", "y", "v"), a.filter("w > 30").select("x", "y", F.col("w").alias("v")), {"x": 5, "y": 1})


@add("translate_image", "x y", "v", f"{P} :: SELECT a.x, a.y, coalesce(b.v, 0) AS v FROM img a LEFT JOIN img b ON b.x + 3 = a.x AND b.y - 1 = a.y")
def _(spark, sf):
    return layout.translate(fx.part_image(spark, sf).select("x", "y", "v"), {"x": 3, "y": -1})


@add("shift_slices", "x y", "v", f"{P} :: SELECT (x + 7) % 50 AS x, y, v FROM img")
def _(spark, sf):
    return layout.cyclic_shift(fx.part_image(spark, sf), "x", 7, 50)


@add("replicate_image", "x y t", "v", f"{P} :: SELECT x, y, t, v FROM img, range(3) r(t)")
def _(spark, sf):
    return layout.replicate(fx.part_image(spark, sf), "t", 3)


@add("stack_images", "x y z", "v", f"{P} :: SELECT x, y, CAST(0 AS BIGINT) AS z, v FROM img UNION ALL SELECT x, y, 1, w FROM img")
def _(spark, sf):
    a = fx.part_image(spark, sf)
    return layout.stack([a.select("x", "y", "v"), a.select("x", "y", F.col("w").alias("v"))], "z", [1, 1])


@add("tile_images", "x y", "v", f"{fx.EMBED_SQL} :: SELECT x + (image % 10) * 8 AS x, y + (image // 10) * 8 AS y, v FROM eset")
def _(spark, sf):
    return layout.tile(fx.embed_set(spark, sf), "image", 10, (8, 8))


@add("slice_mosaic", "x y", "v", f"{fx.EMBED_SQL} :: SELECT x + (image % 4) * 8 AS x, y + (image // 4) * 8 AS y, v FROM eset")
def _(spark, sf):
    return layout.mosaic(fx.embed_set(spark, sf).select("x", "y", F.col("image").alias("z"), "v"), "z", 4, (8, 8))


@add("center_image", "x y", "v", f"{P}, c AS (SELECT CAST(round(sum(x * w) / sum(w)) AS BIGINT) AS cx, CAST(round(sum(y * w) / sum(w)) AS BIGINT) AS cy FROM img) :: SELECT a.x, a.y, coalesce(b.w, 0) AS v FROM img a CROSS JOIN c LEFT JOIN img b ON b.x - cx + 20 = a.x AND b.y - cy + 1 = a.y")
def _(spark, sf):
    a = fx.part_image(spark, sf)
    return layout.center_on(a.select("x", "y", "v"), a.select("x", "y", F.col("w").alias("v")), {"x": 20, "y": 1})


@add("grid_lines", "x y", "v", f"{P} :: SELECT x, y, CASE WHEN x % 10 = 0 OR y % 10 = 0 THEN 1 ELSE 0 END AS v FROM img")
def _(spark, sf):
    return layout.warped_grid(fx.part_image(spark, sf), 10)


_RS = f"{P}, {_H}, g AS (SELECT x, unnest(range(h)) AS y FROM range(99) t(x), h), k AS (SELECT *, x * 49.0 / 98 AS px FROM g), f AS (SELECT *, CAST(floor(px) AS BIGINT) AS lo, px - floor(px) AS f FROM k)"


@add("resample_linear", "x y", "v", f"{_RS} :: SELECT f.x, f.y, a.v * (1 - f.f) + coalesce(b.v, 0) * f.f AS v FROM f JOIN img a ON a.x = lo AND a.y = f.y LEFT JOIN img b ON b.x = lo + 1 AND b.y = f.y")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", "v")
    return layout.resample(a, {"x": 50, "y": _height(a)}, {"x": 99, "y": _height(a)})


@add("resample_nearest", "x y", "v", f"{_RS} :: SELECT f.x, f.y, a.v FROM f JOIN img a ON a.x = CAST(floor(px + 0.5) AS BIGINT) AND a.y = f.y")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", "v")
    return layout.resample(a, {"x": 50, "y": _height(a)}, {"x": 99, "y": _height(a)}, linear=False)


# Iterative.
_CC = f"{P}, c AS (SELECT x, y, y * 50 + x AS id FROM img WHERE w >= 20), e AS (SELECT a.id AS u, b.id AS v FROM c a JOIN c b ON abs(a.x - b.x) + abs(a.y - b.y) = 1), r(u, m) AS (SELECT id, id FROM c UNION SELECT e.v, r.m FROM r JOIN e ON e.u = r.u WHERE r.m < e.v), l AS (SELECT u, min(m) AS m FROM r GROUP BY u), n AS (SELECT m, count(*) AS n FROM l GROUP BY m), k AS (SELECT m, n, row_number() OVER (ORDER BY n DESC, m) AS label FROM n)"
_CC = "RECURSIVE " + _CC


def _blobs(spark, sf):
    return fx.part_image(spark, sf).filter("w >= 20")


@add("label_clusters", "x y label", "", f"{_CC} :: SELECT c.x, c.y, k.label FROM c JOIN l ON c.id = l.u JOIN k ON k.m = l.m")
def _(spark, sf):
    return iterative.label_clusters(_blobs(spark, sf))


@add("largest_component", "x y", "", f"{_CC} :: SELECT c.x, c.y FROM c JOIN l ON c.id = l.u JOIN k ON k.m = l.m WHERE n = (SELECT max(n) FROM n) AND n >= 5")
def _(spark, sf):
    return iterative.largest_component(fx.part_image(spark, sf).withColumn("v", F.col("w") / 80), 0.25, 5)


@add("cluster_statistics", "label size", "mean max w_at_max", f"{_CC} :: SELECT k.label, count(*) AS size, avg(i.w) AS mean, max(i.w) AS max, max(CAST(i.w AS BIGINT) * 1000 - i.lb) AS z, (max(CAST(i.w AS BIGINT)) * 1000 - max(CAST(i.w AS BIGINT) * 1000 - i.lb)) AS w_at_max FROM c JOIN l ON c.id = l.u JOIN k ON k.m = l.m JOIN img i ON i.x = c.x AND i.y = c.y GROUP BY k.label")
def _(spark, sf):
    return iterative.cluster_statistics(fx.part_image(spark, sf).withColumn("lbd", F.col("lb").cast("double")), 20.0, 1, "w", "lbd")


@add("cluster_threshold", "x y", "v", f"{_CC} :: SELECT i.x, i.y, CASE WHEN n > 10 THEN i.v ELSE 0 END AS v FROM img i LEFT JOIN l ON i.y * 50 + i.x = l.u LEFT JOIN n ON n.m = l.m")
def _(spark, sf):
    return iterative.cluster_threshold(fx.part_image(spark, sf).withColumn("mask", (F.col("w") >= 20).cast("int")), "mask", 10)


_FH = _CC.replace("w >= 20", "w < 25")


@add("fill_holes", "x y", "v", f"{_FH}, edge AS (SELECT DISTINCT l.m FROM c JOIN l ON c.id = l.u WHERE x = 0 OR x = 49 OR y = 0 OR y = (SELECT max(y) FROM img)) :: SELECT i.x, i.y, CASE WHEN i.w >= 25 OR (l.m IS NOT NULL AND l.m NOT IN (SELECT m FROM edge)) THEN 1 ELSE 0 END AS v FROM img i LEFT JOIN l ON i.y * 50 + i.x = l.u")
def _(spark, sf):
    a = fx.part_image(spark, sf).withColumn("v", (F.col("w") >= 25).cast("double"))
    return iterative.fill_holes(a, {"x": 50, "y": a.agg(F.max("y")).first()[0] + 1})


@add("distance_map", "x y", "v", f"{P} :: SELECT a.x, a.y, sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS v FROM img a, img b WHERE b.w >= 45 GROUP BY a.x, a.y")
def _(spark, sf):
    return iterative.distance_map(fx.part_image(spark, sf).withColumn("v", (F.col("w") >= 45).cast("int")))


@add("signed_distance", "x y", "v", f"{P}, d AS (SELECT a.x, a.y, min(CASE WHEN b.w >= 30 THEN sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) END) AS o, min(CASE WHEN b.w < 30 THEN sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) END) AS i FROM img a, img b GROUP BY a.x, a.y) :: SELECT x, y, CASE WHEN o > 0 THEN o ELSE -i END AS v FROM d")
def _(spark, sf):
    return iterative.signed_distance(fx.part_image(spark, sf).withColumn("v", (F.col("w") >= 30).cast("double")))


def _near(table: str, out: str, value: str) -> str:
    """SQL of a table made from each cell's four face neighbours in another: l, r, u and d are their values, null outside."""
    return f"{out} AS (SELECT *, {value} AS new FROM (SELECT *, lag(v) OVER wx AS l, lead(v) OVER wx AS r, lag(v) OVER wy AS u, lead(v) OVER wy AS d FROM {table} WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y)))"


_FLUX = " + ".join(f"coalesce({n} - v, 0) * exp(-pow(coalesce({n} - v, 0), 2) / (2 * 0.0625 * greatest(g, 1e-12)))" for n in "lrud")
_PM = ", ".join(
    f"n{k} AS (SELECT *, coalesce(lag(v) OVER wx, v) AS l, coalesce(lead(v) OVER wx, v) AS r, coalesce(lag(v) OVER wy, v) AS u, coalesce(lead(v) OVER wy, v) AS d FROM {'img' if k == 1 else f'p{k - 1}'} WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y)), g{k} AS (SELECT avg((pow(l - v, 2) + pow(r - v, 2) + pow(u - v, 2) + pow(d - v, 2)) / 4) AS g FROM n{k}), p{k} AS (SELECT x, y, v + 0.05 * ({_FLUX}) AS v FROM n{k}, g{k})"
    for k in (1, 2)
)


@add("perona_malik", "x y", "v", f"{P}, {_PM} :: SELECT x, y, v FROM p2")
def _(spark, sf):
    return iterative.perona_malik(fx.part_image(spark, sf), 2)


_IP = "p{n} AS (SELECT a.x, a.y, any_value(a.v0) AS v0, CASE WHEN any_value(a.v0) > 0 THEN any_value(a.v0) ELSE coalesce(sum(b.v / (pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) FILTER (b.v > 0 AND NOT (a.x = b.x AND a.y = b.y)) / sum(1 / (pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) FILTER (b.v > 0 AND NOT (a.x = b.x AND a.y = b.y)), any_value(a.v)) END AS v FROM {m} a JOIN {m} b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.x, a.y)"


@add("inpaint", "x y", "v", f"{P}, p0 AS (SELECT x, y, CASE WHEN w > 30 THEN v ELSE 0 END AS v0, CASE WHEN w > 30 THEN v ELSE 0 END AS v FROM img), {_IP.format(n=1, m='p0')}, {_IP.format(n=2, m='p1')} :: SELECT x, y, v FROM p2", 7)
def _(spark, sf):
    return iterative.inpaint(fx.part_image(spark, sf).withColumn("v", F.when(F.col("w") > 30, F.col("v")).otherwise(0.0)), 2)


_PD = ", ".join(f"{_near(f'd{k - 1}', f'm{k}', '(v + coalesce(l, 0) + coalesce(r, 0) + coalesce(u, 0) + coalesce(d, 0)) / 5')}, d{k} AS (SELECT x, y, s, CASE WHEN s >= 0.2 THEN s ELSE new END AS v FROM m{k})" for k in (1, 2, 3))


@add("poisson_diffusion", "x y", "v", f"{P}, d0 AS (SELECT x, y, CAST(w > 48 AS DOUBLE) AS s, CAST(w > 48 AS DOUBLE) AS v FROM img), {_PD} :: SELECT x, y, v FROM d3", 7)
def _(spark, sf):
    return iterative.poisson_diffusion(fx.part_image(spark, sf).withColumns({"s": (F.col("w") > 48).cast("double"), "l": F.lit(1)}), "s", "l", rounds=3)


#: Steps to the fixpoint: a cell's row is replaced while a round finds fewer steps, or as many and a lesser label.
_PL = f"RECURSIVE {P}, c AS (SELECT x, y, y * 50 + x AS id, w, lb FROM img WHERE w >= 15), e AS (SELECT a.id AS u, b.id AS v FROM c a JOIN c b ON (b.y = a.y AND abs(b.x - a.x) = 1) OR (b.x = a.x AND abs(b.y - a.y) = 1)), r(id, s, label) USING KEY (id) AS (SELECT id, 0, lb FROM c WHERE w >= 48 UNION SELECT e.v, min(r.s + 1), arg_min(r.label, (r.s + 1) * 1000 + r.label) FROM r JOIN e ON e.u = r.id LEFT JOIN recurring.r q ON q.id = e.v WHERE q.id IS NULL OR q.s * 1000 + q.label > (r.s + 1) * 1000 + r.label GROUP BY e.v)"


@add("propagate_labels", "x y label steps", "", f"{_PL} :: SELECT c.x, c.y, r.label, CAST(r.s AS INT) AS steps FROM r JOIN c USING (id)")
def _(spark, sf):
    a = fx.part_image(spark, sf).filter("w >= 15")
    return iterative.propagate_labels(a, a.filter("w >= 48").select("x", "y", F.col("lb").alias("label")))
