"""Queries over image sets and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import imageset, neighborhood, timeseries
from gridloom.plans.registry import Registry
from gridloom.sources import fixtures as fx

#: Means of money values with two decimals tie at few digits.
REGISTRY = Registry(digits=7)
add = REGISTRY.add
E = fx.EMBED_SQL
S = fx.EVENT_SQL
#: A label of each cell and image: 0, 1 or 2 by value.
LABEL = "CASE WHEN v > 0.1 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END"


def _labelled(spark, sf):
    return fx.embed_set(spark, sf).withColumn("label", F.when(F.col("v") > 0.1, 2).when(F.col("v") > 0, 1).otherwise(0).cast("bigint"))


@add("average_images", "x y", "v", f"{E} :: SELECT x, y, avg(v) AS v FROM eset GROUP BY x, y")
def _(spark, sf):
    return imageset.average_images(fx.embed_set(spark, sf))


@add("average_images_normalized", "x y", "v", f"{E}, m AS (SELECT image, avg(v + 2) AS m FROM eset GROUP BY image) :: SELECT x, y, avg((v + 2) / m) AS v FROM eset JOIN m USING (image) GROUP BY x, y")
def _(spark, sf):
    return imageset.average_images(fx.embed_set(spark, sf).withColumn("v", F.col("v") + 2), normalize=True)


@add("image_set_statistics", "x y n", "median mean max min variance", f"{E} :: SELECT x, y, count(v) AS n, median(v) AS median, avg(v) AS mean, max(v) AS max, min(v) AS min, var_samp(v) AS variance FROM eset GROUP BY x, y")
def _(spark, sf):
    return imageset.set_statistics(fx.embed_set(spark, sf))


@add("image_set_weighted_mean", "x y", "v", f"{E} :: SELECT x, y, sum(v * (grp + 1)) / sum(grp + 1) AS v FROM eset GROUP BY x, y")
def _(spark, sf):
    return imageset.weighted_mean(fx.embed_set(spark, sf).withColumn("g", F.col("grp") + 1), "g")


_T = "avg(v) FILTER (grp = {g}) AS m{g}, var_pop(v) FILTER (grp = {g}) AS s{g}, count(*) FILTER (grp = {g}) AS n{g}"


@add("students_t_images", "x y", "t", f"{E}, a AS (SELECT x, y, {_T.format(g=0)}, {_T.format(g=1)} FROM eset GROUP BY x, y) :: SELECT x, y, (m0 - m1) / sqrt(s0 / n0 + s1 / n1) AS t FROM a")
def _(spark, sf):
    return imageset.students_t(fx.embed_set(spark, sf))


_MV = f"{E}, l AS (SELECT image, x, y, {LABEL} AS label FROM eset), c AS (SELECT x, y, label, count(*) AS n, max(image) AS last FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY n DESC, last) AS k, sum(n) OVER (PARTITION BY x, y) AS total FROM c)"


@add("majority_voting", "x y label decided", "", f"{_MV} :: SELECT x, y, CAST(label AS BIGINT) AS label, n >= 0.5 * total AS decided FROM r WHERE k = 1")
def _(spark, sf):
    return imageset.majority_vote(_labelled(spark, sf), fraction=0.5)


@add("average_labels", "x y label", "p", f"{E}, n AS (SELECT count(DISTINCT image) AS n FROM eset) :: SELECT x, y, CAST({LABEL} AS BIGINT) AS label, count(*) / any_value(n) AS p FROM eset, n WHERE {LABEL} <> 0 GROUP BY ALL")
def _(spark, sf):
    return imageset.average_labels(_labelled(spark, sf))


@add("most_likely", "x y label", "", f"{E}, p AS (SELECT x, y, grp AS label, avg(v) AS p FROM eset GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY p DESC, label) AS k FROM p WHERE p > 0.03) :: SELECT g.x, g.y, coalesce(r.label, 0) AS label FROM (SELECT DISTINCT x, y FROM eset) g LEFT JOIN r ON r.x = g.x AND r.y = g.y AND k = 1")
def _(spark, sf):
    p = fx.embed_set(spark, sf).groupBy("x", "y", F.col("grp").alias("label")).agg(F.avg("v").alias("p"))
    return imageset.most_likely(p, 0.03)


@add("pure_tissue_weight", "x y", "w", f"{E}, p AS (SELECT x, y, max(p) FILTER (g = 0) AS a, max(p) FILTER (g = 1) AS b, max(p) FILTER (g = 2) AS c FROM (SELECT x, y, grp % 3 AS g, 1 / (1 + exp(-avg(v) * 10)) AS p FROM eset GROUP BY ALL) GROUP BY x, y) :: SELECT x, y, a * (1 - b) * (1 - c) + b * (1 - a) * (1 - c) + c * (1 - a) * (1 - b) AS w FROM p")
def _(spark, sf):
    p = fx.embed_set(spark, sf).groupBy("x", "y", (F.col("grp") % 3).alias("image")).agg((1 / (1 + F.exp(-F.avg("v") * 10))).alias("p"))
    return imageset.pure_tissue(p)


def _project(how: str, sql: str) -> None:
    @add(f"project_{how}", "image x", "v", f"{E} :: SELECT image, x, {sql}(v) AS v FROM eset GROUP BY image, x")
    def _(spark, sf):
        e = fx.embed_set(spark, sf).select(F.col("image").alias("z"), "x", "y", "v")
        return imageset.project(e, "y", how).withColumnRenamed("z", "image")


for _how, _f in (("sum", "sum"), ("max", "max"), ("min", "min"), ("mean", "avg")):
    _project(_how, _f)


@add("image_set_to_matrix", "image place", "v", f"{E} :: SELECT image, row_number() OVER (PARTITION BY image ORDER BY y, x) - 1 AS place, v FROM eset WHERE x < 4")
def _(spark, sf):
    e = fx.embed_set(spark, sf)
    m = imageset.set_to_matrix(e, e.filter("image = 0 AND x < 4").select("x", "y"))
    return m.select("image", F.posexplode("values").alias("place", "v")).withColumn("place", F.col("place").cast("bigint"))


@add("vector_to_image", "x y", "out", f"{fx.PART_SQL}, i AS (SELECT x, y, row_number() OVER (ORDER BY y, x) - 1 AS i FROM img WHERE w > 40) :: SELECT img.x, img.y, CASE WHEN i < 100 THEN i * 0.5 ELSE 0 END AS out FROM img LEFT JOIN i ON i.x = img.x AND i.y = img.y")
def _(spark, sf):
    return imageset.vector_to_image(fx.part_image(spark, sf).withColumn("mask", (F.col("w") > 40).cast("int")).select("x", "y", "mask"), [0.5 * i for i in range(100)])


_RS = f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY md5('17|' || image || '|' || x || '|' || y)) AS k FROM eset)"


@add("random_samples", "image x y", "v", f"{_RS} :: SELECT image, x, y, v FROM r WHERE k <= 5")
def _(spark, sf):
    return imageset.random_samples(fx.embed_set(spark, sf), 5, 17)


_CT = f"{E}, p AS (SELECT x, y, avg(v) FILTER (grp % 3 = 0) AS p1, avg(v) FILTER (grp % 3 = 1) AS p2, avg(v) FILTER (grp % 3 = 2) AS p3 FROM eset GROUP BY x, y)"


@add("check_tissue_labeling", "x y out", "", f"{_CT} :: SELECT x, y, CAST(CASE WHEN p1 >= greatest(p2, p3) THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS BIGINT) AS out FROM p")
def _(spark, sf):
    """Labels that are the priors' best, renamed: the check gives them their names back."""
    e = fx.embed_set(spark, sf).groupBy("x", "y").agg(*[F.avg(F.when(F.col("grp") % 3 == g, F.col("v"))).alias(f"p{g + 1}") for g in range(3)])
    best = F.array_position(F.array("p1", "p2", "p3"), F.greatest("p1", "p2", "p3"))
    return imageset.check_tissue_labels(e.withColumn("label", (best % 3 + 1).cast("bigint")))


@add("multiply_images", "x y", "v", f"{fx.PART_SQL} :: SELECT x, y, v * w AS v FROM img")
def _(spark, sf):
    a = fx.part_image(spark, sf)
    return imageset.multiply_images(a.select("x", "y", "v"), a.select("x", "y", F.col("w").alias("v")))


_CV = f"{E}, t AS (SELECT x, y, avg(v) AS t FROM eset GROUP BY x, y), s AS (SELECT image, x, y, v, {LABEL} AS l, t FROM eset JOIN t USING (x, y)), n AS (SELECT a.image, a.x, a.y, any_value(a.l) AS l, abs(corr(b.v, b.t)) AS r FROM s a JOIN s b ON a.image = b.image AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.image, a.x, a.y), w AS (SELECT x, y, l, sum(r) AS w FROM n GROUP BY ALL)"


@add("correlation_voting", "x y label", "", f"{_CV} :: SELECT x, y, CAST(arg_max(l, w) AS BIGINT) AS label FROM w GROUP BY x, y")
def _(spark, sf):
    e = _labelled(spark, sf)
    target = e.groupBy("x", "y").agg(F.avg("v").alias("v"))
    return neighborhood.correlation_voting(target, e, 1)


# Time series.
@add("time_series_subset", "x t", "v", f"{S}, p AS (SELECT i, least(CAST(floor(i * 30 / 7.0) AS BIGINT), 29) AS t FROM range(7) r(i)) :: SELECT x, p.i AS t, v FROM ser JOIN p ON ser.t = p.t")
def _(spark, sf):
    return timeseries.subset(fx.event_series(spark, sf), 7, 30)


def _split(odd: int) -> None:
    @add(f"split_alternating_{'odd' if odd else 'even'}", "x t", "v", f"{S} :: SELECT x, t // 2 AS t, v FROM ser WHERE t % 2 = {odd} AND t < 30")
    def _(spark, sf):
        return timeseries.split_alternating(fx.event_series(spark, sf), bool(odd), 30)


_split(0)
_split(1)


@add("simple_subtraction", "x t", "v", f"{S} :: SELECT a.x, a.t // 2 AS t, a.v - b.v AS v FROM ser a JOIN ser b ON a.x = b.x AND b.t = a.t + 1 WHERE a.t % 2 = 0")
def _(spark, sf):
    return timeseries.simple_subtraction(fx.event_series(spark, sf))


@add("simple_subtraction_mean", "x", "v", f"{S} :: SELECT a.x, avg(a.v - b.v) AS v FROM ser a JOIN ser b ON a.x = b.x AND b.t = a.t + 1 WHERE a.t % 2 = 0 GROUP BY a.x")
def _(spark, sf):
    return timeseries.simple_subtraction(fx.event_series(spark, sf), mean=True)


@add("interpolation_subtraction", "x t", "v", f"{S} :: SELECT a.x, a.t, (a.v - (p.v + q.v) / 2) * (CASE WHEN a.t % 2 = 0 THEN 1 ELSE -1 END) AS v FROM ser a JOIN ser p ON p.x = a.x AND p.t = a.t - 1 JOIN ser q ON q.x = a.x AND q.t = a.t + 1")
def _(spark, sf):
    return timeseries.interpolation_subtraction(fx.event_series(spark, sf))


@add("time_series_mask", "x t", "v", f"{S} :: SELECT x, t, CASE WHEN x % 3 <> 0 THEN v ELSE 0 END AS v FROM ser")
def _(spark, sf):
    s = fx.event_series(spark, sf)
    return timeseries.mask_series(s, s.select("x").distinct().withColumn("mask", F.col("x") % 3))


@add("average_over_time", "x", "v", f"{S} :: SELECT x, avg(v) AS v FROM ser GROUP BY x")
def _(spark, sf):
    return timeseries.average_over(fx.event_series(spark, sf))


@add("average_over_time_plus_one", "x", "v", f"{S} :: SELECT x, sum(v) / (count(*) + 1) AS v FROM ser GROUP BY x")
def _(spark, sf):
    return timeseries.average_over(fx.event_series(spark, sf), plus_one=True)


_LV = f"{S}, m AS (SELECT x, avg(v) AS m FROM ser GROUP BY x), r AS (SELECT t, avg(abs(v - m)) / (SELECT count(DISTINCT t) FROM ser) AS r FROM ser JOIN m USING (x) GROUP BY t), w AS (SELECT t, r, (sum(r) OVER f - r) / (count(*) OVER f - 1) AS near FROM r WINDOW f AS (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING))"


@add("time_series_leverage", "t", "raw_leverage k_neighbors_distance", f"{_LV} :: SELECT t, r AS raw_leverage, abs(r - near) / near AS k_neighbors_distance FROM w")
def _(spark, sf):
    return timeseries.leverage(fx.event_series(spark, sf), 3)


@add("region_correlation", "a b", "r", f"{S}, g AS (SELECT x % 4 AS l, t, avg(v) AS s FROM ser WHERE x % 4 <> 0 GROUP BY ALL) :: SELECT a.l AS a, b.l AS b, corr(a.s, b.s) AS r FROM g a JOIN g b ON a.t = b.t AND a.l < b.l GROUP BY a.l, b.l")
def _(spark, sf):
    return timeseries.region_correlation(fx.event_series(spark, sf).withColumn("label", F.col("x") % 4), min_size=2)


@add("time_series_to_matrix", "t place", "v", f"{S} :: SELECT t, row_number() OVER (PARTITION BY t ORDER BY x) - 1 AS place, v FROM ser")
def _(spark, sf):
    m = timeseries.to_matrix(fx.event_series(spark, sf))
    return m.select("t", F.posexplode("values").alias("place", "v")).withColumn("place", F.col("place").cast("bigint"))


@add("temporal_sd", "x n", "sd mean", f"{S} :: SELECT x, count(*) AS n, stddev_pop(v) AS sd, avg(v) AS mean FROM ser GROUP BY x")
def _(spark, sf):
    return timeseries.temporal_sd(fx.event_series(spark, sf))


@add("comp_cor", "t", "global comp1 comp2", None)
def _(spark, sf):
    return timeseries.comp_cor(fx.event_series(spark, sf), 2)


_OD = f"{S}, d AS (SELECT a.x, a.t, p.v - a.v AS d FROM ser a JOIN ser p ON p.x = a.x AND p.t = a.t - 1 WHERE a.t % 2 = 1)"


@add("pasl_cbf", "x", "cbf", f"{_OD} :: SELECT x, avg(0.9 * d / (2 * 0.95 * 0.001 * 600 * exp(-(600 + 42 * t) / 1650.0))) AS cbf FROM d GROUP BY x")
def _(spark, sf):
    return timeseries.pasl(fx.event_series(spark, sf), 0.001)


@add("pcasl_cbf", "x", "cbf", f"{_OD} :: SELECT x, avg(d * 0.9 / (4 * 0.85 * 0.001 * 1300 * (exp(-2800 / 1650.0) - exp(-700 / 1300.0)))) AS cbf FROM d GROUP BY x")
def _(spark, sf):
    return timeseries.pcasl(fx.event_series(spark, sf), 0.001)


@add("slice_timing", "x t", "v", f"{S} :: SELECT s.x, s.t, coalesce(CASE WHEN s.x % 2 = 0 THEN a.v ELSE a.v * 0.5 + b.v * 0.5 END, 0) AS v FROM ser s LEFT JOIN ser a ON a.x = s.x AND a.t = s.t + (s.x // 2) LEFT JOIN ser b ON b.x = s.x AND b.t = s.t + (s.x // 2) + 1")
def _(spark, sf):
    return timeseries.slice_timing(fx.event_series(spark, sf), 0.5, "x")


@add("framewise_displacement", "t", "mean_displacement max_displacement", f"{fx.PART_SQL}, p AS (SELECT DISTINCT t FROM range(10) r(t)), m AS (SELECT t, x, y, x * (1 + 0.01 * t) + 0.1 * t AS u, y + 0.2 * t AS v FROM (SELECT x, y FROM img WHERE w > 45), p), d AS (SELECT t, sqrt(pow(u - lag(u) OVER q, 2) + pow(v - lag(v) OVER q, 2)) AS d FROM m WINDOW q AS (PARTITION BY x, y ORDER BY t)) :: SELECT t, coalesce(avg(d), 0) AS mean_displacement, coalesce(max(d), 0) AS max_displacement FROM d GROUP BY t")
def _(spark, sf):
    t = F.col("id").cast("double")
    params = spark.range(10).select(F.col("id").alias("t"), F.array(1 + 0.01 * t, F.lit(0.0), 0.1 * t, F.lit(0.0), F.lit(1.0), 0.2 * t).alias("a"))
    points = fx.part_image(spark, sf).filter("w > 45").select(F.col("x").cast("double").alias("p0"), F.col("y").cast("double").alias("p1"))
    return timeseries.framewise_displacement(params, points)


@add("orders_monthly_series", "nation t", "v n", "o AS (SELECT c_nationkey AS nation, CAST(date_diff('month', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS t, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey) :: SELECT nation, t, sum(v) AS v, count(*) AS n FROM o GROUP BY nation, t", 2)
def _(spark, sf):
    o, c = fx.table(spark, sf, "orders"), fx.table(spark, sf, "customer")
    months = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("bigint")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), months.alias("t")).agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
