"""Queries of regions, histograms, streams and files."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from gridloom.functions import stats
from gridloom.grid import Geometry, box, numbered, scattered, unbroadcast
from gridloom.operators import align, imageset, layout, matrix, models, neighbors, pixel, regions, timeseries, transforms
from gridloom.plans.lineage import checkpointed
from gridloom.plans.registry import Registry
from gridloom.sources import files
from gridloom.sources import fixtures as fx
from gridloom.streaming import events

REGISTRY = Registry(digits=6)
add = REGISTRY.add
P = fx.PART_SQL
G = Geometry(size=(50, 1), spacing=(1.0, 2.0), origin=(10.0, -5.0))


#: The t distribution of 20 degrees in closed form.
_PV = f"{fx.EMBED_SQL}, a AS (SELECT x, y, avg(v) FILTER (grp = 0) AS m0, avg(v) FILTER (grp = 1) AS m1, var_pop(v) FILTER (grp = 0) AS s0, var_pop(v) FILTER (grp = 1) AS s1, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1 FROM eset GROUP BY x, y), t AS (SELECT x, y, (m0 - m1) / sqrt(s0 / n0 + s1 / n1) AS t FROM a), c AS (SELECT x, y, t, 0.5 + t / sqrt(20 + t * t) / 2 * (" + " + ".join(f"{math.comb(2 * k, k)} / pow(4.0, {k}) * pow(1 + t * t / 20, -{k})" for k in range(10)) + ") AS c FROM t)"


@add("p_value_image", "x y", "p", f"{_PV} :: SELECT x, y, CASE WHEN t = 0 THEN 0 WHEN t >= 1 THEN 1 - c ELSE c END AS p FROM c")
def _(spark, sf):
    t = imageset.students_t(fx.embed_set(spark, sf))
    return t.withColumn("p", stats.p_value("t", 20.0))


@add("histogram_match", "x y", "out", None)
def _(spark, sf):
    a = fx.part_image(spark, sf)
    return stats.match_histogram(a, a.select(F.col("w").alias("v")))


_EQ = f"{P}, s AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM img), h AS (SELECT b.k, (SELECT count(*) FROM img, s WHERE least(floor((v - lo) / (hi - lo) * 10), 9) < b.k) AS below, (SELECT count(*) FROM img, s WHERE least(floor((v - lo) / (hi - lo) * 10), 9) <= b.k) AS upto FROM range(10) b(k))"


@add("histogram_equalize", "x y", "out", f"{_EQ} :: SELECT x, y, lo + (hi - lo) * (below + (upto - below) * ((v - lo) / (hi - lo) * 10 - k)) / n AS out FROM img, s JOIN h ON k = least(floor((v - lo) / (hi - lo) * 10), 9)", 4)
def _(spark, sf):
    return stats.equalize_histogram(fx.part_image(spark, sf), 10)


@add("component_features", "x y label", "volume perimeter_ratio", None)
def _(spark, sf):
    a = fx.part_image(spark, sf).withColumn("label", F.when(F.col("w") > 40, 2).when(F.col("w") > 25, 1).otherwise(0).cast("bigint"))
    return regions.component_features(a, Geometry(size=(50, 1)))


_FM = f"RECURSIVE {P}, c AS (SELECT x, y, y * 50 + x AS id, 1 / w AS s FROM img WHERE w > 5), e AS (SELECT a.id AS u, b.id AS v, (a.s + b.s) / 2 AS cost FROM c a JOIN c b ON (b.y = a.y AND abs(b.x - a.x) = 1) OR (b.x = a.x AND abs(b.y - a.y) = 1)), r(id, t) USING KEY (id) AS (SELECT id, CAST(0 AS DOUBLE) FROM c WHERE id = (SELECT min(id) FROM c) UNION SELECT e.v, min(r.t + e.cost) FROM r JOIN e ON e.u = r.id LEFT JOIN recurring.r q ON q.id = e.v WHERE q.id IS NULL OR q.t > r.t + e.cost + 1e-12 GROUP BY e.v)"


def _speed(spark, sf):
    a = fx.part_image(spark, sf).filter("w > 5").select("x", "y", F.col("w").alias("v"), F.col("lb").alias("lb"))
    return a, a.agg(F.min(F.struct("y", "x")).alias("p")).select("p.x", "p.y")


@add("city_block_arrival", "x y", "time", f"{_FM} :: SELECT c.x, c.y, r.t AS time FROM r JOIN c USING (id)")
def _(spark, sf):
    return regions.city_block_arrival(*_speed(spark, sf))


def _upwind_sql(seeds: str, value: str) -> str:
    """The upwind update of every cell beside a changed one until nothing changes; seeds: a condition on c, value: what they carry."""
    near = lambda side: f"LEFT JOIN recurring.r {side} ON {side}.id = c.{side}"
    axis = lambda p, q, n: (
        f"least(coalesce({p}.t, 1e300), coalesce({q}.t, 1e300)) AS {n}, CASE WHEN {p}.t IS NULL THEN {q}.g WHEN {q}.t IS NULL THEN {p}.g "
        f"WHEN abs({p}.t - {q}.t) <= 1e-9 THEN ({p}.g + {q}.g) / 2 WHEN {p}.t < {q}.t THEN {p}.g ELSE {q}.g END AS g{n}"
    )
    touched = "SELECT c.* FROM c WHERE c.lf IN (SELECT id FROM r) OR c.rt IN (SELECT id FROM r) OR c.up IN (SELECT id FROM r) OR c.dn IN (SELECT id FROM r)"
    sides = f"SELECT c.id, c.s, {axis('lf', 'rt', 'a')}, {axis('up', 'dn', 'b')} FROM ({touched}) c {near('lf')} {near('rt')} {near('up')} {near('dn')}"
    time = "CASE WHEN abs(a - b) >= s THEN least(a, b) + s ELSE (a + b + sqrt(2 * s * s - (a - b) * (a - b))) / 2 END"
    one = "CASE WHEN a < b THEN ga ELSE gb END"
    both = "CASE WHEN abs(a - b) >= s THEN " + one + " WHEN 2 * t - a - b <= 0 THEN (ga + gb) / 2 ELSE ((t - a) * ga + (t - b) * gb) / (2 * t - a - b) END"
    new = f"SELECT id, t, {both} AS g FROM (SELECT *, {time} AS t FROM ({sides}))"
    step = f"SELECT n.id, n.t, n.g FROM ({new}) n LEFT JOIN recurring.r q ON q.id = n.id WHERE q.id IS NULL OR n.t < q.t - 1e-12 OR (abs(n.t - q.t) <= 1e-12 AND abs(n.g - q.g) > 1e-12 AND n.id NOT IN (SELECT id FROM seeds))"
    grid = f"{P}, w AS (SELECT x, y, y * 50 + x AS id, 1 / w AS s, lb FROM img WHERE w > 5), c AS MATERIALIZED (SELECT w.*, l.id AS lf, m.id AS rt, u.id AS up, d.id AS dn FROM w LEFT JOIN w l ON l.x = w.x - 1 AND l.y = w.y LEFT JOIN w m ON m.x = w.x + 1 AND m.y = w.y LEFT JOIN w u ON u.x = w.x AND u.y = w.y - 1 LEFT JOIN w d ON d.x = w.x AND d.y = w.y + 1)"
    return f"RECURSIVE {grid}, seeds AS (SELECT id, CAST({value} AS DOUBLE) AS g FROM c WHERE {seeds}), r(id, t, g) USING KEY (id) AS (SELECT id, CAST(0 AS DOUBLE), g FROM seeds UNION {step})"


@add("fast_marching", "x y", "time", f"{_upwind_sql('lb = 11', '0')} :: SELECT c.x, c.y, r.t AS time FROM r JOIN c USING (id)")
def _(spark, sf):
    a, _ = _speed(spark, sf)
    return regions.fast_marching(a, a.filter("lb = 11"))


@add("fast_marching_extension", "x y", "time aux", f"{_upwind_sql('lb = 11', 'x + y')} :: SELECT c.x, c.y, r.t AS time, r.g AS aux FROM r JOIN c USING (id)")
def _(spark, sf):
    a, _ = _speed(spark, sf)
    return regions.fast_marching_extension(a, a.filter("lb = 11").select("x", "y", (F.col("x") + F.col("y")).alias("aux")))


@add("fast_marching_topology", "x y", "time", None)
def _(spark, sf):
    a, _ = _speed(spark, sf)
    return regions.fast_marching(a, a.filter("lb = 11"), topology="strict")


@add("lesion_filling", "x y", "v", None)
def _(spark, sf):
    return regions.lesion_fill(fx.part_image(spark, sf).withColumn("mask", (F.col("w") > 44).cast("int")), "mask")


@add("motion_correction", "t sx sy", "", "SELECT CAST(t AS BIGINT) AS t, CAST(0 AS INT) AS sx, CAST(0 AS INT) AS sy FROM range(4) r(t)")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", F.col("w").alias("v"))
    return regions.motion_correct(layout.replicate(a, "t", 4), 1)


_MC = f"{P}, s AS (SELECT x + t * (t - 1) // 2 % 2 AS x, y - t % 2 AS y, t, w AS v FROM img, range(4) r(t)), m AS (SELECT x, y, avg(v) AS m FROM s GROUP BY x, y), o AS (SELECT a.i - 1 AS ox, b.i - 1 AS oy FROM range(3) a(i), range(3) b(i)), c AS (SELECT t, ox, oy, avg(pow(m.m - s.v, 2)) AS c FROM s, o JOIN m ON m.x = s.x - ox AND m.y = s.y - oy GROUP BY t, ox, oy), k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY c, abs(ox), abs(oy), ox, oy) AS k FROM c)"


@add("motion_correction_of_shifts", "t sx sy", "metric", f"{_MC} :: SELECT t, CAST(ox AS INT) AS sx, CAST(oy AS INT) AS sy, c AS metric FROM k WHERE k = 1")
def _(spark, sf):
    a = layout.replicate(fx.part_image(spark, sf).select("x", "y", F.col("w").alias("v")), "t", 4)
    moved = a.withColumns({"x": F.col("x") + F.expr("t * (t - 1) div 2 % 2"), "y": F.col("y") - F.col("t") % 2})
    return regions.motion_correct(moved, 1)


@add("colormap", "x y r g b", "", f"{P}, s AS (SELECT min(w) AS lo, max(w) AS hi FROM img), f AS (SELECT x, y, (w - lo) / (hi - lo) AS f FROM img, s) :: SELECT x, y, CAST(floor(CASE WHEN f <= 0 THEN 0.0 WHEN f < 0.5 THEN 0.0 + (f - 0.0) * (200.0 / 0.5) WHEN f < 1 THEN 200.0 + (f - 0.5) * (55.0 / 0.5) ELSE 255.0 END) AS BIGINT) AS r, CAST(floor(CASE WHEN f <= 0 THEN 0.0 WHEN f < 0.5 THEN 0.0 WHEN f < 1 THEN 0.0 + (f - 0.5) * (255.0 / 0.5) ELSE 255.0 END) AS BIGINT) AS g, CAST(0 AS BIGINT) AS b FROM f")
def _(spark, sf):
    return regions.colormap(fx.part_image(spark, sf), [(0.0, 0, 0, 0), (0.5, 200, 0, 0), (1.0, 255, 255, 0)], "w")


@add("level_crossings", "axis", "px py", f"{P}, n AS (SELECT 'x' AS axis, a.x + (25.5 - a.w) / (b.w - a.w) AS x, a.y * 1.0 AS y FROM img a JOIN img b ON b.x = a.x + 1 AND b.y = a.y WHERE (a.w < 25.5) <> (b.w < 25.5) UNION ALL SELECT 'y', a.x, a.y + (25.5 - a.w) / (b.w - a.w) FROM img a JOIN img b ON b.x = a.x AND b.y = a.y + 1 WHERE (a.w < 25.5) <> (b.w < 25.5)) :: SELECT axis, 10 + x AS px, -5 + 2 * y AS py FROM n")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", F.col("w").alias("v"))
    return regions.mesh_points(a, G, 25.5)


@add("scan_numbering", "x y i", "", f"{P} :: SELECT x, y, row_number() OVER (ORDER BY y, x) - 1 AS i FROM img")
def _(spark, sf):
    return numbered(fx.part_image(spark, sf)).withColumn("i", F.col("i").cast("bigint"))


def _hashed(seed: int) -> str:
    return f"((('0x' || substr(md5('{seed}|' || x || '|' || y), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


@add("add_gaussian_noise", "x y", "out", f"{P} :: SELECT x, y, v + sqrt(-2 * ln({_hashed(14)})) * cos(2 * pi() * {_hashed(15)}) AS out FROM img")
def _(spark, sf):
    return pixel.add_noise(fx.part_image(spark, sf), "gaussian", 7)


@add("add_salt_and_pepper_noise", "x y", "out", f"{P} :: SELECT x, y, CASE WHEN {_hashed(7)} < 0.005 THEN 0.0 WHEN {_hashed(7)} < 0.01 THEN 1.0 ELSE v END AS out FROM img")
def _(spark, sf):
    return pixel.add_noise(fx.part_image(spark, sf), "salt_and_pepper", 7)


@add("image_to_points", "label", "x y", f"{P} :: SELECT la AS label, 10.0 + x AS x, -5.0 + 2 * y AS y FROM img WHERE la <> 0")
def _(spark, sf):
    return files.image_to_points(fx.part_image(spark, sf).select("x", "y", F.col("la").alias("label")), G)


# Regressions and views on the embeddings' columns; fields on the part grid.
def _columns(spark, sf):
    cut = lambda lo, n: F.transform(F.slice("embedding", lo, n), lambda x: x.cast("double"))
    return fx.table(spark, sf, "embeddings").select("vec_id", cut(1, 8).alias("x"), (F.col("embedding")[0] * 2 - F.col("embedding")[3]).cast("double").alias("y"), cut(9, 4).alias("a"), cut(13, 4).alias("b"), cut(17, 4).alias("c"))


def _coefficients(name: str, fit, sql: str | None) -> None:
    @add(f"regression_{name}", "i", "c", sql)
    def _(spark, sf):
        return spark.createDataFrame([(i, float(c)) for i, c in enumerate(fit(matrix.gram(_columns(spark, sf), "x", "y")))], "i int, c double")


_EXACT = "SELECT i::INT AS i, CASE i WHEN 0 THEN 2.0 WHEN 3 THEN -1.0 ELSE 0.0 END AS c FROM range(8) r(i)"
_coefficients("conjugate_gradient", matrix.conjugate_gradient, _EXACT)
_coefficients("hard_threshold", lambda g: matrix.hard_threshold(g, 2), _EXACT)
_coefficients("matching_pursuit", lambda g: matrix.matching_pursuit(g, 2), _EXACT)
_coefficients("lasso", lambda g: matrix.lasso(g, 1e-3), None)


@add("multi_view_cca", "", "r", None)
def _(spark, sf):
    return spark.createDataFrame([(matrix.multi_view(_columns(spark, sf), ["a", "b", "c"])[1],)], "r double")


@add("partial_cca", "", "r", None)
def _(spark, sf):
    return spark.createDataFrame([(matrix.partial_cca(_columns(spark, sf), "a", "b", "c"),)], "r double")


@add("whitened_columns", "vec_id", "w0 w1", None)
def _(spark, sf):
    m = _columns(spark, sf).select("vec_id", F.col("a").alias("values"))
    return matrix.whiten(m).select("vec_id", F.col("white")[0].alias("w0"), F.col("white")[1].alias("w1"))


@add("reconstruction_error", "", "e", "SELECT 0.0 AS e")
def _(spark, sf):
    m = _columns(spark, sf).select(F.col("a").alias("values"))
    return spark.createDataFrame([(matrix.reconstruction_error(m, models.principal_components(m, 4)),)], "e double")


def _shift(spark, sf, ux: float, uy: float):
    return fx.part_image(spark, sf).select("x", "y", F.lit(ux).alias("ux"), F.lit(uy).alias("uy"))


@add("compose_fields", "x y", "ux uy", f"{P} :: SELECT x, y, CASE WHEN x < 49 THEN 1.5 ELSE 1.0 END AS ux, 0.0 AS uy FROM img")
def _(spark, sf):
    return transforms.compose_fields(_shift(spark, sf, 1.0, 0.0), _shift(spark, sf, 0.5, 0.0))


@add("exponential_field", "x y", "ux uy", f"{P} :: SELECT x, y, 0.0 AS ux, 0.0 AS uy FROM img")
def _(spark, sf):
    return transforms.exponential(_shift(spark, sf, 0.0, 0.0), 2)


@add("warp_labels", "x y label", "", f"{P} :: SELECT a.x, a.y, coalesce(b.lb, 0) AS label FROM img a LEFT JOIN img b ON b.x = a.x + 1 AND b.y = a.y")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", F.col("lb").alias("label"))
    return transforms.warp_labels(a, a, {"x": F.col("x") + 1.0, "y": F.col("y") + 0.0})


@add("resample_lanczos", "x y", "v", f"{P} :: SELECT x, y, v FROM img")
def _(spark, sf):
    return transforms.resample_sinc(fx.part_image(spark, sf), {"x": 0.0})


_CP = "s AS (SELECT s_suppkey AS id, s_suppkey % 10 * 1.0 AS px, s_suppkey // 10 * 1.0 AS py FROM supplier), d AS (SELECT a.id, b.id AS t, sqrt(pow(a.px + 0.2 - b.px, 2) + pow(a.py - b.py, 2)) AS d FROM s a JOIN s b ON abs(a.px + 0.2 - b.px) <= 1.5 AND abs(a.py - b.py) <= 1.5)"


@add("closest_points", "id near", "d", f"{_CP} :: SELECT id, arg_min(t, d) AS near, min(d) AS d FROM d GROUP BY id")
def _(spark, sf):
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10 * 1.0).cast("double").alias("px"), (F.expr("s_suppkey div 10") * 1.0).cast("double").alias("py"))
    return transforms.closest_points(s.withColumn("px", F.col("px") + 0.2), s, 1.5).withColumnRenamed("to", "near")


# Streams: the batch's result over all rows that are there.
def _name() -> str:
    return "events_" + uuid.uuid4().hex


@add("stream_tumbling", "start event_type n", "total mean", "SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS start, event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean FROM events GROUP BY ALL", 7)
def _(spark, sf):
    out = events.run_to_table(events.tumbling(events.read_events(spark, sf)), _name())
    return out.withColumn("start", F.unix_timestamp(F.col("window.start")))


@add("stream_sliding", "start event_type n", "mean", "w AS (SELECT epoch_us(ts) // 1000000 AS s, event_type, value FROM events), k AS (SELECT (s // 21600 - o) * 21600 AS start, event_type, value FROM w, range(4) r(o)) :: SELECT start, event_type, count(*) AS n, avg(value) AS mean FROM k GROUP BY ALL", 7)
def _(spark, sf):
    out = events.run_to_table(events.sliding(events.read_events(spark, sf)), _name())
    return out.withColumn("start", F.unix_timestamp(F.col("window.start")))


_SE = "e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)"


@add("stream_sessions", "user_id n", "", f"{_SE} :: SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, sf):
    return events.run_to_table(events.sessions(events.read_events(spark, sf)), _name())


@add("stream_deduplicated", "event_type n", "", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    got = events.run_to_table(events.deduplicated(events.read_events(spark, sf)), _name(), "append")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# Volumes of one smoothed image, the t-th a quarter of a cell times t further on, and Gauss-Newton steps written out.
MOTION_STEPS = 3


def _smooth_sql(name: str, source: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT a.x, a.y, avg(b.v) AS v FROM {source} a JOIN {source} b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.x, a.y)"


def _motion_sql() -> str:
    base = f"{P}, i0 AS (SELECT x, y, w AS v FROM img), {_smooth_sql('i1', 'i0')}, {_smooth_sql('f', 'i1')}"
    vols = "vol AS (SELECT t, a.x, a.y, (1 - 0.25 * t) * a.v + 0.25 * t * b.v AS v FROM f a JOIN f b ON b.x = a.x + 1 AND b.y = a.y, range(4) r(t))"
    slope = lambda w: f"(coalesce(lead(v) OVER {w}, v) - coalesce(lag(v) OVER {w}, v)) / greatest((lead(v) OVER {w} IS NOT NULL)::INT + (lag(v) OVER {w} IS NOT NULL)::INT, 1)"
    grad = f"g AS MATERIALIZED (SELECT t, x, y, v, {slope('wx')} AS gx, {slope('wy')} AS gy FROM vol WINDOW wx AS (PARTITION BY t, y ORDER BY x), wy AS (PARTITION BY t, x ORDER BY y))"
    parts = [base, vols, grad, "s0 AS (SELECT t, CAST(0 AS DOUBLE) AS sx, CAST(0 AS DOUBLE) AS sy FROM range(4) r(t))"]
    for k in range(MOTION_STEPS + 1):
        parts.append(f"p{k} AS (SELECT g.*, floor(x + sx) AS qx, floor(y + sy) AS qy, x + sx - floor(x + sx) AS dx, y + sy - floor(y + sy) AS dy FROM g JOIN s{k} USING (t))")
        corners = [("a", 0, 0, "(1 - dx) * (1 - dy)"), ("b", 1, 0, "dx * (1 - dy)"), ("c", 0, 1, "(1 - dx) * dy"), ("d", 1, 1, "dx * dy")]
        read = " + ".join(f"CASE WHEN {w} > 0 THEN {w} * {c}.v ELSE 0 END" for c, _, _, w in corners)
        joins = " ".join(f"LEFT JOIN f {c} ON {c}.x = qx + {i} AND {c}.y = qy + {j}" for c, i, j, _ in corners)
        parts.append(f"r{k} AS (SELECT p.t, gx, gy, {read} - p.v AS r FROM p{k} p {joins})")
        parts.append(f"h{k} AS MATERIALIZED (SELECT t, avg(r * r) AS m, sum(gx * gx) AS xx, sum(gx * gy) AS xy, sum(gy * gy) AS yy, sum(gx * r) AS rx, sum(gy * r) AS ry FROM r{k} WHERE r IS NOT NULL GROUP BY t)")
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT t, sx - (yy * rx - xy * ry) / (xx * yy - xy * xy) AS sx, sy - (xx * ry - xy * rx) / (xx * yy - xy * xy) AS sy FROM s{k} JOIN h{k} USING (t))")
    n = MOTION_STEPS
    return ", ".join(parts) + f" :: SELECT t, h0.m AS before, h{n}.m AS after, sx AS p0, sy AS p1 FROM s{n} JOIN h0 USING (t) JOIN h{n} USING (t)"


def _box_mean(df):
    return scattered(df, box(["x", "y"], 1), ["x", "y"]).groupBy("x", "y").agg(F.avg("v").alias("v"), F.max("_self").alias("own")).filter("own").drop("own")


@add("motion_correction_below_a_cell", "t", "before after p0 p1", _motion_sql(), 5)
def _(spark, sf):
    image = checkpointed(_box_mean(_box_mean(fx.part_image(spark, sf).select("x", "y", F.col("w").alias("v")))))
    on = image.select((F.col("x") - 1).alias("x"), "y", F.col("v").alias("_n"))
    times = F.explode(F.array(*[F.lit(t).cast("bigint") for t in range(4)])).alias("t")
    series = image.join(unbroadcast(on), ["x", "y"]).select(times, "x", "y", "v", "_n").select("t", "x", "y", ((1 - 0.25 * F.col("t")) * F.col("v") + 0.25 * F.col("t") * F.col("_n")).alias("v"))
    return align.motion_correction(series, image, "translation", levels=(1,), steps=MOTION_STEPS).table(spark)


@add("search_of_half_a_turn", "cells", "angle after", None)
def _(spark, sf):
    """The image turned by half a turn is found from many starts: the angle without its sign."""
    image = checkpointed(_box_mean(_box_mean(fx.part_image(spark, sf).select("x", "y", F.col("w").alias("v")))))
    high = image.agg(F.max("x"), F.max("y")).first()
    got = align.searched(image.select((high[0] - F.col("x")).alias("x"), (high[1] - F.col("y")).alias("y"), "v"), image, turns=6, shifts=1, best=2, steps=8)
    return spark.createDataFrame([(image.count(), abs(got.parameters(0)[2]), got.metric[0][1])], "cells bigint, angle double, after double")


PAIR_ROUNDS, PAIR_A, PAIR_B = 3, 0.5, 0.25


def _pair_sql() -> str:
    """All pairs of three labels of users; rounds written out."""
    parts = [f"{fx.EVENT_SQL}, lab AS (SELECT x % 4 AS l, x, t, v FROM ser WHERE x % 4 <> 0)", "e AS MATERIALIZED (SELECT l, x, t, v - avg(v) OVER (PARTITION BY l, x) AS e FROM lab)", "n AS (SELECT l, count(DISTINCT x) AS n FROM e GROUP BY l)"]
    parts.append("u0_z AS (SELECT p.a, p.b, x, sum(e * e) AS w FROM (SELECT i.l AS a, j.l AS b FROM n i JOIN n j ON i.l < j.l) p JOIN e ON e.l = p.a GROUP BY p.a, p.b, x), u0 AS MATERIALIZED (SELECT a, b, x, w / sqrt(sum(w * w) OVER (PARTITION BY a, b)) AS w FROM u0_z)")

    def half(old: str, new: str, one: str, other: str, share: float) -> None:
        parts.append(f"{new}_s AS MATERIALIZED (SELECT a, b, t, sum(e * w) AS s FROM e JOIN {old} u ON e.l = u.{one} AND e.x = u.x GROUP BY a, b, t)")
        parts.append(f"{new}_z AS MATERIALIZED (SELECT a, b, e.x, sum(e * s) AS w FROM e JOIN {new}_s s ON e.l = s.{other} AND e.t = s.t GROUP BY a, b, e.x)")
        parts.append(f"{new}_r AS (SELECT z.*, greatest(floor({share} * n.n + 0.5), 1) AS k, row_number() OVER (PARTITION BY a, b ORDER BY abs(w) DESC) AS r FROM {new}_z z JOIN n ON n.l = z.{other})")
        parts.append(f"{new}_c AS (SELECT a, b, x, sign(w) * greatest(abs(w) - coalesce(max(CASE WHEN r = k + 1 THEN abs(w) END) OVER (PARTITION BY a, b), 0), 0) AS w FROM {new}_r)")
        parts.append(f"{new} AS MATERIALIZED (SELECT a, b, x, w / sqrt(sum(w * w) OVER (PARTITION BY a, b)) AS w FROM {new}_c)")

    for k in range(PAIR_ROUNDS):
        half(f"u{k}", f"w{k}", "a", "b", PAIR_B)
        half(f"w{k}", f"u{k + 1}", "b", "a", PAIR_A)
    u, w = f"u{PAIR_ROUNDS}", f"w{PAIR_ROUNDS - 1}"
    parts.append(f"s AS (SELECT a, b, t, sum(e * w) AS s FROM e JOIN {u} u ON e.l = u.a AND e.x = u.x GROUP BY a, b, t), q AS (SELECT a, b, t, sum(e * w) AS q FROM e JOIN {w} u ON e.l = u.b AND e.x = u.x GROUP BY a, b, t)")
    parts.append("r AS (SELECT a, b, sum(s * q) / sqrt(sum(s * s) * sum(q * q)) AS r FROM s FULL JOIN q USING (a, b, t) GROUP BY a, b)")
    side = lambda v, name: f"SELECT a, b, '{name}' AS side, x, w AS loading, r FROM {v} JOIN r USING (a, b) WHERE w <> 0"
    return ", ".join(parts) + f" :: {side(u, 'a')} UNION ALL {side(w, 'b')}"


@add("region_sparse_cca", "a b side x", "loading r", _pair_sql())
def _(spark, sf):
    cells = fx.event_series(spark, sf).withColumn("label", F.col("x") % 4)
    found, loadings = timeseries.region_sparse_cca(cells, PAIR_A, PAIR_B, PAIR_ROUNDS)
    return loadings.join(found, ["a", "b"])


# Points of the embeddings' first three entries, their 6 nearest others and the kernels these shape.
_NEAR_SQL = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), d AS (SELECT p.id, q.id AS other, q.a - p.a AS ga, q.b - p.b AS gb, q.c - p.c AS gc, pow(p.a - q.a, 2) + pow(p.b - q.b, 2) + pow(p.c - q.c, 2) AS d2 FROM p JOIN p q ON p.id <> q.id), n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS rank FROM d QUALIFY rank <= 6)"
# covar_pop about the neighbours' mean, and the mean's own square, give the moments about the point
_ABOUT = lambda u, v: f"covar_pop({u}, {v}) + avg({u}) * avg({v})"
_KERNEL_SQL = f"{_NEAR_SQL}, k AS (SELECT id, {_ABOUT('ga', 'ga')} + 0.01 AS aa, {_ABOUT('ga', 'gb')} AS ab, {_ABOUT('ga', 'gc')} AS ac, {_ABOUT('gb', 'gb')} + 0.01 AS bb, {_ABOUT('gb', 'gc')} AS bc, {_ABOUT('gc', 'gc')} + 0.01 AS cc FROM n GROUP BY id), m AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM k)"
_DENSITY_SQL = f"{_KERNEL_SQL}, q AS (SELECT n.id, det, (ga * ga * (bb * cc - bc * bc) + gb * gb * (aa * cc - ac * ac) + gc * gc * (aa * bb - ab * ab) + 2 * ga * gb * (ac * bc - ab * cc) + 2 * ga * gc * (ab * bc - ac * bb) + 2 * gb * gc * (ab * ac - aa * bc)) / det AS z FROM n JOIN m ON m.id = n.other)"


def _points(spark, sf):
    e = F.col("embedding")
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *[e[i].cast("double").alias(c) for i, c in enumerate("abc")])


@add("nearest_neighbours", "id rank other", "d2", f"{_NEAR_SQL} :: SELECT id, CAST(rank AS INT) AS rank, other, d2 FROM n")
def _(spark, sf):
    return neighbors.nearest(_points(spark, sf), 6, ["a", "b", "c"])


@add("local_covariances", "id", "s00 s10 s11 s20 s21 s22", f"{_KERNEL_SQL} :: SELECT id, aa AS s00, ab AS s10, bb AS s11, ac AS s20, bc AS s21, cc AS s22 FROM m")
def _(spark, sf):
    return neighbors.local_covariances(_points(spark, sf), 6, ["a", "b", "c"], 0.1)


@add("manifold_density", "id", "density", f"{_DENSITY_SQL} :: SELECT id, avg(exp(-z / 2) / sqrt(pow(2 * pi(), 3) * det)) AS density FROM q GROUP BY id")
def _(spark, sf):
    return neighbors.manifold_density(_points(spark, sf), 6, ["a", "b", "c"], 0.1)
