"""Regressions, views, fields, kernels, point sets and headers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.grid import Geometry
from gridloom.operators import header, matrix, models, transforms


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 8))
    y = x @ [3.0, 0, 0, -2.0, 0, 0, 0, 0] + 1.5 + 0.1 * r.normal(size=400)
    z = r.normal(size=400)
    a, b, c = (np.c_[z + 0.3 * r.normal(size=400), r.normal(size=(400, 2))] for _ in range(3))
    rows = [(i, x[i].tolist(), float(y[i]), a[i].tolist(), b[i].tolist(), c[i].tolist(), [float(z[i])]) for i in range(400)]
    return spark.createDataFrame(rows, "id bigint, x array<double>, y double, a array<double>, b array<double>, c array<double>, z array<double>")


def test_sparse_regressions(table):
    g = matrix.gram(table, "x", "y")
    want = np.array([3.0, 0, 0, -2.0, 0, 0, 0, 0])
    assert matrix.conjugate_gradient(g) == pytest.approx(want, abs=0.05)
    for b in (matrix.hard_threshold(g, 2), matrix.matching_pursuit(g, 2), matrix.lasso(g, 0.1)):
        assert set(np.flatnonzero(b)) == {0, 3} and b == pytest.approx(want, abs=0.15)
    b = matrix.hard_threshold(g, 2)
    assert g.constant(b) == pytest.approx(1.5, abs=0.05) and g.error(b) < 0.02
    out = matrix.predict(table, "x", b, g.constant(b)).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert out == pytest.approx(g.error(b), abs=1e-9)
    assert matrix.cross_validate(table, "x", "y", "id", lambda q: matrix.matching_pursuit(q, 2), 3) < 0.02


def test_views(table):
    directions, r = matrix.multi_view(table, ["a", "b", "c"], share=0.34)
    assert r > 0.8 and all(np.abs(d).argmax() == 0 for d in directions)
    assert models.sparse_cca(table, "a", "b")[0] > 0.85
    assert matrix.partial_cca(table, "a", "b", "z") < 0.35
    true, p = matrix.permutation_p_value(table.select("id", "a", "b"), "a", "b", "id", 3)
    assert true > 0.85 and p == 0.25


def test_whitening_and_reconstruction(table):
    white = matrix.whiten(table.select("id", F.col("x").alias("values"))).select(F.col("white").alias("values"))
    assert models.covariance(white)[2] == pytest.approx(np.eye(8), abs=1e-4)
    rows = table.select(F.col("x").alias("values"))
    assert matrix.reconstruction_error(rows, models.principal_components(rows, 8)) == pytest.approx(0, abs=1e-9)
    assert 0.3 < matrix.reconstruction_error(rows, models.principal_components(rows, 4)) < 0.6
    assert matrix.spatial_smooth(np.array([0.0, 0, 4, 0, 0]), (5,), 0.5).tolist() == [0, 1, 2, 1, 0]


def field(spark, f, n=12):
    return spark.createDataFrame([(x, y, *map(float, f(x, y))) for x in range(n) for y in range(n)], "x bigint, y bigint, ux double, uy double")


def test_fields(spark):
    u = field(spark, lambda x, y: (0.5 * math.sin(y / 3), 0.4 * math.cos(x / 4)))
    inverse = transforms.invert_field(u, 8)
    inner = (F.col("x").between(3, 8)) & (F.col("y").between(3, 8))
    assert transforms.inverse_error(u, inverse).filter(inner).agg(F.max("v")).first()[0] < 0.02
    same = transforms.compose_fields(u, field(spark, lambda x, y: (1, 0))).filter(inner).join(u.withColumnsRenamed({"ux": "a", "uy": "b"}), ["x", "y"])
    assert same.agg(F.max(F.abs(F.col("ux") - F.col("a") - 1))).first()[0] < 1e-9
    turn = field(spark, lambda x, y: (-0.3 * (y - 5.5), 0.3 * (x - 5.5)))
    got = transforms.exponential(turn, 5).filter("x = 7 AND y = 6").first()
    want = transforms.rotation((0, 0, 1), math.degrees(0.3))[:2, :2] @ [1.5, 0.5]
    assert (7 + got["ux"] - 5.5, 6 + got["uy"] - 5.5) == pytest.approx(tuple(want), abs=0.03)


def test_label_warp_and_kernels(spark):
    grid = spark.createDataFrame([(x, y, float(x), 1 if x < 5 else 2) for x in range(10) for y in range(4)], "x bigint, y bigint, v double, label bigint")
    got = {(r["x"], r["y"]): r["label"] for r in transforms.warp_labels(grid, grid, {"x": F.col("x") + 0.4, "y": F.col("y") + 0.0}).collect()}
    assert got[4, 1] == 1 and got[5, 1] == 2 and set(got.values()) == {1, 2}
    for kind in transforms.WINDOWS:
        row = {r["x"]: r["v"] for r in transforms.resample_sinc(grid, {"x": 0.25}, kind).filter("y = 2").collect()}
        assert row[4] == pytest.approx(4.25, abs=0.2), kind


def test_closest_points_and_registration(spark):
    r = np.random.default_rng(4)
    p = r.uniform(0, 20, size=(60, 2))
    turn = transforms.rotation((0, 0, 1), 4)[:2, :2]
    q = p @ turn.T + [0.4, -0.3]
    frame = lambda v: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(v)], "id bigint, px double, py double")
    near = transforms.closest_points(frame(p), frame(q), 3.0).collect()
    d = np.linalg.norm(p[:, None] - q[None], axis=2)
    assert {x["id"]: x["to"] for x in near} == {i: int(d[i].argmin()) for i in range(60) if d[i].min() <= 3}
    m = transforms.register_points(frame(p), frame(q), 4.0, 12)
    assert np.asarray(m)[:, :2] == pytest.approx(turn, abs=0.02)


def test_headers():
    g = Geometry((4, 5, 6), (1.0, 1.0, 2.0), (1.234, -5.0, 0.0), ((0.99, 0.1, 0), (-0.1, 0.99, 0), (0, 0, 1.0)))
    assert header.simplified(g).origin == (1.23, -5.0, 0.0) and header.simplified(g).direction == Geometry((4, 5, 6)).direction
    assert header.compare(g, g) == 0 and header.compare(g, header.set_origin(g, (-1.0, -5.0, 0.0))) == 1
    flipped = header.set_direction(g, ((-1.0, 0, 0), (0, 1.0, 0), (0, 0, 1.0)))
    assert header.compare(g, flipped) == 2 and header.compare(header.set_origin(g, (-1.0, -5.0, 0.0)), flipped) == 3
    assert header.reset_direction(flipped).direction == Geometry((4, 5, 6)).direction
    assert header.set_time_spacing(g, 3.0).spacing == (1.0, 1.0, 3.0) and header.set_spacing(g, (2.0, 2.0, 2.0)).cell_volume == 8.0
    assert header.copy_header(flipped, g, origin=False).direction == flipped.direction and header.align_origin(g, (1.0, 0.0, 0.0)).origin[0] == pytest.approx(2.234)
    assert set(header.describe(g)) == {"origin", "spacing", "size", "direction"}
