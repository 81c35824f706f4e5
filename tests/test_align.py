"""Alignment: planted maps in two and three dimensions come back as numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import align

N = 20
_r = np.random.default_rng(0)
BLOBS = [(_r.uniform(3, N - 4, 3), _r.uniform(1.8, 3.5), _r.uniform(1, 3)) for _ in range(12)]
MIDDLE = (N - 1) / 2


def volume(m: np.ndarray, key: int | None = None, gain: float = 1.0, offset: float = 0.0) -> list[tuple]:
    """A smooth field seen through a map, in as many dimensions as the map has; two are the plane through the middle."""
    d = len(m)
    grid = np.stack(np.meshgrid(*[np.arange(N)] * d, indexing="ij"), -1).reshape(-1, d)
    p = grid @ m[:, :d].T + m[:, d]
    p = p if d == 3 else np.hstack([p, np.full((len(p), 1), MIDDLE)])
    v = gain * sum(a * np.exp(-((p - c) ** 2).sum(-1) / (2 * w * w)) for c, w, a in BLOBS) + offset
    return [(() if key is None else (key,)) + tuple(map(int, c)) + (float(x),) for c, x in zip(grid, v, strict=True)]


def frame(spark, rows: list[tuple], d: int, key: str = ""):
    return spark.createDataFrame(rows, (f"{key} long, " if key else "") + "x long, y long, " + ("z long, " if d == 3 else "") + "v double")


def about(a: np.ndarray, shift: list[float]) -> np.ndarray:
    c = np.full(len(a), MIDDLE)
    return np.hstack([a, (c - a @ c + shift)[:, None]])


TURN = align.rotation([0.1, -0.15, 0.2])


@pytest.mark.parametrize(("kind", "a"), [("rigid", TURN), ("similarity", 1.06 * TURN), ("affine", TURN @ np.diag([1.06, 0.95, 1.0]))])
def test_three_dimensions(spark, kind, a):
    planted = about(a, [1.2, -0.7, 0.4])
    got = align.align(frame(spark, volume(planted), 3), frame(spark, volume(np.eye(3, 4)), 3), kind)
    corners = np.array([[x, y, z, 1] for x in (0, N - 1) for y in (0, N - 1) for z in (0, N - 1)], float)
    assert np.abs(corners @ (got.maps[0] - planted).T).max() < 0.1
    assert got.parameters(0)[:3] == pytest.approx([1.2, -0.7, 0.4], abs=0.05) and got.metric[0][1] < got.metric[0][0] / 50
    if kind != "affine":
        assert got.parameters(0)[3:6] == pytest.approx([0.1, -0.15, 0.2], abs=0.01)
    if kind == "similarity":
        assert got.parameters(0)[6] == pytest.approx(math.log(1.06), abs=0.01)


def test_a_share_of_the_cells_and_another_contrast(spark):
    planted = about(align.rotation([0.12]), [0.8, -0.5])
    fixed = frame(spark, volume(np.eye(2, 3)), 2)
    moving = frame(spark, volume(planted, gain=1.7, offset=4.0), 2)
    got = align.align(moving, fixed, "rigid", photometric=True, share=0.5)
    assert got.parameters(0) == pytest.approx([0.8, -0.5, 0.12], abs=0.05)


def test_all_volumes_of_a_series(spark):
    shifts = [(0.0, 0.0), (0.3, -0.2), (0.75, 0.4), (-0.5, 1.25)]
    series = frame(spark, [r for t, s in enumerate(shifts) for r in volume(about(np.eye(2), list(s)), t)], 2, "t")
    fixed = frame(spark, volume(np.eye(2, 3)), 2)
    got = align.motion_correction(series, fixed, "translation")
    for t, s in enumerate(shifts):
        assert got.parameters(t) == pytest.approx(s, abs=0.05)
    table = got.table(spark).toPandas()
    assert table.columns.tolist() == ["t", "before", "after", "p0", "p1"] and (table.after[1:] < table.before[1:] / 10).all()
    back = align.resampled(series, got, "t").join(fixed.withColumnRenamed("v", "f"), ["x", "y"]).groupBy("t").agg(F.max(F.abs(F.col("v") - F.col("f"))).alias("e")).collect()
    assert len(back) == 4 and max(r["e"] for r in back) < 0.12
    free = align.motion_correction(series, None, "translation")
    for t, s in enumerate(shifts):
        assert np.array(free.parameters(t)) - free.parameters(0) == pytest.approx(s, abs=0.05)


def test_slices_follow_a_course(spark):
    """Each slice is shifted along a parabola; one holds no image and takes the others' course."""
    course = {z: (0.02 * (z - 3) ** 2, 0.1 * z - 0.3) for z in range(7)}
    rows = [(z, x, y, v if z != 5 else 1.0) for z, s in course.items() for x, y, v in volume(about(np.eye(2), list(s)))]
    moving = spark.createDataFrame(rows, "z long, x long, y long, v double")
    fixed = spark.createDataFrame([(z, *r) for z in course for r in volume(np.eye(2, 3))], "z long, x long, y long, v double")
    got = align.slice_regularised(moving, fixed, 2, steps=12)
    assert max(abs(a - b) for z in course if z != 5 for a, b in zip(got.parameters(z), course[z], strict=True)) < 0.25
    shifts = np.array([got.parameters(z) for z in range(7)])
    assert np.abs(np.diff(shifts, 3, axis=0)).max() < 1e-9


def test_a_large_turn_needs_a_search(spark):
    planted = about(align.rotation([math.radians(150)]), [1.0, 2.0])
    moving, fixed = frame(spark, volume(planted), 2), frame(spark, volume(np.eye(2, 3)), 2)
    assert align.searched(moving, fixed).parameters(0) == pytest.approx([1.0, 2.0, math.radians(150)], abs=0.03)
    assert abs(align.align(moving, fixed).parameters(0)[2] - math.radians(150)) > 1


def test_edge_cases(spark):
    fixed = frame(spark, volume(np.eye(2, 3)), 2)
    flat = fixed.withColumn("v", F.lit(2.0))
    assert align.align(flat, fixed).parameters(0) == pytest.approx([0, 0, 0])
    far = fixed.withColumn("x", F.col("x") + 1000)
    assert align.align(far, fixed).parameters(0) == pytest.approx([0, 0, 0]) and math.isnan(align.align(far, fixed).metric[0][1])
    assert align.align(fixed.filter(F.lit(False)), fixed).maps == {}
    with pytest.raises(ValueError, match="kind"):
        align.align(fixed, fixed, "elastic")
