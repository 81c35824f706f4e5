"""Hand-made grids and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import stats
from gridloom.grid import Geometry, ball, box, cross, numbered
from gridloom.operators import imageset, iterative, label, layout, models, neighborhood, pixel, regions, tensor, timeseries, transforms
from gridloom.sources import files


def image(spark, rows, name="v"):
    return spark.createDataFrame([(x, y, float(v)) for y, row in enumerate(rows) for x, v in enumerate(row)], f"x bigint, y bigint, {name} double")


def grid(df, name="v"):
    got = {(r["x"], r["y"]): r[name] for r in df.collect()}
    return [[got.get((x, y)) for x in range(max(k[0] for k in got) + 1)] for y in range(max(k[1] for k in got) + 1)]


def test_offsets():
    axes = ["x", "y"]
    assert len(box(axes, 1)) == 9 and len(cross(axes, 1)) == 5 and len(ball(axes, 2)) == 13


def test_scan_numbers(spark):
    df = image(spark, [[0] * 5] * 4).filter("(x + y) % 3 <> 0")
    want = {(x, y): i for i, (y, x) in enumerate((y, x) for y in range(4) for x in range(5) if (x + y) % 3)}
    assert {(r["x"], r["y"]): r["i"] for r in numbered(df).collect()} == want


def test_divide_carries_over_rows(spark):
    df = image(spark, [[1, 2], [3, 4], [5, 6]]).join(image(spark, [[0, 2], [0, 0], [5, 0]], "w"), ["x", "y"])
    assert grid(pixel.divide_carried(df), "out") == [[0.0, 1.0], [1.0, 1.0], [1.0, 1.0]]


def test_constant_image(spark):
    df = image(spark, [[3, 3], [3, 3]])
    assert grid(pixel.negate(df), "out") == [[-2.0, -2.0], [-2.0, -2.0]]
    assert grid(pixel.rescale(df, 1.0, 2.0), "out") == [[1.0, 1.0], [1.0, 1.0]]


def test_spike_morphology(spark):
    df = image(spark, [[0] * 5, [0] * 5, [0, 0, 9, 0, 0], [0] * 5, [0] * 5])
    assert sum(v == 9 for row in grid(neighborhood.gray_dilate(df)) for v in row) == 9
    assert sum(map(sum, grid(neighborhood.gray_open(df)))) == 0 and grid(neighborhood.gray_close(df)) == grid(df)
    ones = df.withColumn("v", (F.col("v") > 0).cast("double"))
    assert sum(map(sum, grid(neighborhood.binary_morphology(ones, "dilate", 2, "annulus")))) > 4
    smooth = grid(neighborhood.gaussian(df, 0.6))
    assert smooth[2][2] == max(map(max, smooth)) and smooth[1][2] == pytest.approx(smooth[2][1])


def test_ring_has_one_hole(spark):
    ring = [[0] * 5, [0, 1, 1, 1, 0], [0, 1, 0, 1, 0], [0, 1, 1, 1, 0], [0] * 5]
    df = image(spark, ring)
    assert sum(map(sum, grid(iterative.fill_holes(df, {"x": 5, "y": 5})))) == 9
    t = neighborhood.topology(df).first()
    assert (t["cells"], t["contacts"], t["euler"]) == (8, 8, 0)


def test_comb_components(spark):
    comb = [[1, 0, 1, 0, 1], [1, 0, 1, 0, 1], [1, 1, 1, 0, 1]]
    df = image(spark, comb).filter("v > 0")
    got = {(r["x"], r["y"]): r["label"] for r in iterative.label_clusters(df).collect()}
    assert {v for k, v in got.items() if k[0] < 3} == {1} and {v for k, v in got.items() if k[0] == 4} == {2}
    corner = image(spark, [[1, 0], [0, 1]]).filter("v > 0")
    assert iterative.label_clusters(corner).agg(F.max("label")).first()[0] == 2
    assert iterative.label_clusters(corner, full=True).agg(F.max("label")).first()[0] == 1
    spiral = image(spark, [[1] * 9, [0] * 8 + [1], [1] * 7 + [0, 1], [1] + [0] * 5 + [1, 0, 1], [1, 0, 1, 1, 1, 1, 1, 0, 1], [1] + [0] * 7 + [1], [1] * 9]).filter("v > 0")
    assert iterative.label_clusters(spiral).agg(F.max("label")).first()[0] == 1


@pytest.mark.parametrize("full", [False, True])
def test_components_across_tiles(spark, monkeypatch, full):
    """Random cells about the origin, some given twice, over several tiles: components are those of a flood, and few contacts are edges of the rounds."""
    r, edges = np.random.default_rng(2), []
    cells = sorted({(int(x) - 70, int(y) - 40) for x, y in zip(*np.nonzero(r.random((150, 90)) < (0.42 if full else 0.6)), strict=True)}, key=lambda p: p[::-1])
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (full or not (a and b))]
    at, want = set(cells), {}
    for p in cells:
        left = [] if p in want else [p]
        want.setdefault(p, p)
        while left:
            x, y = left.pop()
            for q in ((x + a, y + b) for a, b in steps):
                if q not in want and q in at:
                    want[q] = want[p]
                    left.append(q)
    rounds = iterative._least_reachable
    monkeypatch.setattr(iterative, "_least_reachable", lambda e: edges.append(e.count()) or rounds(e))
    df = spark.createDataFrame(cells + cells[:50], "x int, y long")
    got = iterative.connected_components(df, full).collect()
    assert len(got) == len(cells) and {(c["x"], c["y"]): (c["component"]["x"], c["component"]["y"]) for c in got} == want
    assert edges[0] < len(cells) / 10


def test_distance_against_all_pairs(spark):
    r = np.random.default_rng(1)
    v = (r.random((9, 11)) < 0.1).astype(float)
    got = np.array(grid(iterative.distance_map(image(spark, v), spacing=(1.0, 2.0))))
    ys, xs = np.nonzero(v)
    for y in range(9):
        for x in range(11):
            assert got[y, x] == pytest.approx(min(math.hypot(x - a, 2 * (y - b)) for a, b in zip(xs, ys, strict=True)))
    assert iterative.distance_map(image(spark, [[0, 0]])).first()["v"] is None


def test_checkerboard_entropy(spark):
    df = image(spark, [[(x + y) % 2 for x in range(4)] for y in range(4)])
    corner = neighborhood.neighborhood_entropy(df, 1).filter("x = 0 AND y = 0").first()["entropy"]
    assert corner == pytest.approx(math.log(2))


def test_monotone_ramp_has_its_minimum(spark):
    r = label.min_max_mean(image(spark, [[1, 2, 3, 4]]), Geometry(size=(4, 1))).first()
    assert (r["min"], r["max"], r["mean"]) == (1.0, 4.0, 2.5)


def test_vote_tie_goes_to_the_first_to_reach_it(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 1, 3), (0, 2, 3), (0, 3, 5)], "x bigint, image bigint, label bigint")
    assert imageset.majority_vote(df).first()["label"] == 3
    three = df.filter("image < 2")
    assert imageset.majority_vote(three).first()["label"] == 5
    assert not imageset.majority_vote(three, fraction=0.6).first()["decided"]


def test_alternating_series(spark):
    for n in (6, 7):
        s = spark.createDataFrame([(0, t, float(t * t)) for t in range(n)], "x bigint, t bigint, v double")
        assert timeseries.split_alternating(s, True, n).count() == n // 2 == timeseries.split_alternating(s, False, n).count()
        assert timeseries.simple_subtraction(s).count() == n // 2


def test_tensor_quirks(spark):
    rows = [(0, [3.0, 0.0, 0.0, 2.0, 0.0, 1.0]), (1, [2.0, 1.0, 0.0, 2.0, 0.0, 1.0]), (2, [1.0, 2.0, 0.0, 1.0, 0.0, 0.5]), (3, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id bigint, t array<double>")
    assert [r["out"] for r in tensor.axial(df).orderBy("id").collect()][:2] == [0.0, pytest.approx(3.0)]
    e = tensor.with_eigenvalues(df).orderBy("id").collect()
    for (_, t), r in zip(rows, e, strict=True):
        m = np.array([[t[0], t[1], t[2]], [t[1], t[3], t[4]], [t[2], t[4], t[5]]])
        assert [r["e0"], r["e1"], r["e2"]] == pytest.approx(np.linalg.eigvalsh(m).tolist(), abs=1e-7)
    fa = [r["fa"] for r in tensor.fa(df).orderBy("id").collect()]
    assert fa[0] == pytest.approx(math.sqrt(1.5 * 2 / 14)) and 0 <= fa[2] <= 1 and fa[3] == 0


# Axes and degrees of the reference rotations.
@pytest.mark.parametrize("axis,degrees", [((1, 0, 0), 10), ((0, 1, 0), 35), ((0, 0, 1), -60), ((1, 1, 0), 80), ((1, -1, 1), 120), ((0.2, 0.5, -1), 179)])
def test_wahba_recovers_rotations(axis, degrees):
    r = transforms.rotation(axis, degrees)
    p = np.random.default_rng(2).normal(size=(20, 3))
    assert transforms.wahba((p @ r.T).T @ p) == pytest.approx(r, abs=1e-9)


def test_transform_text_round_trip():
    m = [[0.8, -0.6, 2.0], [0.6, 0.8, -1.0]]
    assert files.parse_transform(files.format_transform(m)) == m
    centred = "Parameters: 0 -1 1 0 0 0\nFixedParameters: 1 1\n"
    assert files.parse_transform(centred) == [[0.0, -1.0, 2.0], [1.0, 0.0, 0.0]]


def test_files_round_trip(spark, tmp_path):
    g = Geometry(size=(2, 2), spacing=(1.0, 2.0), origin=(5.0, 6.0))
    df = image(spark, [[1, 2], [3, 4]])
    files.write_image(df, g, f"{tmp_path}/image")
    back, h = files.read_image(spark, f"{tmp_path}/image")
    assert h == g and grid(back) == grid(df)
    values = np.arange(24, dtype=float).reshape(2, 3, 4)
    (tmp_path / "a.nii").write_bytes(files.nifti_bytes(values))
    got = {(r["x"], r["y"], r["z"]): r["v"] for r in files.read_nifti(spark, f"{tmp_path}/a.nii").collect()}
    assert got == {(x, y, z): values[x, y, z] for x in range(2) for y in range(3) for z in range(4)}
    (tmp_path / "p.txt").write_text("0 0 0 0\n1.5 2 9 3\n\n 4 5 0 1 \n")
    assert sorted(files.read_points(spark, f"{tmp_path}/p.txt", 2).collect()) == [(1.5, 2.0, 3), (4.0, 5.0, 1)]
    files.write_points(files.read_points(spark, f"{tmp_path}/p.txt", 2), f"{tmp_path}/q")
    assert sorted(files.read_points(spark, f"{tmp_path}/q", 2).collect()) == [(1.5, 2.0, 3), (4.0, 5.0, 1)]
    files.write_matrix(df, f"{tmp_path}/m")
    assert files.read_matrix(spark, f"{tmp_path}/m").agg(F.sum("v")).first()[0] == 10
    (tmp_path / "list.txt").write_text("a.nii\n\n b.nii\n")
    assert [r[0] for r in files.read_image_list(spark, f"{tmp_path}/list.txt").collect()] == ["a.nii", "b.nii"]


def test_t_distribution():
    # Two-sided five per cent points.
    for dof, t in ((1, 12.7062), (5, 2.5706), (30, 2.0423), (1000, 1.9623)):
        assert stats.t_cdf(np.array([t, -t, 0.0]), dof) == pytest.approx([0.975, 0.025, 0.5], abs=1e-4)


def test_histogram_match_reaches_the_reference(spark):
    r = np.random.default_rng(3)
    a, b = (spark.createDataFrame([(float(x),) for x in v], "v double") for v in (r.normal(size=3000), r.uniform(10, 20, 3000)))
    got = stats.match_histogram(a, b).agg(F.avg("out"), F.min("out"), F.max("out")).first()
    assert got[0] == pytest.approx(15, abs=0.3) and got[1] >= 9.9 and got[2] <= 20.1


def test_mixture_and_otsu_separate_two_levels(spark):
    r = np.random.default_rng(5)
    truth = np.arange(20)[:, None] * np.ones(20) > 9
    df = image(spark, np.where(truth, 10, 0) + r.normal(size=(20, 20)))
    for out in (label.otsu(df, 1), label.kmeans(df, 2)[0]):
        assert np.array_equal(np.array(grid(out, "out")) == 2, truth)
    got, classes = models.mixture(df, 2, 5, smooth=0.5)
    assert np.array_equal(np.array(grid(got, "label")) == 2, truth) and classes[0][1] == pytest.approx(0, abs=0.3)


def test_alignment(spark):
    bump = lambda dx, dy: image(spark, [[math.exp(-((x - 10 - dx) ** 2 + (y - 8 - dy) ** 2) / 12) for x in range(22)] for y in range(18)])
    assert models.register_translation(bump(0, 0), bump(2, -1), 3) == (2, -1)
    m = models.register_affine(bump(0, 0), bump(1.0, 0.5), 4)
    assert transforms_at(m, 10, 8) == pytest.approx((11.0, 8.5), abs=0.15)
    series = layout.replicate(bump(0, 0), "t", 2).union(bump(1, 0).select("x", "y", "v", F.lit(2).cast("bigint").alias("t")))
    assert [(r["t"], r["sx"], r["sy"]) for r in regions.motion_correct(series, 1).orderBy("t").collect()][2] == (2, 1, 0)


def transforms_at(m, x, y):
    return tuple(row[0] * x + row[1] * y + row[2] for row in m)


def test_staple_trusts_the_consistent_raters(spark):
    r = np.random.default_rng(6)
    truth = r.random(400) < 0.4
    rows = [(i, k, int(t ^ (r.random() < e))) for i, t in enumerate(truth) for k, e in enumerate((0.05, 0.05, 0.4))]
    p, quality = iterative.staple(spark.createDataFrame(rows, "x bigint, rater bigint, d int"), 3)
    q = {x["rater"]: x["sensitivity"] for x in quality.collect()}
    assert q[0] > 0.85 and q[1] > 0.85 and q[2] < 0.75
    got = {x["x"]: x["p"] > 0.5 for x in p.collect()}
    assert np.mean([got[i] == t for i, t in enumerate(truth)]) > 0.9


def test_random_samples_are_repeatable(spark):
    df = layout.make_image(spark, (10, 10)).withColumn("image", F.lit(1))
    a, b = (sorted(imageset.random_samples(df, 7, 3).select("x", "y").collect()) for _ in range(2))
    assert a == b and len(a) == 7


def test_tissue_labels_are_permuted(spark):
    rows = [(i, 0, (i % 3 + 1) % 3 + 1, *[1.0 if j == i % 3 else 0.0 for j in range(3)]) for i in range(30)]
    df = spark.createDataFrame(rows, "x bigint, y bigint, label bigint, p1 double, p2 double, p3 double")
    assert {(r["x"] % 3 + 1) == r["out"] for r in imageset.check_tissue_labels(df).collect()} == {True}
