"""Operators of fields, splines, fronts, points and mixtures against brute force on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import tables
from gridloom.operators import bias, fronts, imageset, mixture, models, neighborhood, pixel, points, sparse, spline, surface, tensor, transforms
from gridloom.plans import dispatch, pipelines
from gridloom.sources import files


def image(spark, values):
    return spark.createDataFrame([(x, y, float(v)) for y, row in enumerate(values) for x, v in enumerate(row)], "x bigint, y bigint, v double")


@pytest.mark.parametrize("tile", [2, 5, 64])
def test_fronts_are_shortest_paths(spark, tile):
    """Against relaxing all cells until nothing changes, over tiles of several sizes, with walls."""
    r = random.Random(tile)
    cells = {(x, y): r.choice([0.5, 1.0, 4.0]) for x in range(11) for y in range(7) if r.random() < 0.8}
    seeds = {(0, 0): 2, (10, 6): 1, (5, 3): 1}
    seeds = {p: k for p, k in seeds.items() if p in cells}
    want = {p: (0.0, k) for p, k in seeds.items()}
    for _ in range(len(cells)):
        for (x, y), s in cells.items():
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in want:
                    new = (want[q][0] + (s + cells[q]) / 2, want[q][1])
                    want[x, y] = min(want.get((x, y), (math.inf, 0)), new)
    df = spark.createDataFrame([(*p, s) for p, s in cells.items()], "x bigint, y bigint, s double")
    start = spark.createDataFrame([(*p, 0.0, k) for p, k in seeds.items()], "x bigint, y bigint, time double, tag bigint")
    got = {(q["x"], q["y"]): (q["time"], q["tag"]) for q in fronts.travel(df, start, tile=tile).collect()}
    assert got == want
    near = {(q["x"], q["y"]) for q in fronts.travel(df, start, 3.0, tile).collect()}
    assert near == {p for p, (t, _) in want.items() if t <= 3}


def test_divide_carries_in_three_axes(spark):
    r = random.Random(1)
    rows = [(x, y, z, float(r.randint(1, 9)), float(r.choice([0, 0, 2]))) for z in range(3) for y in range(4) for x in range(5)]
    held, want = 0.0, {}
    for x, y, z, a, b in rows:
        held = a / b if b > 0 else held
        want[x, y, z] = held
    got = pixel.divide_carried(spark.createDataFrame(rows, "x bigint, y bigint, z bigint, v double, w double"))
    assert {(q["x"], q["y"], q["z"]): q["out"] for q in got.collect()} == want


def test_box_passes_equal_scattered_cells(spark):
    """Full images go axis by axis, images with holes cell by cell; both are the same on what they share."""
    r = random.Random(2)
    full = image(spark, [[r.random() for _ in range(9)] for _ in range(8)])
    rows = {(q["x"], q["y"]): q["v"] for q in full.collect()}
    holes = full.filter("NOT (x = 4 AND y = 4)")
    for df, cells in ((full, rows), (holes, {p: v for p, v in rows.items() if p != (4, 4)})):
        assert neighborhood.is_full(df) == (df is full)
        around = {p: [cells[q] for q in cells if abs(q[0] - p[0]) <= 2 and abs(q[1] - p[1]) <= 2] for p in cells}
        got = {(q["x"], q["y"]): q for q in neighborhood.neighborhood_stats(df, 2).collect()}
        assert all(np.allclose([got[p][c] for c in ("n", "mean", "min", "max", "variance")], [len(a), np.mean(a), min(a), max(a), np.var(a, ddof=1)]) for p, a in around.items())
        assert {(q["x"], q["y"]): q["v"] for q in neighborhood.gray_dilate(df, 2).collect()} == {p: max(a) for p, a in around.items()}


def test_lipschitz_against_all_pairs(spark):
    r = random.Random(3)
    df = image(spark, [[r.random() * (20 if (x, y) == (1, 9) else 1) for x in range(14)] for y in range(11)])
    cells = {(q["x"], q["y"]): q["v"] for q in df.collect()}
    want = {p: max(abs(v - w) / math.dist(p, q) for q, w in cells.items() if q != p) for p, v in cells.items()}
    field = df.select("x", "y", F.col("v").alias("ux"), F.lit(0.0).alias("uy"))
    got = {(q["x"], q["y"]): q["v"] for q in transforms.lipschitz_all(field, 4).collect()}
    assert all(abs(got[p] - w) < 1e-12 for p, w in want.items())


def test_spline_reads_and_fits(spark):
    r = np.random.default_rng(4)
    pts = r.uniform(0, 10, (300, 2))
    smooth = lambda p: np.sin(p[:, 0] / 3) + p[:, 1] / 5
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(pts, smooth(pts), strict=True)], "a double, b double, c double")
    one = spline.fit(df, ["a", "b"], ["c"], (0.0, 0.0), (10.0, 10.0), (4, 4), 1)
    more = spline.fit(df, ["a", "b"], ["c"], (0.0, 0.0), (10.0, 10.0), (4, 4), 4)
    miss = lambda s: np.abs(s.at(pts)[:, 0] - smooth(pts)).max()
    assert miss(more) < 0.3 * miss(one) and miss(more) < 0.15
    read = df.withColumn("f", more.column([F.col("a"), F.col("b")])[0]).toPandas()
    assert np.allclose(np.sort(read["f"]), np.sort(more.at(pts)[:, 0]))
    with pytest.raises(ValueError):
        spline.fit(df, ["a", "b"], ["c"], (0.0, 0.0), (10.0, 10.0), (4000, 4000))


def test_spline_coefficients_pass_through(spark):
    line = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6])], "x bigint, v double")
    c = [q["c"] for q in spline.coefficients(line).orderBy("x").collect()]
    full = [c[1], *c, c[-2]]
    assert np.allclose([(full[i] + 4 * full[i + 1] + full[i + 2]) / 6 for i in range(8)], [3, 1, 4, 1, 5, 9, 2, 6])


def test_histogram_sharpening_moves_values_to_their_peaks():
    counts = np.zeros(200)
    for centre in (60, 140):
        counts += 1000 * np.exp(-((np.arange(200) - centre) ** 2) / (2 * 8**2))
    e = bias.sharpened(counts, 1.0, 12.0, 0.01)
    assert 52 < e[52] < 60 and 60 < e[68] < 68 and abs(e[60] - 60) < 1


def test_grubbs_and_boxplot(spark):
    r = random.Random(5)
    values = [r.gauss(0, 1) for _ in range(200)] + [40.0, -35.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "x bigint, v double")
    out = [q["x"] for q in mixture.grubbs(df).filter("out IS NULL").collect()]
    assert sorted(out) == [200, 201]
    assert mixture.grubbs(df.filter("x < 5")).filter("out IS NULL").count() == 0
    trimmed = {q["x"] for q in mixture.boxplot(df, how="trim").filter("out IS NULL").collect()}
    assert {200, 201} <= trimmed and len(trimmed) < 12


def test_mixture_ties_and_priors(spark):
    df = image(spark, [[0.0] * 5 + [10.0] * 5 for _ in range(4)])
    labels, classes = mixture.segment(df, ["v"], mixture.Options(classes=2, rounds=2))
    got = {(q["x"], q["y"]): q["label"] for q in labels.collect()}
    assert all(got[x, y] == (1 if x < 5 else 2) for x, y in got) and classes.weight == pytest.approx([0.5, 0.5])
    sure = df.filter("x = 0").select("x", "y", F.lit(2).alias("label"), F.lit(1.0).alias("p"))
    pinned = mixture.segment(df, ["v"], mixture.Options(classes=2, rounds=1, prior_weight=0.1, posterior="plato"), sure)[0]
    assert {q["label"] for q in pinned.filter("x = 0").collect()} == {2}


def test_joint_fusion_against_plain_weights(spark):
    """Each cell's weights from the patch errors of its box, solved one by one."""
    r = np.random.default_rng(6)
    target, atlases = r.random((4, 5)), r.random((3, 4, 5))
    labels = (r.random((3, 4, 5)) > 0.5).astype(int)
    rows = [(k, x, y, float(atlases[k, y, x]), int(labels[k, y, x])) for k in range(3) for y in range(4) for x in range(5)]
    got = models.joint_fusion(image(spark, target), spark.createDataFrame(rows, "image int, x bigint, y bigint, v double, label bigint"))
    got = {(q["x"], q["y"]): q["label"] for q in got.collect()}
    e = np.abs(atlases - target)
    for y in range(4):
        for x in range(5):
            box = e[:, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].reshape(3, -1)
            w = np.linalg.solve((box @ box.T) ** 2.0 + 0.1 * np.eye(3), np.ones(3))
            vote = {c: w[labels[:, y, x] == c].sum() for c in set(labels[:, y, x])}
            assert got[x, y] == max(vote, key=vote.get)


def test_points(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, r.uniform(0, 5), r.uniform(0, 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, px double, py double")
    got = {}
    for q in points.neighbours(df, df, 3, 1.0).collect():
        got.setdefault(q["id"], []).append((q["rank"], q["to"]))
    for i, x, y in rows:
        near = sorted((round(math.hypot(x - a, y - b), 9), j) for j, a, b in rows if math.hypot(x - a, y - b) <= 1)[:3]
        assert [t for _, t in sorted(got[i])] == [j for _, j in near]
    same = points.jhct(df, df.withColumn("id", F.col("id") + 100), 0.5).first()["metric"]
    apart = points.jhct(df, df.withColumn("px", F.col("px") + 50), 0.5).first()["metric"]
    assert abs(same) < 1e-9 and apart > 0.01
    text = files.vtk_points_text([(0.0, 1.0, 2.0, 3), (4.5, 5.0, 6.0, 7)])
    path = tmp_path / "p.vtk"
    path.write_text(text)
    read = [tuple(q)[1:] for q in files.read_vtk_points(spark, str(path)).orderBy("id").collect()]
    assert read == [(0, 0.0, 1.0, 2.0, 3), (1, 4.5, 5.0, 6.0, 7)]
    import struct

    binary = b"# vtk DataFile Version 2.0\np\nBINARY\nDATASET POLYDATA\nPOINTS 1 float\n" + struct.pack(">3f", 1.5, 2.5, 3.5) + b"\nPOINT_DATA 1\nSCALARS l int 1\nLOOKUP_TABLE default\n" + struct.pack(">i", 9) + b"\n"
    (tmp_path / "b.vtk").write_bytes(binary)
    assert tuple(files.read_vtk_points(spark, str(tmp_path / "b.vtk")).first())[1:] == (0, 1.5, 2.5, 3.5, 9)


def test_tensors_turn_and_keep_their_eigenvalues(spark):
    r = np.random.default_rng(8)
    rows = []
    for i in range(20):
        q, _ = np.linalg.qr(r.normal(size=(3, 3)))
        t = q @ np.diag([1.0, 2.0, 5.0]) @ q.T
        rows.append((i, [float(t[a, b]) for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))], r.normal(size=9).tolist()))
    df = spark.createDataFrame(rows, "id int, t array<double>, j array<double>")
    got = tensor.with_eigenvalues(df.withColumn("t", tensor.reorient("t", "j"))).toPandas()
    assert np.allclose(got[["e0", "e1", "e2"]], [[1, 2, 5]] * 20, atol=1e-6)
    turn = df.select(F.slice("j", 1, 3).alias("a"), F.transform(F.slice("j", 1, 3), lambda x: -x).alias("b")).withColumn("r", tensor.rotation_between("a", "b"))
    for q in turn.collect():
        m = np.reshape(q["r"], (3, 3))
        assert np.allclose(m @ q["a"], q["b"]) and np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) > 0


def test_transform_stacks_and_polar():
    a = np.array([[0.0, -2.0], [3.0, 0.0]])
    r, s = transforms.polar(a)
    assert np.allclose(r @ s, a) and np.allclose(r @ r.T, np.eye(2)) and np.allclose(s, s.T)
    stack = [[[1.0, 0.5, 2.0], [0.0, 1.0, -1.0]], [[2.0, 0.0, 0.0], [0.0, 2.0, 3.0]]]
    assert np.allclose(files.parse_transforms(files.format_transforms(stack)), stack)


def test_sparse_directions():
    r = np.random.default_rng(9)
    x = r.normal(size=(400, 6)) @ np.diag([3, 1, 1, 0.5, 0.2, 0.1])
    cov = np.cov(x.T, bias=True)
    top = np.linalg.eigvalsh(cov)[-1]
    assert abs(-sparse.energy(cov, sparse.power(cov, 500)) - top) < 1e-6
    assert abs(-sparse.energy(cov, sparse.conjugate(cov)) - top) < 0.02 * top
    assert np.count_nonzero(sparse.power_sparse(cov, 2)) == 2 and np.count_nonzero(sparse.greedy(cov, 3)) == 3
    assert sparse.reconstruct(cov, 6)[2] < 1e-9 < sparse.reconstruct(cov, 2)[2]
    grid = np.array([[1, 1, 0, 0], [0, 0, 0, 2], [3, 0, 0, 2]], float)
    assert sparse.clusters(grid.ravel(), (3, 4), 2).reshape(3, 4).tolist() == [[1, 1, 0, 0], [0, 0, 0, 2], [0, 0, 0, 2]]
    assert np.allclose(sparse.mass(np.array([5.0, -3.0, 2.0]), 0.8), [5, -3, 0])


def test_topological_numbers(spark):
    rows = ["....", ".##.", "..#.", "...."]
    df = image(spark, [[c == "#" for c in row] for row in rows])
    got = {(q["x"], q["y"]): q["number"] for q in surface.topological_numbers(df).collect()}
    assert got == {(1, 1): 1, (2, 1): 1, (2, 2): 1}
    line = image(spark, [[1, 1, 1, 1, 1]])
    assert [q["number"] for q in surface.topological_numbers(line).orderBy("x").collect()] == [1, 2, 2, 2, 1]


def test_noise_and_samples_are_the_same_on_any_partitioning(spark):
    df = image(spark, [[1.0] * 20 for _ in range(20)])
    a, b = (pixel.add_noise(df.repartition(n), "gaussian", 3).orderBy("y", "x").toPandas() for n in (1, 7))
    assert a.equals(b) and abs(a["out"].mean() - 1) < 0.2 and 0.85 < a["out"].std() < 1.15
    s = tables.sample(spark.range(2000), 0.25, 1, ["id"])
    assert 400 < s.count() < 600 and s.repartition(5).count() == s.count()
    many = df.withColumn("image", F.lit(1))
    assert imageset.random_samples(many.repartition(6), 4, 1).count() == 4


def test_moments_add_up(spark):
    r = np.random.default_rng(10)
    x = r.normal(size=(300, 5))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "values array<double>").repartition(9)
    n, total, outer = models.moments(df)
    assert n == 300 and np.allclose(total, x.sum(0)) and np.allclose(outer, x.T @ x)
    assert models.moments(df.filter("false"))[0] == 0


def test_studies(spark):
    one = image(spark, [[math.exp(-((x - 6) ** 2) / 8 - (y - 3) ** 2 / 8) for x in range(14)] for y in range(7)])
    two = one.withColumn("x", F.col("x") + 1)
    both = pipelines.slice_by_slice(one, "y", lambda s: s.withColumn("v", F.col("v") * 2))
    assert both.join(one.withColumnRenamed("v", "w"), ["x", "y"]).filter("abs(v - 2 * w) > 1e-12").count() == 0
    field, warped = pipelines.pairwise(one, two, "translation")
    row = warped.withColumnRenamed("v", "w").join(one, ["x", "y"]).filter("x < 13").agg(F.max(F.abs(F.col("v") - F.col("w")))).first()
    assert row[0] < 0.05
    net = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "u bigint, v bigint")
    ranks = points.network_measures(net, 20).collect()
    assert all(abs(q["rank"] - 0.25) < 1e-9 and q["degree"] == 2 for q in ranks)


def test_dispatch_of_new_names(spark):
    one = image(spark, [[1.0, 2.0], [3.0, 4.0]])
    assert dispatch.run("nvols", one.withColumn("t", F.lit(0))).first()["n"] == 1
    assert dispatch.run("SurfaceCurvature", one).count() == 4
    assert {"SyN", "BSplineSyN", "MixtureSegmentation", "N4BiasFieldCorrection", "TensorFANumerator"} <= set(dispatch.OPERATIONS)


def test_lipschitz_all_asks_near_tiles_and_reaches_far_ones(spark):
    """A flat stretch finds a spike forty tiles off, and cells aren't held against every tile."""
    value = {x: 1000.0 if x == 170 else float(x % 2) if x >= 12 else 0.0 for x in range(180)}
    field = spark.createDataFrame([(x, 0, v, 0.0) for x, v in value.items()], "x bigint, y bigint, ux double, uy double")
    out = transforms.lipschitz_all(field, 4)
    got = {q["x"]: q["v"] for q in out.collect()}
    assert got == {x: max(abs(value[x] - value[z]) / abs(x - z) for z in value if z != x) for x in value}
    assert "NestedLoopJoin BuildRight, Inner, (" not in out._jdf.queryExecution().toString()


def test_registered_images_are_not_broadcast(spark):
    from gridloom.plans.queries_fields import _side_by_side

    cells = spark.range(20).select(F.col("id").alias("x"), F.lit(0).alias("y"), F.col("id").cast("double").alias("v"))
    out = _side_by_side(cells, cells.withColumnRenamed("v", "m"), cells)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 20
