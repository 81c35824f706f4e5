"""Nearest neighbours and the kernels they shape, against all pairs."""

import numpy as np
import pytest

from gridloom.operators import neighbors


def brute(points: list[tuple], k: int) -> dict:
    out = {}
    for i, *p in points:
        far = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j) for j, *q in points if j != i)
        out[i] = far[:k]
    return out


@pytest.mark.parametrize("d", [1, 2, 3])
def test_nearest_are_those_of_all_pairs(spark, d):
    """A dense clump, a sparse rest, far strays and many copies of one place."""
    r = np.random.default_rng(d)
    places = [*r.normal(0, 0.01, (60, d)), *r.uniform(-5, 5, (60, d)), *[np.full(d, 400.0), np.full(d, -90.0)], *[np.full(d, 0.25)] * 30]
    points = [(3 * i, *map(float, p)) for i, p in enumerate(places)]
    names = ["a", "b", "c"][:d]
    df = spark.createDataFrame([*points, (None, *[0.0] * d), (7001, *[float("nan")] * d), (7002, *[None] * d)], "id long, " + ", ".join(f"{n} double" for n in names))
    want = brute(points, 4)
    got: dict = {}
    for q in neighbors.nearest(df, 4, names).collect():
        got.setdefault(q["id"], []).append((q["rank"], q["other"], q["d2"]))
    assert got.keys() == want.keys()
    for i, rows in got.items():
        assert [o for _, o, _ in sorted(rows)] == [j for _, j in want[i]] and [x for _, _, x in sorted(rows)] == pytest.approx([x for x, _ in want[i]])


def test_density_is_that_of_shaped_kernels(spark):
    r = np.random.default_rng(1)
    places = np.stack([np.linspace(0, 3, 40), np.sin(np.linspace(0, 3, 40))], 1) + r.normal(0, 0.02, (40, 2))
    points = [(i, *map(float, p)) for i, p in enumerate(places)]
    near, kernels = brute(points, 5), {}
    for i, rows in near.items():
        gaps = np.array([places[j] - places[i] for _, j in rows])
        kernels[i] = gaps.T @ gaps / 5 + 0.05**2 * np.eye(2)
    got = {q["id"]: q["density"] for q in neighbors.manifold_density(spark.createDataFrame(points, "id long, a double, b double"), 5, ["a", "b"], 0.05).collect()}
    for i, rows in near.items():
        each = [np.exp(-0.5 * g @ np.linalg.solve(kernels[j], g)) / (2 * np.pi * np.sqrt(np.linalg.det(kernels[j]))) for _, j in rows for g in [places[i] - places[j]]]
        assert got[i] == pytest.approx(np.mean(each))


def test_few_points(spark):
    schema = "id long, a double, b double"
    assert neighbors.nearest(spark.createDataFrame([], schema), 3, ["a", "b"]).count() == 0
    assert neighbors.nearest(spark.createDataFrame([(1, 0.0, 0.0)], schema), 3, ["a", "b"]).count() == 0
    two = neighbors.nearest(spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 0.0)], schema), 3, ["a", "b"]).collect()
    assert sorted((q["id"], q["other"], q["d2"]) for q in two) == [(1, 2, 81.0), (2, 1, 81.0)]


def test_a_density_searches_neighbours_once(spark, monkeypatch):
    calls, real = [], neighbors.nearest
    monkeypatch.setattr(neighbors, "nearest", lambda *a: (calls.append(1), real(*a))[1])
    points = spark.range(30).selectExpr("id", "CAST(id % 5 AS double) AS a", "CAST(id div 5 AS double) AS b")
    assert neighbors.manifold_density(points, 3, ["a", "b"], 0.1).count() == 30 and len(calls) == 1
