"""Decompositions without a matrix of products, against NumPy on the whole matrix."""

import numpy as np
import pytest

from gridloom.operators import wide


def cells(spark, m: np.ndarray):
    """Entries of m in rows and columns far apart."""
    return wide.entries(spark.createDataFrame([(37 * i, r.tolist()) for i, r in enumerate(m)], "id long, v array<double>"), "id", "v")


def soft(z: np.ndarray, share: float) -> np.ndarray:
    keep = max(1, round(share * len(z)))
    cut = np.sort(np.abs(z))[::-1][keep] if keep < len(z) else 0
    out = np.sign(z) * np.maximum(np.abs(z) - cut, 0)
    return out / np.linalg.norm(out)


def dense(loadings, n: int, mark: str, value) -> np.ndarray:
    out = np.zeros(n)
    for r in loadings.collect():
        if r[mark] == value:
            out[r["col"]] = r["loading"]
    return out


@pytest.fixture(scope="module")
def views():
    r = np.random.default_rng(3)
    z = r.standard_normal((50, 2))
    x = r.standard_normal((50, 24)) + r.standard_normal((50, 1)) * np.linspace(0, 1, 24) + 3
    y = x[:, :10] / 2 + r.standard_normal((50, 10))
    x[:, :5] += z[:, :1]
    y[:, :5] += 2 * z[:, :1]
    return x, y, z


def test_sparse_svd_is_that_of_the_covariance(spark, views):
    x = views[0]
    variances, loadings = wide.sparse_svd(wide.wide(cells(spark, x)), 2, 0.25, 3)
    c = np.cov(x.T, bias=True)
    start = np.diag(c) / np.linalg.norm(np.diag(c))
    for k in range(2):
        v = start
        for _ in range(3):
            v = soft(c @ v, 0.25)
        v = v * np.sign(v[np.abs(v).argmax()])
        assert np.isclose(variances[k], v @ c @ v, rtol=1e-9) and np.allclose(dense(loadings, 24, "component", k), v, atol=1e-9)
        c = c - (v @ c @ v) * np.outer(v, v)


@pytest.mark.parametrize("with_given", [False, True])
def test_sparse_cca_is_that_of_the_residuals(spark, views, with_given):
    x, y, z = views
    given = cells(spark, z) if with_given else None
    r, loadings = wide.sparse_cca(wide.wide(cells(spark, x), given), wide.wide(cells(spark, y), given), 0.25, 0.5, 2)
    g = np.hstack([np.ones((50, 1)), z]) if with_given else np.ones((50, 1))
    a, b = (m - g @ np.linalg.lstsq(g, m, rcond=None)[0] for m in (x, y))
    u = np.var(x, axis=0) / np.linalg.norm(np.var(x, axis=0))
    for _ in range(2):
        v = soft(b.T @ (a @ u), 0.5)
        u = soft(a.T @ (b @ v), 0.25)
    assert np.isclose(r, np.corrcoef(a @ u, b @ v)[0, 1], atol=1e-9)
    assert np.allclose(dense(loadings, 24, "side", "x"), u, atol=1e-9) and np.allclose(dense(loadings, 10, "side", "y"), v, atol=1e-9)


def test_many_columns(spark):
    """150,000 columns, few entries a row, some given twice or null: the planted columns come out."""
    r, rows = np.random.default_rng(1), []
    for i in range(300):
        score = r.standard_normal()
        rows += [(i, 1000 * k + 17, 5.0 * score + 0.1 * r.standard_normal()) for k in range(6)]
        rows += [(i, int(c), float(v)) for c, v in zip(r.integers(0, 150000, 400), r.standard_normal(400), strict=True)]
        rows += [(i, 7, None), (i, 17, 0.0)]
    m = wide.wide(spark.createDataFrame(rows, "row long, col long, value double"))
    assert m.n == 300 and m.columns > 80000
    variances, loadings = wide.sparse_svd(m, 1, 6 / m.columns, 3)
    assert sorted(x["col"] for x in loadings.collect()) == [1000 * k + 17 for k in range(6)] and 120 < variances[0] < 190


def test_thresholds(spark):
    values = [3.0, -5.0, 0.0, 1.0, 2.0, 2.0, -2.0, 9.0, -1e-300, float(1 << 60)]
    v = spark.createDataFrame([(0, values[:5]), (1, values[5:])], "b long, w array<double>")
    want = sorted(map(abs, values), reverse=True)
    for few in (0, 3, 100):
        assert [wide.kth_largest(v, k, 10, few) for k in range(1, 12)] == [*want, 0.0]
    kept = lambda **a: [x for r in wide.thresholded(v, 10, 0.4, **a).orderBy("b").collect() for x in r["w"]]
    assert kept() == [1.0, -3.0, 0, 0, 0, 0, 0, 7.0, 0, float(1 << 60) - 2] and kept(hard=True) == [3.0, -5.0, 0, 0, 0, 0, 0, 9.0, 0, float(1 << 60)]


def test_without_variance(spark):
    flat = wide.wide(spark.createDataFrame([(i, j, 2.0) for i in range(4) for j in range(3)], "row long, col long, value double"))
    variances, loadings = wide.sparse_svd(flat, 2, 0.5, 2)
    assert variances == [0.0, 0.0] and loadings.count() == 0


def test_a_product_moves_blocks_not_tiles(spark, monkeypatch):
    """Rows over more blocks than are broadcast: a round shuffles less than a tenth of the entries, and its result is that of NumPy."""
    monkeypatch.setattr(wide, "NEAR", 2, raising=False)
    x = np.random.default_rng(5).standard_normal((3000, 64))
    m = wide.wide(wide.entries(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>"), "id", "v"))
    status = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        found = status.executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    v, along = wide._start(m)
    v.count()
    before = written()
    z = wide.product(m, m, v, along).collect()
    assert written() - before < 16 * x.size / 10
    start = np.var(x, axis=0) / np.linalg.norm(np.var(x, axis=0))
    assert np.allclose(z[0]["w"][:64], np.cov(x.T, bias=True) @ start, atol=1e-9)
