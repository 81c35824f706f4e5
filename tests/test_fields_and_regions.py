"""Spatial mutual information, sparse correlation of label pairs, and streams written to a table."""

import numpy as np
import pytest

from gridloom.operators import label, timeseries
from gridloom.streaming import events


def entropy(a: np.ndarray, b: np.ndarray) -> float:
    _, n = np.unique(np.stack([a.ravel(), b.ravel()]), axis=1, return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log(p)).sum())


def test_spatial_mutual_information(spark):
    r = np.random.default_rng(2)
    a = r.integers(0, 5, (9, 7))
    b = (a + r.integers(0, 2, (9, 7))) % 5
    a[0, 0] = b[0, 1] = 4
    a[1, 1] = b[1, 0] = 0
    df = spark.createDataFrame([(x, y, float(a[x, y]), float(b[x, y])) for x in range(9) for y in range(7)], "x long, y long, v double, w double")
    up, left = (slice(None), slice(None, -1)), (slice(None, -1), slice(None))
    u_at, l_at = (slice(None), slice(1, None)), (slice(1, None), slice(None))
    inner_ur, inner_lu = (slice(None, -1), slice(1, None)), (slice(1, None), slice(1, None))
    want = 0.5 * (entropy(a[up], b[u_at]) + entropy(a[u_at], b[up]) + entropy(a[left], b[l_at]) + entropy(a[l_at], b[left])) - entropy(a, b)
    shifted = lambda m, dx, dy, at: np.roll(m, (-dx, -dy), (0, 1))[at]
    want -= 0.25 * (entropy(shifted(a, 0, -1, inner_ur), shifted(b, 1, 0, inner_ur)) + entropy(shifted(a, 1, 0, inner_ur), shifted(b, 0, -1, inner_ur)))
    want -= 0.25 * (entropy(shifted(a, -1, 0, inner_lu), shifted(b, 0, -1, inner_lu)) + entropy(shifted(a, 0, -1, inner_lu), shifted(b, -1, 0, inner_lu)))
    assert label.spatial_mutual_information(df, bins=5).first()["smi"] == pytest.approx(want)
    assert label.spatial_mutual_information(df.limit(0)).first()["smi"] is None


def test_sparse_correlation_of_label_pairs(spark):
    r = np.random.default_rng(5)
    common = r.standard_normal(40)
    sizes, rows, blocks, x = {1: 6, 2: 5, 3: 4}, [], {}, 0
    for k, n in sizes.items():
        block = r.standard_normal((n, 40))
        block[:2] += 2 * common * (k != 3)
        blocks[k] = block - block.mean(axis=1, keepdims=True)
        for line in block:
            rows += [(x, t, k, float(v)) for t, v in enumerate(line)] + [(x, 99, 0, 1.0), (x, 98, k, None)]
            x += 1

    def soft(z: np.ndarray, share: float) -> np.ndarray:
        keep = max(1, int(share * len(z) + 0.5))
        cut = np.sort(np.abs(z))[::-1][keep] if keep < len(z) else 0
        out = np.sign(z) * np.maximum(np.abs(z) - cut, 0)
        return out / np.linalg.norm(out)

    found, loadings = timeseries.region_sparse_cca(spark.createDataFrame(rows, "x long, t long, label long, v double"), 0.5, 0.4, 2)
    got = {(q["a"], q["b"]): q["r"] for q in found.collect()}
    for a, b in ((1, 2), (1, 3), (2, 3)):
        p, q = blocks[a], blocks[b]
        u = (p**2).sum(axis=1)
        u = u / np.linalg.norm(u)
        for _ in range(2):
            w = soft(q @ (p.T @ u), 0.4)
            u = soft(p @ (q.T @ w), 0.5)
        s, t = p.T @ u, q.T @ w
        assert got[a, b] == pytest.approx(s @ t / np.linalg.norm(s) / np.linalg.norm(t))
    assert got[1, 2] > 0.8 and loadings.filter("a = 1 AND b = 2 AND side = 'a'").count() == 3


def test_streams_end_in_a_table(spark, tmp_path):
    source = spark.range(20).selectExpr("timestamp_seconds(id * 3600) AS ts", "id % 3 AS event_id", "'k' AS event_type", "1.0D AS value", "id AS user_id")
    source.write.parquet(f"{tmp_path}/events.parquet")
    stream = events.read_events(spark, str(tmp_path))
    days = events.run_to_table(events.tumbling(stream), f"t-{tmp_path.name}")
    assert days.agg({"n": "sum"}).first()[0] == 20
    once = events.run_to_table(events.deduplicated(stream.withColumn("event_id", stream.event_id % 1), "30 days"), f"d-{tmp_path.name}", "append")
    assert once.count() == 1 and once.columns == stream.columns
    none = events.run_to_table(stream.filter("user_id < 0"), f"e-{tmp_path.name}", "append")
    assert none.count() == 0
