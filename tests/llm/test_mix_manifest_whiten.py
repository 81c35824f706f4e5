"""Mixing, manifests and whitening against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import manifest, mixing, whitening

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, size int, key string, rank int, grp string, k long"


def corpus(n: int, seed: int) -> list[tuple]:
    """Rows with null fields, repeated keys, equal rows and texts of every length, and columns named as the operators' own."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = r.choice([None, "", " x \t y\n", "w1 " * i, "word " * r.randint(1, 50), "é\xa0ü $5"])
        rows.append((r.choice([i, i, i - 700, None, 5, 2**62 - i, i - 2**63]), r.choice(["a", "b", "b", "b", "B", "é", None]), r.choice(["en", "en", "de", "é", None]), r.choice([None, i, 2**63 - 1]), text, -1, "x", 3, "g", 4))
    return rows + [(77, "b", "en", 3, "hot hot hot", -1, "x", 3, "g", 4)] * (n // 2)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(400, 2), DOCS)


def rounded(rows) -> list[tuple]:
    return sorted(((k, n, s, round(t, 6), x) for k, n, s, t, x in rows), key=str)


def test_mix_is_its_brute_force(spark, docs):
    got = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(docs).collect()]
    assert rounded(got) == rounded(mixing.brute_force([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]))
    assert all(0 <= x <= 2 * n for _, n, _, _, x in got)
    again = [tuple(r) for r in mixing.mix(docs.repartition(3)).collect()]
    assert sorted(again, key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def test_equal_documents_at_the_boundary(spark, monkeypatch):
    """One document many times: some whole, one cut, the others left out, made in chunks."""
    monkeypatch.setattr(mixing, "_COPIES", 7)
    rows = spark.createDataFrame([(1, "a", "one two three")] * 50 + [(2, "b", "w " * 400)], "doc_id bigint, source string, text string")
    got = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(rows, weights=(1, 9)).collect()]
    assert rounded(got) == rounded(mixing.brute_force([tuple(r) for r in rows.collect()], weights=(1, 9)))
    copies = [x for k, _, _, _, x in got if k == 1]
    assert set(copies) == {0, 2, 3} and sum(copies) == 83 and len(copies) == 50


def test_heavier_documents_come_first(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("five words are in it").alias("text"), (F.col("id") % 2 * 3 + 1).alias("w"))
    taken = mixing.mix(rows, weight=F.col("w").cast("double"), percent=50).groupBy((F.col("doc_id") % 2).alias("heavy")).agg(F.sum("taken").alias("n"))
    n = {r["heavy"]: r["n"] for r in taken.collect()}
    assert n[0] + n[1] == 10000 and 2.2 < n[1] / n[0] < 3.2


def test_mixed_texts(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", " ".join(f"w{k}" for k in range(i + 1)), i) for i in range(9)], "doc_id bigint, source string, text string, epochs int")
    mixed = mixing.mix(rows)
    texts = mixing.mixed_texts(rows, mixed).collect()
    words = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    for k, n in words.items():
        held = [r["text"].split() for r in sorted(texts, key=lambda r: r["epoch"]) if r["doc_id"] == k]
        assert sum(map(len, held)) == n and all(w == [f"w{i}" for i in range(len(w))] for w in held)


@pytest.mark.parametrize(("fanout", "most"), [(2, 1 << 17), (3, 40)])
def test_manifest_is_its_brute_force(docs, fanout, most):
    """With a small ``most``, keys that many rows share are ranked by digits of the leaf."""
    got = sorted(map(tuple, manifest.manifest(docs, fanout=fanout, most=most).collect()), key=str)
    want = manifest.brute_force([r.asDict() for r in docs.collect()], fanout=fanout)
    assert got == sorted(want, key=str) and 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_one_row(spark):
    row = spark.createDataFrame([(3, None, None, None, None, 0, "", 0, "", 0)], DOCS)
    (got,) = manifest.manifest(row).collect()
    assert got["leaf"] == got["subroot"] == got["root"] == got["folded_root"] and got["verified"]
    assert got["leaf"] == manifest.digest(["1:3", "-", "-", "-", "-"]) and got["proof_sha256"] == manifest.digest([])


def whole(v: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    x = np.floor(1024 * np.array(v, float)) + 100000
    c = x - x.mean(axis=0)
    e, p = np.linalg.eigh(c.T @ c / len(x))
    return x, e[::-1], p[:, ::-1], e.sum()


def test_whitening_is_the_dense_one(spark):
    r = np.random.default_rng(4)
    v = r.standard_normal((300, 40)) * np.exp(-0.05 * np.arange(40))
    v[:60] = v[0]
    rows = [(i, x) for i, x in enumerate(v.tolist())]
    bad = [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] + [0.0] * 39), (904, [1.0]), (905, []), (906, [1e300] * 40)]
    df = spark.createDataFrame([(k, x, 1, "c", 2) for k, x in rows + bad], "vec_id bigint, embedding array<double>, n int, component string, v int")
    out = whitening.whiten(df).toPandas().sort_values(["component", "vec_id"])
    x, e, p, trace = whole([v for _, v in rows])
    assert len(out) == 8 * 300 and set(out["vec_id"]) == set(range(300)) and set(out["n"]) == {300}
    exact = [sum((300 * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    want = (x - x.mean(axis=0)) @ p[:, :8] / np.sqrt(e[:8])
    for c, g in out.groupby("component"):
        assert g["deviation"].tolist() == exact
        w = want[:, c - 1] * np.sign(want[:, c - 1] @ g["whitened"])
        assert np.allclose(g["whitened"], w, atol=1e-9) and np.allclose(g["explained"], e[c - 1] / trace, rtol=1e-12)
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(4)], schema)
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}


@pytest.mark.parametrize(("d", "decay"), [(300, 0.01), (120, 0.0), (1, 0.0)])
def test_subspace_beyond_its_width(d, decay):
    r = np.random.default_rng(d)
    q, e = np.linalg.qr(r.standard_normal((d, d)))[0], 1e4 * np.exp(-decay * np.arange(d)) + r.uniform(0, 30, d)
    v = (q * e) @ q.T
    values, vectors, _ = whitening.subspace(lambda m: v @ m, d, 8)
    assert np.allclose(values, np.sort(e)[::-1][:8], rtol=1e-12) and np.allclose(v @ vectors, vectors * values, atol=1e-7)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0 and manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0
