import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import near_dedup, suffix_dedup
from gridloom.llm.graph import components


@pytest.mark.parametrize("hot_bytes", [suffix_dedup.HOT_BYTES, 300])
def test_suffix_dedup_is_brute_force(docs, rows, hot_bytes):
    """Both with and without the second cut of large minimizers."""
    want = suffix_dedup.brute_force(rows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs, hot_bytes=hot_bytes).collect()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 1000


def test_long_texts_are_cut_into_pieces(monkeypatch):
    """Each window of a text longer than a chunk lies in one segment of one piece."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 700)
    texts = [bytes(random.Random(i).choices(b"abcdefgh", k=n)) for i, n in enumerate((5000, 99, 100, 799, 800, 0))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t.decode() for t in texts])], ["doc", "text"])
    got = [(r["doc"], r["start"] + i) for t in suffix_dedup._segmented(iter([batch])) for r in t.to_pylist() for i in range(r["n"])]
    assert sorted(got) == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 99)]


def test_suffix_dedup_of_repeated_rows_and_null_keys(spark, make_prose):
    """Repeated rows lose nothing by each other."""
    a, b = make_prose(11, 80), make_prose(12, 700)
    rows = [(1, a), (1, a), (2, f"{make_prose(13, 9)} {a}"), (3, b), (4, b[900:2100] + b[:400]), (None, a)]
    want = suffix_dedup.brute_force([r for i, r in enumerate(rows) if i != 1 and r[0] is not None])
    df = spark.createDataFrame([(*r, 7, b"x", "z") for r in rows], "doc_id int, text string, n_bytes int, kept binary, doc string")
    for hot_bytes in (suffix_dedup.HOT_BYTES, 150):
        got = [(r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in suffix_dedup.dedup(df, hot_bytes=hot_bytes).collect()]
        assert len(got) == len(rows) and all(v == want[k] for k, v in got if k is not None)
        assert [v[:3] for k, v in got if k is None] == [(len(a), 0, 0)]
    with pytest.raises(TypeError):
        suffix_dedup.dedup(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_single_windows_of_hot_minimizers(rows):
    """Windows dealt one by one give the spans of whole segments; a part without bytes is a removed window."""
    part = lambda *r: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*r, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["m", "doc", "start", "part"])
    texts = [(d, t.encode()) for d, t in rows if t and len(t.encode()) >= 100]
    batch = part(*[(7, d, 0, t) for d, t in texts])
    split = pa.Table.from_batches(suffix_dedup._split_windows(iter([batch.slice(0, 9), batch.slice(9)]))).sort_by("m")
    spans: dict = {}
    for r in pa.Table.from_batches(suffix_dedup._judged(iter(split.to_batches(max_chunksize=50)))).to_pylist():
        spans.setdefault(r["doc"], []).append((r["start"], r["stop"]))
    want = suffix_dedup.brute_force([(d, t.decode()) for d, t in texts])
    assert {d: sum(hi - lo for lo, hi in suffix_dedup.merge_spans(spans.get(d, []))) for d, _ in texts} == {d: v[1] for d, v in want.items()}


def test_suffix_dedup_keeps_bytes(spark):
    t = "".join(chr(97 + random.Random(3).randrange(26) * i % 26) for i in range(300))
    df = spark.createDataFrame([(1, t), (2, "Q" + t[:150])], "doc_id bigint, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.dedup(df, with_text=True).collect()}
    assert got[2] == b"Q"


def test_suffix_dedup_empty_table(empty):
    assert suffix_dedup.dedup(empty).collect() == []


def test_merged_transforms_find_the_intervals_of_a_sort():
    """Against sorting all suffixes of several shards, with zero bytes and separators."""
    r = random.Random(1)
    for length in (3, 8):
        shards = []
        for _ in range(4):
            s = [r.randrange(1, 4) for _ in range(60)]
            s[r.randrange(60)] = 0
            shards.append(np.array([*s, 0], np.uint16))
        place, interval = suffix_dedup.repeated_intervals(shards, length)
        want: dict[tuple, set[int]] = {}
        base = 0
        for s in shards:
            for i in range(len(s) - length + 1):
                w = tuple(s[i : i + length])
                if 0 not in w:
                    want.setdefault(w, set()).add(base + i)
            base += len(s)
        got: dict[int, set[int]] = {}
        for p, k in zip(place.tolist(), interval.tolist(), strict=True):
            got.setdefault(k, set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_segments_put_equal_windows_under_one_minimizer():
    data = np.frombuffer(bytes(random.Random(2).choices(b"abcd", k=2000)), np.uint8)
    twice = np.concatenate([data, np.frombuffer(b"#", np.uint8), data])
    value, _, place, n, _ = suffix_dedup.segments(twice, np.array([0, len(twice)]))
    of = {p + i: v for v, p, m in zip(value.tolist(), place.tolist(), n.tolist(), strict=True) for i in range(m)}
    assert len(of) == len(twice) - suffix_dedup.LENGTH + 1
    assert all(of[i] == of[i + len(data) + 1] for i in range(len(data) - suffix_dedup.LENGTH + 1))


@pytest.mark.parametrize("size,most,rounds", [(2, near_dedup.GROUP_SHINGLES, 4), (5, near_dedup.GROUP_SHINGLES, 4), (2, 500, 2), (2, 500, 0)])
def test_near_duplicates_are_brute_force(docs, rows, size, most, rounds):
    """Also with groups too large for a task: pivots, and blocks only."""
    want = near_dedup.brute_force(rows, size)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, size, most=most, rounds=rounds).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 8


def test_near_duplicates_empty_and_null_keys(spark, empty):
    assert near_dedup.near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect() if r["doc_id"] is not None)
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 2, True)]


def test_odd_sketch_estimates_high_similarity():
    r = np.random.default_rng(4)
    pool = r.integers(0, 1 << 63, 4000, np.uint64)
    for shared in (1.0, 0.95, 0.8):
        a = np.unique(pool[:1000])
        b = np.unique(np.concatenate([pool[: int(1000 * shared)], pool[2000 : 2000 + int(1000 * (1 - shared))]]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = near_dedup.estimate(near_dedup.odd_sketch(near_dedup.minhashes(a)), near_dedup.odd_sketch(near_dedup.minhashes(b))[None])[0]
        assert abs(got - j) < 0.12


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_a_round_over_few_edges_takes_few_tasks(spark):
    """However many partitions a shuffle has, few edges aren't dealt over all of them."""
    from gridloom.llm import graph

    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        edges = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
        assert graph._large_star(edges, 40).rdd.getNumPartitions() <= graph.LEAST_TASKS
        assert graph._small_star(edges, 40).rdd.getNumPartitions() <= graph.LEAST_TASKS
        assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(i, 0) for i in range(41)}
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
