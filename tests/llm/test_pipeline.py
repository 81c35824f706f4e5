import importlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, near_dedup

corpus_pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture
def folder(spark, docs, tmp_path, make_prose):
    """A small corpus with planted cases, a benchmark, and columns in another order."""
    test = make_prose(900, 30)
    planted = [(2000, f"{make_prose(901, 40)} {test} {make_prose(902, 40)}"), (2001, f"{make_prose(903, 60)} reach me at me@example.com today"), (2002, "short"), (2003, "w " * 40), (None, make_prose(904, 50))]
    rows = spark.createDataFrame([(d, t, "en", "h0", 1) for d, t in planted], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.select("doc_id", "text", "lang", "source", "n_chars").union(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, test), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = before, {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(seen[name][1]) <= set(before)
    before, after = seen["quality_rules"]
    assert 2002 not in after and 2003 not in after and {2000, 2001, None} <= set(after)
    before, after = seen["near_dedup"]
    want = near_dedup.brute_force([(k, t) for k, t in before.items() if k is not None], 5)
    assert set(after) - {None} == {k for k, (_, c) in want.items() if k == c} and None in after
    before, after = seen["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = decontaminate.brute_force(list(before.items()), items)
    assert set(after) == {k for k, (n, h, _) in hits.items() if not (h and 20 * h >= n)} and 2000 not in after
    before, after = seen["pii"]
    assert set(before) == set(after) and after[2001].endswith("[EMAIL] today")


def test_columns_named_as_helpers(spark, folder):
    """Extra columns, some named as the stages' own, and a long text pass through every stage."""
    names = ["_gone", "gone", "key", "row", "kept", "hs", "signs", "host", "lines", "contaminated", "component_id", "spans", "m", "_salt", "_salts"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long = spark.createDataFrame([(5000, " ".join(f"w{i}" for i in range(60000)), "en", "h1", 1)], docs.schema)
    docs = docs.union(long).select("doc_id", *[F.lit(n).alias(n) for n in names], "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        stage(spark, docs, folder).write.parquet(f"{folder}/clash-{name}")
        docs = spark.read.parquet(f"{folder}/clash-{name}")
        assert docs.columns == columns and docs.filter("doc_id = 5000").count() == 1
        assert docs.filter(" OR ".join(f"`{n}` <> '{n}'" for n in names)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).filter("doc_id = 5000").count() > 0


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    whole = out.groupby("doc_id")["length"].sum() == out.groupby("doc_id")["doc_tokens"].first()
    assert whole.all() and 2001 in set(out["doc_id"]) and not {2000, 2002, 2003} & set(out["doc_id"])
    assert np.all(out.groupby("sequence_id")["length"].sum() <= 2048)


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
