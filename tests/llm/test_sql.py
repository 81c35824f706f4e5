"""Queries with SQL against it on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gridloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.execute(queries.ORACLES[name]).df()
    key = got.columns[0]
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (x.sort_values(key).reset_index(drop=True)[sorted(x.columns)] for x in (got, want))
    assert got.equals(want)


def test_every_operator_has_its_query():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []
