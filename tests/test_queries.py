"""Each registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from gridloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
SQL = plans.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(frame, digits):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), digits) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, tables, name):
    got, want = plans.queries()[name](spark, SF).toPandas(), tables.execute(SQL[name]).df()
    assert rows(got, 8) == rows(want, 8)
    assert {c: str(t) for c, t in got.dtypes.items()} == {c: str(t) for c, t in want.dtypes.items()}


def test_names_and_schemas(spark):
    every = plans.queries()
    assert set(SQL) <= set(every) and len(every) > 150
    assert "label_stats" in every


def test_motion_correction_reads_the_whole_image(spark, monkeypatch):
    from gridloom.plans import queries_more as more

    image = spark.range(50 * 30).selectExpr("id % 50 AS x", "id div 50 AS y", "CAST(id % 7 AS double) AS w")
    seen, real = [], more.regions.motion_correct
    monkeypatch.setattr(more.fx, "part_image", lambda spark, sf: image)
    monkeypatch.setattr(more.regions, "motion_correct", lambda series, reach: (seen.append(series.count()), real(series, reach))[1])
    assert [tuple(r) for r in plans.queries()["motion_correction"](spark, SF).orderBy("t").collect()] == [(t, 0, 0) for t in range(4)]
    assert seen == [4 * 50 * 30]
