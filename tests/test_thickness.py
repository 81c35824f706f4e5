"""Thickness by a flow: planted slabs and shells, tiles against the whole."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators.thickness import propagated_thickness
from gridloom.plans import pipelines

CELLS = "x long, y long, inner double, middle double"


def slab(spark, cells: int, width: int = 12, long: int = 24):
    rows = [(x, y, float(x < 8), float(8 <= x < 8 + cells)) for x in range(long) for y in range(width)]
    return spark.createDataFrame(rows, CELLS)


@pytest.mark.parametrize("cells", [4, 6])
def test_a_slab(spark, cells):
    out = propagated_thickness(slab(spark, cells)).toPandas()
    inside = out[(out.y > 3) & (out.y < 8)]
    assert len(out) == 12 * cells and np.all(np.abs(inside.thickness - cells) <= 0.05 * cells + 0.05)


def test_a_shell_and_its_tiles(spark):
    """A ring of 5 cells round a disc; cut into tiles, the same."""
    rows = []
    for x in range(44):
        for y in range(44):
            r = math.hypot(x - 22, y - 22)
            core = min(max(9.5 - r, 0.0), 1.0)
            rows.append((x, y, core, min(max(14.5 - r, 0.0), 1.0) - core))
    df = spark.createDataFrame(rows, CELLS)
    whole = propagated_thickness(df).toPandas().set_index(["x", "y"]).thickness
    assert abs(whole.mean() - 5) < 0.25 and whole.std() < 0.3 and whole.min() > 4.2
    tiles = propagated_thickness(df, tile=16, rounds=3).toPandas().set_index(["x", "y"]).thickness
    short = propagated_thickness(df, rounds=3).toPandas().set_index(["x", "y"]).thickness
    assert np.allclose(tiles, short.reindex(tiles.index), atol=1e-9)


def test_the_prior_stops_the_flow(spark):
    out = propagated_thickness(slab(spark, 9), prior=3, rounds=25).toPandas()
    reached = out[out.thickness > 0]
    assert reached.thickness.max() <= 4.5 and (out[out.x >= 13].thickness == 0).all()


def test_spacing_and_edge_cases(spark):
    df = slab(spark, 4)
    wide = propagated_thickness(df, spacing=(2.0, 1.0)).filter("y = 6").agg(F.avg("thickness")).first()[0]
    assert abs(wide - 8) < 0.5
    assert propagated_thickness(df.withColumn("middle", F.lit(None).cast("double"))).count() == 0
    alone = propagated_thickness(df.withColumn("inner", F.lit(0.0)), rounds=2).toPandas()
    assert len(alone) == 48 and (alone.thickness == 0).all()


def test_the_study_uses_it(spark):
    """Three flat classes, the middle one a band of 4 cells."""
    image = slab(spark, 4).select("x", "y", (F.lit(10.0) + 40 * F.col("inner") + 20 * F.col("middle") + F.col("y") * 0.01).alias("v"))
    out, volumes = pipelines.cortical_thickness(image, rounds=30)
    got = out.filter("y BETWEEN 4 AND 7").toPandas()
    assert {r["label"]: r["cells"] for r in volumes.collect()} == {1: 144, 2: 48, 3: 96}
    assert len(got) == 16 and np.all(np.abs(got.v - 4) < 0.3)


def test_only_tiles_with_cells_of_their_own_are_solved(spark, monkeypatch):
    """Cells near a tile's border don't make work of an empty tile beyond it; the result is the whole image's."""
    from gridloom.operators import thickness

    df = slab(spark, 4, 6, 16)
    whole = {(q.x, q.y): q.thickness for q in propagated_thickness(df, prior=4, rounds=1).collect()}
    made = thickness._tile

    def guarded(*args):
        run = made(*args)

        def solve(table):
            if not any(table.column("own").to_pylist()):
                raise ValueError("a tile without cells of its own")
            return run(table)

        return solve

    monkeypatch.setattr(thickness, "_tile", guarded)
    got = {(q.x, q.y): q.thickness for q in propagated_thickness(df, prior=4, rounds=1, tile=8).collect()}
    assert got.keys() == whole.keys() and all(abs(got[k] - v) < 1e-9 for k, v in whole.items())
