"""Fronts: distances, tiles against one queue, what travels along, and topology."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import eikonal, regions

CELLS, SEEDS = "x long, y long, s double", "x long, y long, time double, value double, tag long"


def by_place(df) -> dict:
    return {(r["x"], r["y"]): r for r in df.collect()}


def test_uniform_speed_is_near_the_distance(spark):
    n, c = 41, 20
    cells = spark.createDataFrame([(x, y, 2.0) for x in range(n) for y in range(n)], "x long, y long, v double")
    out = by_place(regions.fast_marching(cells, spark.createDataFrame([(c, c)], "x long, y long")))
    assert len(out) == n * n
    for (x, y), r in out.items():
        d = math.hypot(x - c, y - c) / 2
        # first order: the diagonal's excess is a few percent, where face steps alone would take 41
        assert d - 1e-9 <= r["time"] <= 1.05 * d + 0.25
    assert out[c + 7, c]["time"] == pytest.approx(3.5)
    wide = by_place(regions.fast_marching(cells, spark.createDataFrame([(c, c)], "x long, y long"), spacing=(3.0, 1.0), stop=5.0))
    assert wide[c + 2, c]["time"] == pytest.approx(3.0) and max(r["time"] for r in wide.values()) <= 5.0


@pytest.mark.parametrize("strict", [False, True])
def test_tiles_give_what_one_queue_gives(spark, strict):
    r = random.Random(1)
    cells = [(x, y, r.choice([1.0, 2.0, 0.5, 0.1])) for x in range(30) for y in range(30) if r.random() < 0.85]
    seeds = spark.createDataFrame([(*r.choice(cells)[:2], 0.1 * i, float(i), i) for i in range(4)], SEEDS)
    df = spark.createDataFrame(cells, CELLS)
    one, many = by_place(eikonal.march(df, seeds, strict=strict)), by_place(eikonal.march(df, seeds, strict=strict, tile=8))
    assert one.keys() == many.keys()
    assert all(abs(one[p]["time"] - many[p]["time"]) < 1e-9 and abs(one[p]["value"] - many[p]["value"]) < 1e-9 and one[p]["tag"] == many[p]["tag"] for p in one)


def test_a_ring_keeps_its_cut(spark):
    """Two arms of a front round a hole meet, and join unless topology forbids it."""
    ring = spark.createDataFrame([(x, y, 1.0) for x in range(21) for y in range(21) if 6 <= math.hypot(x - 10, y - 10) <= 9], "x long, y long, v double")
    seed = spark.createDataFrame([(10, 2)], "x long, y long")
    free, kept = by_place(regions.fast_marching(ring, seed)), by_place(regions.fast_marching(ring, seed, topology="strict"))
    gone = free.keys() - kept.keys()
    assert len(free) == ring.count() and 3 <= len(gone) <= 6 and all(y > 10 for _, y in gone)
    with pytest.raises(ValueError, match="topology"):
        regions.fast_marching(ring, seed, topology="loose")


def test_simple_cells_in_three_dimensions():
    simple = eikonal.Simple(3)
    plate = {(x, y, 0): 1 for x in range(3) for y in range(3)}
    assert simple((1, 1, 1), plate) and simple((3, 1, 0), plate) and not simple((1, 1, 5), plate)
    holed = {p: 1 for p in plate if p != (1, 1, 0)}
    assert not simple((1, 1, 0), holed)
    ends = {(0, 0, 0): 1, (2, 0, 0): 1}
    assert not simple((1, 0, 0), ends) and simple((1, 0, 0), {(0, 0, 0): 1})


def test_values_stay_constant_along_paths(spark):
    """From a line of seeds the front goes straight: each column keeps its seed's value; labels go to the nearer seed."""
    cells = spark.createDataFrame([(x, y, 1.0) for x in range(8) for y in range(8)], "x long, y long, v double")
    line = spark.createDataFrame([(x, 0, float(x * x)) for x in range(8)], "x long, y long, aux double")
    assert all(r["aux"] == pytest.approx(x * x) and r["time"] == pytest.approx(y) for (x, y), r in by_place(regions.fast_marching_extension(cells, line)).items())
    ends = spark.createDataFrame([(0, 3, 5), (7, 3, 4), (4, 4, 0)], "x long, y long, label int")
    got = by_place(regions.propagate_by_front(cells.filter("y = 3"), ends))
    assert [got[x, 3]["label"] for x in range(8)] == [5] * 4 + [4] * 4


def test_edge_cases(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.0), (2, 0, 1.0), (3, 0, None), (-1, 0, 4.0)], "x long, y long, v double")
    seed = spark.createDataFrame([(0, 0), (0, 0), (9, 9)], "x long, y long")
    assert {p: r["time"] for p, r in by_place(regions.fast_marching(cells, seed)).items()} == {(0, 0): 0.0, (-1, 0): 0.25}
    assert regions.fast_marching(cells, seed.filter(F.lit(False))).count() == 0
