"""Rounds of plans: what a checkpoint keeps, and how many rounds a long image takes."""

from pyspark.sql import functions as F

from gridloom.llm import _common
from gridloom.grid import box, scattered
from gridloom.operators import fronts, label, regions, spline, transforms
from gridloom.plans import lineage


def test_rounds_of_joins_keep_the_estimate_of_size_bounded(spark):
    for checkpointed in (lineage.checkpointed, _common.checkpointed):
        now = checkpointed(spark.range(4).withColumnRenamed("id", "x"))
        for _ in range(8):
            now = checkpointed(now.join(now.select("x"), "x"))
        assert now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 128
        assert sorted(r["x"] for r in now.collect()) == [0, 1, 2, 3]


def test_tiles_of_a_long_image_get_longer(spark):
    cells = spark.range(50 * 6000).selectExpr("id % 50 AS x", "id div 50 AS y")
    assert fronts.sides(cells, ["x", "y"]) == [64, 375]
    assert fronts.sides(cells.filter("y < 400"), ["x", "y"]) == [64, 64]
    assert fronts.sides(cells.filter("y < 0"), ["x", "y"]) == [64, 64]


def test_travel_over_a_long_image(spark):
    cells = spark.range(2 * 3000).selectExpr("id % 2 AS x", "id div 2 AS y", "1.0D AS s")
    seeds = cells.filter("x = 0 AND y = 0").selectExpr("x", "y", "0.0D AS time", "0 AS tag")
    got = {(r["x"], r["y"]): r["time"] for r in fronts.travel(cells, seeds).collect()}
    assert len(got) == 6000 and all(t == x + y for (x, y), t in got.items())


def test_intensity_statistics_of_counts_whose_products_exceed_64_bits(spark):
    """Three million cells a label: (n - 1)(n - 2)(n - 3) is beyond 64 bits."""
    cells = spark.range(3_000_000).selectExpr("1 AS label", "CAST(id % 2 AS DOUBLE) AS v")
    row = label.intensity_statistics(cells).first()
    assert row["count"] == 3_000_000 and abs(row["skewness"]) < 1e-9 and abs(row["kurtosis"] + 2) < 1e-5


def test_joins_of_cells_broadcast_none(spark):
    cells = spark.range(400).selectExpr("id % 20 AS x", "id div 20 AS y", "CAST(id AS DOUBLE) AS v")
    warped = transforms.warp(cells, cells, {"x": F.col("x") + 0.5, "y": F.col("y")})
    moved = regions.motion_correct(cells.withColumn("t", F.lit(0)), 1)
    for df in (warped, moved):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_cells_are_dealt_before_they_multiply(spark):
    cells = spark.range(2000).selectExpr("id % 10 AS x", "id div 10 AS y", "CAST(id AS DOUBLE) AS v").coalesce(1)
    assert scattered(cells, box(["x", "y"], 1), ["x", "y"]).rdd.getNumPartitions() > 1
    field = cells.selectExpr("x", "y", "v AS ux", "0.0D AS uy")
    bound = transforms.lipschitz(field)
    plan = bound._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {round(r["v"], 6) for r in bound.collect()} <= {round(v, 6) for v in (11 / 2**0.5, 10.0)} and bound.count() == 2000


def test_super_resolution_of_a_long_image(spark):
    """The waves along the long axis are as short as along the other: spans must not get longer with the image."""
    wave = F.sin(F.col("x") / 8) + F.cos(F.col("y") / 6)
    cells = spark.range(50 * 1200).selectExpr("CAST(id % 50 AS DOUBLE) AS x", "CAST(id div 50 AS DOUBLE) AS y")
    got = spline.super_resolution(cells.withColumn("v", wave), cells, 8, 3)
    worst, n = got.agg(F.max(F.abs(F.col("v") - wave)), F.count(F.lit(1))).first()
    assert n == 60_000 and worst < 0.2


def test_landmarks_far_from_the_ends_of_a_long_image(spark):
    """Two marks ten rows apart, with moves of 1 and 2, among 20,000 rows."""
    marks = spark.createDataFrame([(7, 20, 9000), (23, 20, 9010)], "label bigint, x bigint, y bigint")
    moved = marks.withColumn("x", F.col("x") + F.when(F.col("label") == 7, 1).otherwise(2))
    grid = spark.range(4 * 20000).selectExpr("id % 4 * 15 AS x", "id div 4 AS y").union(marks.select("x", "y")).distinct()
    at = marks.join(spline.landmark_field(marks, moved, grid, 8, 4), ["x", "y"]).collect()
    assert len(at) == 2 and all(abs(r["ux"] - (1 if r["label"] == 7 else 2)) < 0.005 for r in at)
