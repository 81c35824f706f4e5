"""The driver's tables read as grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Geometry

WIDTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 2-D image x, y, v with a second image w and two label images la and lb; 50 cells wide."""
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % WIDTH).alias("x"), F.expr(f"p_partkey div {WIDTH}").alias("y"), F.col("p_retailprice").alias("v"), F.col("p_size").cast("double").alias("w"), F.col("p_size").cast("bigint").alias("la"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("bigint").alias("lb"))


PART_SQL = "img AS (SELECT p_partkey % 50 AS x, p_partkey // 50 AS y, p_retailprice AS v, CAST(p_size AS DOUBLE) AS w, CAST(p_size AS BIGINT) AS la, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS lb FROM part)"
PART_SPACING = Geometry(size=(WIDTH, 0), spacing=(1.0, 2.0), origin=(10.0, -5.0))


def embed_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of 8 x 8 images: image, grp, x, y, v."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image"), F.col("label").cast("bigint").alias("grp"), F.posexplode("embedding").alias("p", "v")).select("image", "grp", (F.col("p") % 8).cast("bigint").alias("x"), F.expr("p div 8").alias("y"), F.col("v").cast("double").alias("v"))


EMBED_SQL = "eset AS (SELECT image, grp, p % 8 AS x, p // 8 AS y, CAST(e[p + 1] AS DOUBLE) AS v FROM (SELECT vec_id AS image, CAST(label AS BIGINT) AS grp, embedding AS e, unnest(range(64)) AS p FROM embeddings))"


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse time series: voxel x (user), day t from 2024-01-01, v the mean value."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("x"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("bigint").alias("t")).agg(F.avg("value").alias("v"))


EVENT_SQL = "ser AS (SELECT user_id AS x, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t, avg(value) AS v FROM events GROUP BY 1, 2)"


def line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many labelled cells: label (code of return flag and line status), v (quantity), w (price)."""
    line = table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3) * 2 - F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
    return line.select(code.cast("bigint").alias("label"), F.col("l_quantity").alias("v"), F.col("l_extendedprice").alias("w"))


LINE_SQL = "cells AS (SELECT CAST((CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) * 2 - (CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END) AS BIGINT) AS label, l_quantity AS v, l_extendedprice AS w FROM lineitem)"
