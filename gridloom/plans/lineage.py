"""Cutting the lineage of iterative plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one below the warehouse only where that is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the shared folder, as a table of unknown size.

    A checkpoint alone keeps the plan's estimate of its size, and a join's is the product of its sides':
    over rounds that join what the round before left, the number's digits double each time and fill the driver.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(kept.javaRDD(), kept.schema()), spark)
