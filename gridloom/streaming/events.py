"""The time-series operations over a stream of events, by Structured Streaming.

Windows close by watermark, so state is bounded by the lateness allowed; results equal those of the
batch operations over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.lineage import shared_folder

LATE = "1 hour"


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").format("parquet").load(path if _is_folder(spark, path) else _parent(path))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs a zone


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _parent(path: str) -> str:
    return path.rsplit("/", 1)[0] + "/events*"


def tumbling(events: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    """n, total and mean of value per event type and window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


def sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours", late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """n per user and session."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs all rows that are there now into a table of the shared folder and returns that table.

    In complete mode a batch replaces the table, in append mode it is a part of its own, so that a batch that is run again leaves no row twice.
    """
    spark, folder = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{name}"
    rows, whole = f"{folder}/rows", mode == "complete"
    part = lambda i: f"{rows}/part=0" if whole else f"{rows}/part={i}"
    spark.createDataFrame([], stream.schema).write.parquet(part(0))

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(part(i))

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(rows).select(*stream.columns)
