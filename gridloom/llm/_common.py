"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body`` as a bound variable."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``; only where that is unset, as in tests, one below the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the cluster's shared folder, as a table of unknown size.

    A checkpoint alone keeps the plan's estimate of its size, and a join's is the product of its sides': over rounds
    that join what the round before left, the number's digits double each time and fill the driver.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(kept.javaRDD(), kept.schema()), spark)


#: Of a join's rows, the share from which those of one key are spread over several tasks; so at most HOT_SHARE keys are broadcast.
HOT_SHARE = 5000


def spread_join(rows: DataFrame, sums: DataFrame, keys: list[str], count: str, by: str, total: int) -> DataFrame:
    """rows joined on keys with sums, which has one row a key and in ``count`` about the key's number of rows.

    A key of more than the HOT_SHARE-th part of ``total`` rows is hot: its rows are dealt over several tasks by
    a hash of ``by``, and its row of sums goes to each. There are at most HOT_SHARE hot keys (as many as
    the counts' sum, at most total, allows), and they alone are broadcast.
    """
    most = max(1000, total // HOT_SHARE)
    salts = F.when(F.col(count) > most, F.ceil(F.col(count) / most)).otherwise(1).cast("int")
    hot = F.broadcast(sums.filter(F.col(count) > most).select(*keys, salts.alias("_salts")))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    return dealt.join(sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))), [*keys, "_salt"]).drop("_salt")


_BUILT: dict[str, object] = {}


def built(token: str, build: Callable[[], object]):
    """What ``build`` makes, once per Python worker and token; only the latest token's is kept."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = build()
    return _BUILT[token]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the rows and the bytes of an Arrow batch, so that Python workers hold a few MB of text at a time, or one very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Regroups Arrow batches into tables of about ``limit`` bytes of ``column``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        n, start, at = b.num_rows, 0, b.schema.get_field_index(column)
        lengths = [0 if x is None else x for x in pc.binary_length(b.column(at)).to_pylist()]
        for i in range(n):
            size += lengths[i]
            if size >= limit:
                held.append(b.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i + 1
        if start < n:
            held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)
