"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs. All but the last return the columns of documents. ``run`` writes the stages' tables
to the shared folder of ``spark.checkpoint.dir`` (below the warehouse where that is unset) and removes
each table when the next one is written.

Edge cases, of every stage: an empty table gives an empty one; a null doc_id has no verdict, so its rows
stay, and are packed; rows that share a doc_id are kept or dropped together, and where one of them is
kept by the quality rules, all are; columns of any other name pass through; texts are read whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, near_dedup, packing, pii, quality_rules
from gridloom.llm._common import shared_folder, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules or are depleted, and removes boilerplate lines from the others; null and empty texts go, having no words."""
    return quality_rules.pipeline_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near copies (five-word shingles, similarity 0.8 or more); texts without words are no copies and stay."""
    small_batches(spark)
    return near_dedup.pipeline_stage(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; null and empty texts, and all where the benchmark is empty, stay."""
    small_batches(spark)
    return decontaminate.pipeline_stage(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; a null text stays null."""
    small_batches(spark)
    return pii.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is the end token alone."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("decontaminate", benchmark), ("pii", personal_data), ("packing", pack)]

#: Stages of Python code can't be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", None
    path = spark._jvm.org.apache.hadoop.fs.Path
    for k, (_, stage) in enumerate(STAGES):
        out = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            path(before).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(before), True)
        before = out
    return docs
