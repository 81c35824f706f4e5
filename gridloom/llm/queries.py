"""The registered queries of this subpackage; each takes (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat_format, decontaminate, langid, manifest, mixing, near_dedup, packing, pii, quality_rules, sql, suffix_dedup, toxicity, whitening, wrapper_extract
from gridloom.llm._common import small_batches, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 500)
    out = wrapper_extract.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_wrapper", "n_template")


def op3_pack_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_pii_deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = pii.detect(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in pii.KINDS]
    out = out.select("doc_id", "spans", base.alias("base"))
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, *toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_langid_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs.filter(~langid.held_out(F.col("doc_id")))))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, :said AS text FROM range(2)", args={"said": hard})
    out = chat_format.format_chat(rows.unionByName(extra))
    turns, loss = chat_format.parse_chat(F.col("formatted")), chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    read = out.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op9_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("gone")


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 500)
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_wrapper_induction, op3_pack_dp, op4_pii_deobfuscate, op5_ordinal_toxicity, op6_decontaminate, op7_langid_zstd, op8_chat_format, op9_odd_sketch_dedup, op10_quality_rules, op11_mix_sources, op12_merkle_manifest, op13_whiten_embeddings)}
ORACLES: dict[str, str] = {"op6_decontaminate": sql.DECONTAMINATE, "op8_chat_format": sql.CHAT, "op9_odd_sketch_dedup": sql.NEAR_DEDUP, "op10_quality_rules": sql.QUALITY, "op11_mix_sources": sql.MIX, "op12_merkle_manifest": sql.MANIFEST}
