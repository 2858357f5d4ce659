"""The corpus operators as queries over the driver's tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontam, language_model, license_scan, packing, quality_model, quality_rules, sharding, simhash, tokens, toxicity
from pathloom.llm.common import documents
from pathloom.llm.oracles import ORACLES


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.write_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokens.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.shard_documents(rows, sharding.tree([1.0] * 8)).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "matches")
    marks = license_scan.summarized(F.col("matches"))
    return found.select("doc_id", "n_words", *((F.round(c, 9) if k == "score" else c).alias(k) for k, c in marks.items()))


def op4_robust_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(quality_rules.statistics_of(documents(spark, sf_dir)))
    return found.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "distance")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    forest = quality_model.learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality_model.fifth)
    return quality_model.score_quality(docs, forest).select("doc_id", quality_model.fifth("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_model.learn_languages(docs, language_model.third)
    return language_model.predict_languages(docs.select("doc_id", "text"), model).select("doc_id", language_model.third("doc_id").alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.third)
    return toxicity.score_toxicity(docs, model).select("doc_id", toxicity.third("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "start", "overlap", "share")


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_hash_tree_sharding,
        op3_license_scan,
        op4_robust_outlier_rules,
        op5_quality_classifier,
        op6_spaced_seed_decontamination,
        op7_language_id,
        op8_simhash_near_duplicates,
        op9_nnls_packing,
        op10_toxicity,
    )
}

__all__ = ["ORACLES", "QUERIES"]
