"""The operators' queries with production parameters, and their SQL twins."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat, class_lm, decontamination, licences, merkle, near_dup, packing, perplexity, pii, quality_rules, shards, spelling, token_counts


SHARD_BYTES = 256 << 10  # small, so that all given tables need shards of many depths


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=5, percent=80)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(chat.streamed_events(turns.unionByName(extra))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_table(spark, sf_dir, "documents"), "web", 1)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80).drop("text_hash")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("text_hash")


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.checked(merkle.manifest(_table(spark, sf_dir, "documents"), changes={"text": lower}, when=tampered))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), slip=spelling.SLIP)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(_table(spark, sf_dir, "documents"))


QUERIES = [
    op1_benchmark_decontamination,
    op2_license_scan,
    op3_best_fit_packing,
    op4_token_counts,
    op5_chat_formatting,
    op6_quality_rules,
    op7_near_duplicates,
    op8_quality_classifier,
    op9_byte_shards,
    op10_personal_data,
    op11_merkle_manifest,
    op12_spelling_variants,
    op13_lm_scoring,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": decontamination.oracle_sql(),
        "op6_quality_rules": quality_rules.oracle_sql(),
        "op9_byte_shards": shards.oracle_sql(SHARD_BYTES),
        "op11_merkle_manifest": merkle.oracle_sql(),
        "op12_spelling_variants": spelling.oracle_sql(),
    }
