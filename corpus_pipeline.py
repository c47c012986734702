"""A corpus pipeline: quality classifier, near-dedup, decontamination, personal data, packing.

Each stage is a function of (spark, docs, sf_dir) over all that its predecessor kept; its result is
written as Parquet and read again as the next stage's documents. All but the last return the columns
of documents, and any further ones of their input.

Nulls and ties: a row is judged by its own doc_id and text, so a row without a doc_id, or with one that
other rows have too, neither hides behind another's verdict nor is lost by it. A doc_id is a document: where
rows repeat one, the near-dedup stage keeps the row whose text it has compared; rows without a doc_id are
no one's copies there. Empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from graphloom.llm import decontamination, near_dup, packing, perplexity, pii, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose perplexity is above their language's threshold, and null and empty ones; long texts are read whole."""
    judged = scratch.table(perplexity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "judged")
    gone = judged.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text_hash").alias("_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & docs["lang"].cast("string").eqNullSafe(gone["_lang"])
    return docs.filter(docs["text"].isNotNull()).join(gone, same & (_text_hash(docs) == gone["_text"]), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near-duplicates (five words, similarity 0.8)."""
    found = scratch.table(near_dup.near_duplicates(docs, k=5, percent=80), "near")
    stay = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"))
    kept = docs.join(stay, (docs["doc_id"].cast("long") == stay["_id"]) & (_text_hash(docs) == stay["_text"]), "left_semi")
    # rows of one doc_id and text may differ elsewhere: the one of least hash stays
    order = F.xxhash64(*[docs[f"`{f.name}`"] for f in docs.schema if not isinstance(f.dataType, MapType | VariantType)])
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    one = kept.groupBy(docs["doc_id"].alias("_key")).agg(F.min_by(row, order).alias("_row")).select("_row.*")
    return one.unionByName(docs.filter(docs["doc_id"].isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item; null and empty texts contain none."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, secrets and terms that give a protected entity away; n_chars follows the text, a null text stays."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their sequence and offset; a null or empty text is one piece, its end token."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _text_hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


STAGES = [("quality classifier", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("personal data", personal_data), ("packing", pack)]

# The perplexity model and the packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
