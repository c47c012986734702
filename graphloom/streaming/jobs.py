"""Streaming forms of the merge, dedup, enrichment and missing-key operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from graphloom.operators.measurements import merge_batch
from graphloom.sources.tables import current, current_version, publish, shared_folder


def stream_of(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A file stream with a known schema."""
    return spark.readStream.schema(like.schema).parquet(path)


def merge_stream(batches: DataFrame, store: str, checkpoint: str, split: Callable[[DataFrame], dict[str, DataFrame]], specs: dict[str, tuple[str, Column]], edges: dict[str, tuple[str, str]]) -> StreamingQuery:
    """Merge each micro-batch into the canonical store by ``merge_batch``.

    ``split`` makes the incoming tables of a batch. A batch merges into the current version of the store, whoever wrote it, and
    publishes the next one, so a new checkpoint starts from all that is there and a batch that runs again adds nothing.
    Where another writer has published meanwhile the batch fails and merges into that version when the query runs again. Each version is whole; ``stateful.canonical_stream`` appends instead.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, incoming = batch.sparkSession, split(batch)
        base = current_version(spark, store)
        have = current(spark, store, base) if base else {}
        out, report = merge_batch({name: have.get(name, df.limit(0)) for name, df in incoming.items()}, incoming, specs, edges)
        publish(spark, store, {**out, "report": report}, base=base)

    return batches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(rows: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def enrich_stream(rows: DataFrame, static: DataFrame, key: str, keep: Column) -> DataFrame:
    """Rows joined to a static table and filtered."""
    return rows.join(static, key).filter(keep)


def missing_stream(requests: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Requests whose key no node has (T4)."""
    have = nodes.select(F.col(key).alias("_k"), F.lit(True).alias("_have")).distinct()
    return requests.join(have, F.col(key) == F.col("_k"), "left").filter("_have is null").drop("_k", "_have")


def unserved_stream(requests: DataFrame, arrivals: DataFrame, key: str, time: str, wait: str, delay: str) -> DataFrame:
    """Requests whose node does not arrive within ``wait`` after them: what is to be ingested (T4).

    Both streams have the key and a time; rows may be late by ``delay``. A request is held until one arrival serves it or the watermark
    passes the end of its wait, so state is bounded by both spans. An arrival before the request does not count, nor does one without key.
    """
    asked = requests.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    came = arrivals.select(F.col(key).alias("_key"), F.col(time).cast("timestamp").alias("_came")).withWatermark("_came", delay)
    served = (F.col(key) == F.col("_key")) & (F.col("_came") >= F.col(time)) & (F.col("_came") <= F.col(time) + F.expr(f"interval {wait}"))
    return asked.join(came, served, "leftOuter").filter("_came is null").drop("_key", "_came")


def run_to_parquet(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder for a stream's output and state under the shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
