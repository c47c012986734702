"""Tables stored by hash bucket of their identity, so that a merge reads and writes the buckets of its batch only.

A table is a folder of Parquet partitions ``bucket=<n>``. Rows of one identity are in one bucket, whatever their
other values, so a bucket is merged on its own. A batch's buckets are found first: at most as many numbers as the
table has buckets. The store's scan is pruned to them, and dynamic partition overwrite replaces just these.
A merge that is run again, because it failed half-way, gives the same table: every operation here is idempotent.
One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from graphloom.sources.tables import first_per, stored, upsert_edges, upsert_nodes

BUCKET = "bucket"


@dataclass(frozen=True)
class Bucketed:
    """A stored table: its folder, its columns, the columns of its identity and the number of its buckets."""

    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 64

    def number(self, keys: tuple[str, ...] | None = None) -> Column:
        """The bucket of a row, from its identity as text."""
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys or self.keys]), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; an absent table is empty."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(self.path)
        return (rows if only is None else rows.filter(F.col(BUCKET).isin(only))).select(*self.schema.names)

    def write(self, rows: DataFrame) -> None:
        """Replace the buckets that the rows stand in."""
        placed = rows.select(*self.schema.names).withColumn(BUCKET, self.number()).repartition(BUCKET)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def merge(self, batch: DataFrame, with_target: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Merge a batch into its buckets by ``with_target(rows of these buckets, batch)``; the buckets touched."""
        batch = stored(batch, "batch")
        touched = sorted(r[0] for r in batch.select(self.number()).distinct().collect())
        if touched:
            self.write(with_target(self.read(batch.sparkSession, touched), batch))
        return touched


def upsert_nodes_stored(table: Bucketed, batch: DataFrame, order: Column | None = None) -> list[int]:
    """S11 on a stored node table: the batch's fields overwrite, the last row of a repeated key wins; the buckets touched."""
    (key,) = table.keys
    return table.merge(batch, lambda old, new: upsert_nodes(old, new, key, order))


def upsert_edges_stored(table: Bucketed, batch: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame, order: Column) -> list[int]:
    """S12 on a stored edge table of identity (src_id, dst_id)."""
    return table.merge(batch, lambda old, new: upsert_edges(old, new, src_nodes, dst_nodes, order))


def union_edges_stored(table: Bucketed, batch: DataFrame) -> list[int]:
    """U1 on a stored edge table: the set union of full rows."""
    return table.merge(batch.select(*table.schema.names), lambda old, new: old.unionByName(new).distinct())


def insert_new_stored(table: Bucketed, batch: DataFrame, order: Column) -> list[int]:
    """U7 on a stored node table: rows of unseen identity, the first of each in the order; existing rows stay."""
    keys = list(table.keys)

    def add(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(first_per(new, keys, [order]).join(old.select(*keys), keys, "left_anti").select(*old.columns))

    return table.merge(batch, add)
