"""Byte-bounded shards by extendible hashing, in DataFrame operations only.

A row's hash is 60 bits. The directory is indexed by hash-prefix bits: it starts with one bucket of
depth 0, and only a bucket whose rows exceed the byte limit splits on its next bit. All levels are
computed together from byte sums of fine prefix cells; rows of a cell that is still too large go on
to deeper cells, until every bucket fits or holds rows of one hash only.

Bytes are UTF-8 bytes of the text (null: 0). The hash covers doc_id and text, so rows that only
share a key part ways; identical rows cannot, nor can one row be cut: such a bucket comes out with
``over_limit`` true. Empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import scratch

BITS = 60
LIMIT = 32 << 20
EXTRA = 3  # bits of the fine cells beyond those that even splitting needs
STEP = 8
BROADCAST_CELLS = 100_000


def prefix(h: Column, depth: int | Column) -> Column:
    """The first ``depth`` bits of a 60-bit hash."""
    return F.expr(f"shiftright({h if isinstance(h, str) else '_h'}, {BITS} - {depth})")


def _hash(docs: DataFrame) -> Column:
    """The 60-bit hash of a row."""
    digest = F.md5(F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(F.coalesce(docs["text"], F.lit("")))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the 60-bit hash of each row."""
    size = F.octet_length(F.coalesce(docs["text"], F.lit(""))).cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), size.alias("n_bytes"), _hash(docs).alias("_h"))


def _leaves(cells: DataFrame, depth: int, top: int, limit: int) -> DataFrame:
    """The bucket of each fine cell: the shortest prefix of ``top`` bits or more whose rows fit."""
    tree = cells.select("*", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("_d")).withColumn("_p", F.expr(f"shiftright(_cell, {depth} - _d)"))
    nodes = tree.groupBy("_d", "_p").agg(F.sum("_bytes").alias("shard_bytes"), F.sum("_rows").alias("shard_rows"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    final = (F.col("shard_bytes") <= limit) | (F.col("_low") == F.col("_high"))
    fits = nodes.filter(final)
    return tree.join(fits, ["_d", "_p"]).groupBy("_cell").agg(F.min_by(F.struct("_d", "_p", "shard_bytes", "shard_rows"), "_d").alias("_leaf"))


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard (its prefix bits, ``*`` for none), depth, shard_bytes, over_limit."""
    return _placed(docs, limit).drop("_h")


def _placed(docs: DataFrame, limit: int) -> DataFrame:
    """``shard`` with each row's hash."""
    rows = scratch.table(hashed(docs), "hashed")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, top, out = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + EXTRA)), 0, None
    while True:
        keyed = rows.withColumn("_cell", prefix("_h", depth))
        cells = scratch.table(keyed.groupBy("_cell").agg(F.sum("n_bytes").alias("_bytes"), F.count("*").alias("_rows"), F.min("_h").alias("_low"), F.max("_h").alias("_high")), "cells")
        leaves = scratch.table(_leaves(cells, depth, top, limit), "directory")
        n_cells, n_leaves = cells.count(), leaves.count()
        side = F.broadcast(leaves) if n_leaves <= BROADCAST_CELLS else leaves
        part = keyed.join(side, "_cell").select(
            "_h",
            "doc_id",
            "n_bytes",
            F.when(F.col("_leaf._d") == 0, "*").otherwise(F.expr("lpad(bin(_leaf._p), _leaf._d, '0')")).alias("shard"),
            F.col("_leaf._d").cast("long").alias("depth"),
            F.col("_leaf.shard_bytes").alias("shard_bytes"),
            (F.col("_leaf.shard_bytes") > limit).alias("over_limit"),
        )
        out = part if out is None else out.unionByName(part)
        if n_cells == n_leaves:
            return out
        rows = scratch.table(keyed.join(cells.join(leaves, "_cell", "left_anti"), "_cell", "left_semi").drop("_cell"), "deeper")
        depth, top = min(BITS, depth + STEP), depth + 1


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Write the documents under ``path``, one folder a shard; returns the assignment.

    Every row goes to the shard of its hash, so repeated rows and rows without a doc_id are written as often as
    they stand in the table. The folders' column is ``shard``, with underscores before it where the table has that column.
    """
    placed = scratch.table(_placed(docs, limit), "shards")
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    where = placed.select(F.col("_h").alias("_hash"), F.col("shard").alias("_place")).distinct()
    joined = docs.join(where, _hash(docs) == where["_hash"])
    rows = joined.select(*[docs[f"`{c}`"] for c in docs.columns], where["_place"].alias(name))
    rows.repartition(name).write.partitionBy(name).parquet(path)
    return placed.drop("_h")


def oracle_sql(limit: int = LIMIT, bits: int = 24) -> str:
    """The same assignment in DuckDB, for inputs whose shards need at most ``bits`` bits or hold one hash only."""
    return f"""
WITH h AS (SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hv
           FROM documents),
t AS (SELECT h.*, d, hv >> (60 - d) AS p FROM h, generate_series(0, {bits}) AS g(d)),
n AS (SELECT d, p, sum(n_bytes)::BIGINT AS shard_bytes, min(hv) = max(hv) AS one FROM t GROUP BY d, p),
l AS (SELECT t.r, t.doc_id, t.n_bytes, t.d, t.p, n.shard_bytes, row_number() OVER (PARTITION BY t.r ORDER BY t.d) AS k
      FROM t JOIN n ON t.d = n.d AND t.p = n.p WHERE n.shard_bytes <= {limit} OR n.one)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '*' ELSE lpad(bin(p), d::INT, '0') END AS shard,
       d::BIGINT AS depth, shard_bytes, shard_bytes > {limit} AS over_limit FROM l WHERE k = 1
"""
