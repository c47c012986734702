"""Best-fit packing of token sequences into fixed-length training sequences.

Best-fit decreasing only looks at lengths, and a length is an integer of 1..capacity. So the
placement is computed once from the histogram of lengths (at most ``capacity`` rows, whatever the
corpus): pieces of one length are interchangeable, bins with one remaining capacity are too, and a
segment tree over remaining capacities finds the tightest open bin. The plan is a list of runs
"pieces rank_from.. of this length fill k each of the bins bin_from..", exactly what best-fit
decreasing does piece by piece. Spark then ranks the pieces of each length in hashed buckets and
looks each one up in the plan. No document, no group of documents and no list of bins is ever
gathered in one place.

Nulls: a null text counts as empty (one piece, the end token). Repeated rows and ties keep one
place each. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import scratch
from graphloom.llm.text import chunks
from graphloom.llm.word_ids import WordIds

CAPACITY = 4096
END_ID = 1
ROWS_PER_BUCKET = 1000
MOST_BUCKETS = 4096


class CapacityTree:
    """Segment tree over remaining capacities; a leaf holds how many open bins have that much room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += bins
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """Least room of at least ``need`` that some open bin has."""
        node = self.size + need
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, pieces per bin, offset of the first piece) of best-fit decreasing."""
    tree, rooms, runs, bins = CapacityTree(capacity), defaultdict(deque), [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            rooms[room].append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, math.ceil(left / (capacity // length))
                bins += n
            else:
                first, n = rooms[room].popleft()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                leave(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                runs.append((length, rank, first + full, left, capacity - room))
                leave(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(room, first + full, n - full)
    return runs


_loaded: dict[str, WordIds] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each document's ids by the tokenizer file, then the end id, cut into pieces of at most ``capacity``.

    The tokenizer's vocabulary must never join text across white space; each distinct word is then
    encoded once per task. ``with_ids`` adds the ids themselves as ``array<int>``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = WordIds(tokenizer)
        encoder = _loaded[tokenizer]
        for batch in batches:
            keys = batch.column(0)
            for a, b, data, offs in chunks(batch.column(1)):
                ids, upto = encoder.ids(data, offs)
                rows = np.arange(b - a)
                size = np.diff(upto) + 1
                flat = np.full(len(ids) + len(rows), END_ID, dtype="<u4")  # each document's ids, then the end id
                flat[np.arange(len(ids)) + np.repeat(rows, size - 1)] = ids
                n = -(-size // capacity)
                row = np.repeat(rows, n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                first = (np.cumsum(size) - size)[row] + start
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(first.tolist(), (first + length).tolist(), strict=True)]
                cols = [keys.take(pa.array(a + row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    bounds = np.append(first, len(flat)).astype(np.int32)
                    cols, names = [*cols, pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1..capacity, keyed by doc_id, piece.

    ``pieces`` is read twice, so give a stored table.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(best_fit_decreasing(histogram, capacity), dtype=np.int64).reshape(-1, 5)
    length, rank, first, each, base = runs[np.lexsort((runs[:, 1], runs[:, 0]))].T
    keys = (length << 40) + rank

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, r: pd.Series) -> pd.DataFrame:
        n, r = n.to_numpy(), r.to_numpy()
        i = np.searchsorted(keys, (n << 40) + r, side="right") - 1
        j = r - rank[i]
        return pd.DataFrame({"sequence_id": first[i] + j // each[i], "offset": base[i] + j % each[i] * n})

    buckets = min(MOST_BUCKETS, max(1, math.ceil(max(histogram.values(), default=0) / ROWS_PER_BUCKET)))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    cells = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1).join(cells, ["length", "_bucket"])
    placed = ranked.withColumn("_place", place("length", (F.col("_before") + F.col("_rank")).cast("long")))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut, store and pack the documents: one row per piece with its sequence and offset."""
    return pack(scratch.table(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)
