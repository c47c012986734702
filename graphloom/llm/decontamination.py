"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item's shingles are its distinct k-word shingles (A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``; an item of fewer words is one shingle of all of them). A document contains
an item when it holds at least ``percent`` per cent of these shingles.

Items are partitioned by size into classes of powers of two, and for a class of at most ``u`` shingles
a document is seen as overlapping windows of ``2 u`` shingles, so that a short item always meets a
window of its own size, however long the document. Items and windows are signed by one-permutation
MinHash with ``8 u`` bins, and one common minimum makes a candidate: with so many bins a shingle that
both hold is hidden in fewer than one case of eight, so that an item of 9 shingles at 80 % is missed
with probability below 1e-6. Classes of up to 8 shingles use every shingle as its own minimum. A
candidate is confirmed on the document's whole shingle set.

Items are a stated query set: they go over all documents in blocks of at most ``BLOCK_BYTES``, one
scan a block. Documents are never shuffled. Items without words match nothing, null texts hold
nothing. Rows repeated with one id give one result row each per distinct result; empty tables give
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import as_set, chunks, combine, word_lanes, words

BLOCK_BYTES = 8 << 20
_FILTER = np.uint64((1 << 22) - 1)


class ItemIndex:
    """The signatures of a block of items, by shingle length and size class."""

    def __init__(self, ids: list, texts: list[str], k: int, percent: int) -> None:
        self.ids, self.sets, self.lengths, self.percent = [], [], [], percent
        members: dict[tuple[int, int], list[int]] = {}
        for item, text in zip(ids, texts, strict=True):
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            starts, ends, _ = words(data, np.array([0, len(data)]))
            if len(starts):
                length = min(k, len(starts))
                grams = as_set(*combine(word_lanes(data, starts, ends), length))
                members.setdefault((length, 1 << (len(grams[0]) - 1).bit_length()), []).append(len(self.ids))
                self.ids.append(item)
                self.sets.append(grams)
                self.lengths.append(length)
        self.classes = []
        for (length, u), rows in sorted(members.items()):
            signs = [self.sets[i][0] if u <= 8 else _minima(self.sets[i][0], 8 * u) for i in rows]
            keys, owner = np.concatenate(signs), np.repeat(rows, [len(s) for s in signs])
            order = np.argsort(keys, kind="stable")
            maybe = np.zeros(int(_FILTER) + 1, dtype=bool)
            maybe[(keys & _FILTER).astype(np.int64)] = True
            self.classes.append((length, u, keys[order], owner[order], maybe))

    def search(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, shingles found, first and last word) of each confirmed pair of a chunk."""
        starts, ends, first = words(data, offs)
        lanes = word_lanes(data, starts, ends)
        pairs: set[tuple[int, int]] = set()
        grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length, u, keys, owner, maybe in self.classes:
            if length not in grams:
                grams[length] = combine(lanes, length)
            g = grams[length][0]
            own = _keys(g, 8 * u) if u > 8 else g
            at = np.flatnonzero(maybe[(own & _FILTER).astype(np.int64)])
            lo, hi = np.searchsorted(keys, own[at], "left"), np.searchsorted(keys, own[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            doc = np.searchsorted(first, at, side="right") - 1
            whole = at + length <= first[doc + 1]
            at, lo, hi, doc = at[whole], lo[whole], hi[whole], doc[whole]
            for row in np.unique(doc).tolist():
                mine = doc == row
                places, a, b = at[mine] - first[row], lo[mine], hi[mine]
                if u > 8:
                    least = _in_window(own[first[row] : first[row + 1] - length + 1], places, u)
                    a, b = a[least], b[least]
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    pairs.update((row, i) for i in owner[x:y].tolist())
        out = []
        for row, i in sorted(pairs):
            length = self.lengths[i]
            own = slice(first[row], max(first[row], first[row + 1] - length + 1))
            where, found = _held(grams[length][0][own], grams[length][1][own], *self.sets[i])
            if 100 * found >= self.percent * len(self.sets[i][0]):
                out.append((row, i, found, int(where[0]), int(where[-1]) + length - 1))
        return out


def _held(a: np.ndarray, b: np.ndarray, set_a: np.ndarray, set_b: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of a document's shingles that stand in a set, and how many of the set's they are, by all 128 bits."""
    where = np.flatnonzero(np.isin(a, set_a))
    at = np.searchsorted(set_a, a[where])
    same = set_b[at] == b[where]
    return where[same], len(np.unique(at[same]))


def _keys(grams: np.ndarray, bins: int) -> np.ndarray:
    """Bin and 32-bit value of each shingle in one number; within a bin they order as the values."""
    return ((grams >> np.uint64(32)) % np.uint64(bins)) << np.uint64(32) | grams & np.uint64(0xFFFFFFFF)


def _minima(grams: np.ndarray, bins: int) -> np.ndarray:
    keys = np.sort(_keys(grams, bins))
    bin_of = keys >> np.uint64(32)
    return keys[np.concatenate([[True], bin_of[1:] != bin_of[:-1]])]


def _in_window(keys: np.ndarray, places: np.ndarray, u: int) -> np.ndarray:
    """Which places hold the minimum of their bin in a window of two blocks of ``u`` shingles."""
    bins, blocks = 8 * u, -(-len(keys) // u)
    table = np.full((blocks + 1, bins), 0xFFFFFFFF, dtype=np.uint32)
    bin_of, value = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    np.minimum.at(table.reshape(-1), np.arange(len(keys)) // u * bins + bin_of, value)
    block, b, v = places // u, bin_of[places], value[places]
    after = np.minimum(table[block, b], table[block + 1, b])
    before = np.minimum(table[block, b], table[np.maximum(block - 1, 0), b])
    return (after == v) | (before == v)


SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_found long, first_word long, last_word long"


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document and item that it contains, with the span of words that its shingles lie in."""
    spark = docs.sparkSession
    asked = items.filter("text is not null").select(F.col("item_id").cast("long"), "text")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = ItemIndex([r[0] for r in rows], [r[1] for r in rows], k, percent)
        part = texts.mapInArrow(_searcher(index), SCHEMA) if index.ids else spark.createDataFrame([], SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _searcher(index: ItemIndex):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row + a, *rest) for a, _, data, offs in chunks(batch.column(1)) for row, *rest in index.search(data, offs)]
            row, item, n, first, last = zip(*found, strict=True) if found else ([],) * 5
            longs = [[index.ids[i] for i in item], [len(index.sets[i][0]) for i in item], n, first, last]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in longs]], names=["doc_id", "item_id", "n_item_shingles", "n_found", "first_word", "last_word"])

    return search


def without_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that contain no item. Each row is judged by its own text, whatever its doc_id; all columns stay."""
    key = lambda: F.xxhash64(docs["doc_id"].cast("long"), docs["text"])
    hit = contained_items(docs.select(key().alias("doc_id"), docs["text"]), items, k, percent).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, key() == hit["_hit"], "left_anti")


def oracle_sql(percent: int = 80) -> str:
    """The pairs with spans in DuckDB, for items of five words or more."""
    grams = "w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH q AS (SELECT item_id, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
qg AS (SELECT DISTINCT item_id, {grams} AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM q)),
n AS (SELECT item_id, count(*) AS n FROM qg GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS w FROM documents),
dg AS (SELECT doc_id, i, {grams} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
m AS (SELECT doc_id, item_id, count(DISTINCT qg.g) AS n_found, min(i) - 1 AS first_word, max(i) + 3 AS last_word
      FROM dg JOIN qg ON dg.g = qg.g GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_item_shingles, n_found, first_word, last_word FROM m JOIN n USING (item_id)
WHERE 100 * n_found >= {percent} * n
"""
