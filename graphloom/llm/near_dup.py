"""Near-duplicate documents by one-permutation MinHash.

A document's set is its distinct k-word shingles (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``);
with fewer words the whole sequence is one shingle. Two documents are linked when their sets'
Jaccard similarity reaches the threshold.

1. One pass makes the signature: one hash per shingle, its bins' minima, empty bins filled by optimal
   densification (each takes the value of a bin picked by its own fixed random sequence).
2. Documents with one and the same set become a class, so copies never meet each other again.
3. Class representatives share buckets by bands of the signature. In each bucket (in blocks of at
   most ``BLOCK`` members, dealt differently in each band) a maximum spanning forest of the
   signatures' similarities gives star-like candidate edges: at most one fewer than members, and
   as connected as all similar pairs together. They make families.
4. A family's full sets meet in blocks of bounded size, where posting lists give exact
   intersections; only a spanning set of the true links comes out. Where a family needs several
   blocks, about ``HUBS`` members visit all of them. Parts that this leaves apart are compared by a
   join on their rarest shingles (prefix filter), which loses no link, and confirmed on the texts;
   only members made of the family's common shingles almost wholly meet block by block.
5. Links are joined into components; every copy takes its class's.

No bucket or family is capped, no pair list of a group is written, and nothing but counts reaches the driver.
Null and empty texts have an empty set and are linked with nothing. Rows without a doc_id are left
out. Rows repeated with one doc_id count as one document, of texts that differ the one with the
least set hash; ties go to the least doc_id. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import scratch
from graphloom.llm.components import components
from graphloom.llm.text import chunks, mix, shingle_sets

BINS, ROWS = 96, 4  # 24 bands of 4: a pair at 0.8 misses all with probability 3e-6
BLOCK = 1024
FAMILY_SHINGLES = 1_000_000
FAMILY_ROWS = 512
HUBS = 16  # members of a family, about, that visit all its blocks
COMMON = 64  # members of a family that may hold a shingle by which pairs are joined
SLACK = 0.2  # estimated similarity may fall this far below the threshold (five standard errors)

FEATURES = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"
_PROBES = (mix(np.arange(BINS * 512, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, 512)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation MinHash with optimal densification: a 32-bit value per bin."""
    key = (shingles >> np.uint64(32)) % np.uint64(BINS) << np.uint64(32) | shingles & np.uint64(0xFFFFFFFF)
    key.sort()
    bins = (key >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(key), dtype=bool)
    np.not_equal(bins[1:], bins[:-1], out=first[1:])
    filled = np.zeros(BINS, dtype=bool)
    filled[bins[first]] = True
    values = np.zeros(BINS, dtype=np.uint64)
    values[bins[first]] = key[first] & np.uint64(0xFFFFFFFF)
    empty = np.flatnonzero(~filled)
    if len(empty):
        tries = _PROBES[empty]
        ok = filled[tries]
        pick = tries[np.arange(len(empty)), ok.argmax(axis=1)]
        pick[~ok.any(axis=1)] = bins[0]  # where 512 tries find none
        values[empty] = values[pick]
    return values


def features(docs: DataFrame, k: int) -> DataFrame:
    """Set size, set hash, band keys and signature (one byte a bin) of each document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_id = np.arange(BINS // ROWS, dtype=np.uint64) << np.uint64(48)
        for batch in batches:
            size, a, b, bands, signs = [], [], [], [], []
            for _, _, data, offs in chunks(batch.column(2)):
                for s, other in shingle_sets(data, offs, k):
                    size.append(len(s))
                    a.append(s.sum(dtype=np.uint64))
                    b.append(other.sum(dtype=np.uint64))
                    if len(s):
                        values = signature(s)
                        rows = values.reshape(-1, ROWS)
                        bands.append(mix(rows @ np.array([1, 0x9E3779B1, 0x85EBCA6B27D4EB2F, 0xC2B2AE3D27D4EB4F], dtype=np.uint64) + band_id).view(np.int64))
                        signs.append(mix(values).astype(np.uint8).tobytes())
                    else:
                        bands.append(np.zeros(0, np.int64))
                        signs.append(b"")
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), *longs, pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "signature"])

    return keyed(docs).mapInArrow(make, FEATURES)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and the text, of rows with a doc_id."""
    text = F.coalesce("text", F.lit(""))
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole runs of equal leading ``keys`` columns from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held)
        same = np.ones(table.num_rows - 1, dtype=bool)
        for c in range(keys):
            col = table.column(c).to_numpy()
            same &= col[1:] == col[:-1]
        cuts = np.flatnonzero(~same)
        if len(cuts):
            yield table.slice(0, int(cuts[-1]) + 1)
            held = table.slice(int(cuts[-1]) + 1).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for c in range(keys):
        col = table.column(c).to_numpy()
        new |= col[1:] != col[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])


def _forest(signs: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Maximum spanning forest of signature agreement, by Prim's rule, over pairs of at least ``least``."""
    n = len(signs)
    best, link, todo, out = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, dtype=bool), []
    at = 0
    for _ in range(n - 1):
        todo[at] = False
        same = (signs == signs[at]).mean(axis=1)
        nearer = todo & (same > best)
        best[nearer], link[nearer] = same[nearer], at
        at = int(np.where(todo, best, -2.0).argmax())
        if best[at] >= least:
            out.append((int(link[at]), at))
    return out


def candidate_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) whose connected parts hold every pair that a band shares and the signatures don't rule out."""
    least = threshold - SLACK
    entries = reps.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.table(entries.join(sizes, "bucket").select("doc_id", "bucket", F.pmod(F.xxhash64("doc_id", "bucket"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block")), "buckets")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            cuts = _bounds(table, 2)
            ids, signs = table.column("doc_id").to_numpy(), np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, BINS)
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]
            two = two[(signs[two] == signs[two + 1]).mean(axis=1) >= least]
            a, b = [ids[two]], [ids[two + 1]]
            for s, e in zip(cuts[:-1][size > 2].tolist(), cuts[1:][size > 2].tolist(), strict=True):
                found = np.array(_forest(signs[s:e], least), dtype=np.int64).reshape(-1, 2) + s
                a.append(ids[found[:, 0]])
                b.append(ids[found[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    signed = shared.join(reps.select("doc_id", "signature"), "doc_id").select("bucket", "block", "doc_id", "signature")
    dealt = signed.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "doc_id")
    return dealt.mapInArrow(pairs, "a long, b long").distinct()


def _links(sets: list[tuple[np.ndarray, np.ndarray]], asks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning set of the links (Jaccard in per cent of at least ``percent``) between asking rows and all rows.

    Shingles are the same when all their 128 bits are.
    """
    size = np.array([len(a) for a, _ in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    flat, other = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
    order = np.argsort(flat, kind="stable")
    flat, other, owner = flat[order], other[order], owner[order]
    root = np.arange(len(sets))
    out = []
    for i in np.flatnonzero(asks).tolist():
        lo, hi = np.searchsorted(flat, sets[i][0], "left"), np.searchsorted(flat, sets[i][0], "right")
        span = hi - lo
        upto = np.cumsum(span)
        take = np.repeat(lo - upto + span, span) + np.arange(upto[-1])
        same = other[take] == np.repeat(sets[i][1], span)
        both = np.bincount(owner[take[same]], minlength=len(sets))
        near = np.flatnonzero((100 * both >= percent * (size + size[i] - both)) & (both > 0))
        for j in near[root[near] != root[i]].tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return out


def _exact(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """True links (a, b) inside each (family, block) of members (family, block, doc_id, asks)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            ids, asks = (table.column(c).to_numpy() for c in ("doc_id", "asks"))
            cuts, text = _bounds(table, 2), table.column("text").combine_chunks()
            a, b = [], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if e - s > 1:
                    sets = [x for _, _, data, offs in chunks(text.slice(s, e - s)) for x in shingle_sets(data, offs, k)]
                    for i, j in _links(sets, asks[s:e], percent):
                        a.append(ids[s + i])
                        b.append(ids[s + j])
            a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    dealt = members.hint("merge").join(texts, "doc_id").select("family", "block", "doc_id", "asks", "text").repartition("family", "block").sortWithinPartitions("family", "block", "doc_id")
    return dealt.mapInArrow(link, "a long, b long").distinct()


def true_links(reps: DataFrame, docs: DataFrame, candidates: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect just what the true links connect."""
    families = components(candidates, "families").withColumnsRenamed({"node": "doc_id", "component": "family"})
    members = families.join(reps.select("doc_id", "text_hash", "n_shingles"), "doc_id")
    sizes = _blocks(members, "blocks").join(members.groupBy("family").agg(F.count("*").alias("size")), "family")
    members = scratch.table(members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "members")
    # Texts of members are drawn from the documents once, by a sort-merge join at every size: its skewed parts split.
    texts = keyed(docs).join(members.select("doc_id", "text_hash").hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id"])
    texts = scratch.table(texts.select("doc_id", "text"), "texts")
    hub = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("size")) < HUBS
    visits = F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("block")
    links = scratch.table(_exact(members.select("family", visits, "doc_id", F.lit(True).alias("asks")), texts, k, percent), "links")
    if not members.filter("blocks > 1").head(1):
        return links
    return _across_blocks(members, links, texts, k, percent)


def _across_blocks(members: DataFrame, links: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The links found so far as stars, and those between members of different blocks that join further parts.

    Two sets of Jaccard ``t`` share one of the rarest ``n - ceil(t n) + 1`` shingles of the larger and the rarest
    ``n - ceil(2 t / (1 + t) n) + 1`` of the smaller. So pairs come from a join on the family's shingles that at
    most ``COMMON`` of its members hold, ordered by how many do, and are then confirmed on the texts. Only
    where the commoner shingles reach into both beginnings, members of a family meet block by block, as they do
    where few are apart.
    """
    found = components(links, "parts").withColumnRenamed("node", "doc_id")
    stars = found.filter("doc_id <> component").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
    parts = scratch.table(members.filter("blocks > 1").join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "wide")
    ranked = parts.groupBy("family", "component").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("parts"))
    parts = parts.join(ranked.filter("parts > 1"), "family").withColumn("rest", F.col("component") != F.col("largest")).drop("largest", "parts")
    parts = scratch.table(parts.join(_blocks(parts.filter("rest"), "apart"), "family"), "open")
    # where one block holds all that is apart, it meets each block of the family once
    near = stars.unionByName(_block_pairs(parts.filter("apart = 1 and rest"), parts.filter("apart = 1"), texts, k, percent))
    parts = parts.filter("apart > 1")
    if not parts.head(1):
        return near
    held = scratch.table(_shingles(parts, texts, k), "shingles")
    common = held.groupBy("family", "shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
    marked = held.join(common, ["family", "shingle"], "left")
    rare = F.when(F.col("holders") <= COMMON, F.struct("holders", "shingle"))
    each = scratch.table(marked.groupBy("family", "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("holders").isNull()).alias("single"), F.array_sort(F.collect_list(rare)).alias("rare")), "rare")
    n, single = F.col("n"), F.col("single")
    asking = n - F.ceil(n * percent / 100) + 1
    asked = n - F.ceil(n * 2 * percent / (100 + percent)) + 1
    start = lambda most, role: parts.join(each, ["family", "doc_id"]).select("family", F.explode(F.slice("rare", F.lit(1), F.greatest(F.lit(0), most - single).cast("int"))).alias("s"), F.struct("n", "doc_id", "component", "rest").alias(role)).select("family", "s.shingle", role)
    met = start(asking, "x").join(start(asked, "y"), ["family", "shingle"]).filter("x.component <> y.component and x.n >= y.n").filter(F.col("y.n") * 100 >= F.col("x.n") * percent)
    pairs = scratch.table(met.select(F.greatest("x.doc_id", "y.doc_id").alias("a"), F.least("x.doc_id", "y.doc_id").alias("b")).distinct(), "pairs")
    both = pairs.select(F.col("a").alias("family"), F.col("b").alias("block"), F.explode(F.array("a", "b")).alias("doc_id"), F.lit(True).alias("asks"))
    joined = near.unionByName(scratch.table(_exact(both, texts, k, percent), "links"))
    # members whose beginnings hold common shingles: of the smaller sets' and of the larger sets'
    known = single + F.size("rare")
    full = parts.join(each.select("family", "doc_id", (known < asked).alias("deep"), (known < asking).alias("shallow")), ["family", "doc_id"]).filter("shallow")
    full = scratch.table(full.join(full.filter("deep").select("family").distinct(), "family", "left_semi"), "saturated")
    if not full.head(1):
        return joined
    first = _block_pairs(full.filter("deep and rest"), full, texts, k, percent)
    return joined.unionByName(first).unionByName(_block_pairs(full.filter("rest and not deep"), full.filter("deep and not rest"), texts, k, percent))


def _shingles(parts: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(family, doc_id, shingle) of the members' sets, by the first half of each hash."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offs in chunks(batch.column(2)):
                sets = [a for a, _ in shingle_sets(data, offs, k)]
                row = pa.array(np.repeat(np.arange(lo, lo + len(sets)), [len(a) for a in sets]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(sets).view(np.int64))], names=["family", "doc_id", "shingle"])

    rows = parts.select("family", "doc_id").hint("merge").join(texts, "doc_id").select("family", "doc_id", "text")
    return rows.mapInArrow(spread, "family long, doc_id long, shingle long")


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """(family, name): how many blocks its rows need."""
    most = F.greatest(F.ceil(F.sum("n_shingles") / FAMILY_SHINGLES), F.ceil(F.count("*") / FAMILY_ROWS))
    return rows.groupBy("family").agg(most.cast("int").alias(name))


def _block_pairs(asking: DataFrame, others: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between asking members and others of their family, in groups of one block of each."""
    sizes = scratch.table(_blocks(asking, "rows").join(_blocks(others, "columns"), "family"), "block-counts")
    place = lambda count: F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col(count)).cast("int")
    cell = lambda i, j: (i.cast("long") * F.col("columns") + j).alias("block")
    line = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    ask = asking.join(sizes, "family").select("*", line("columns").alias("_j")).select("family", cell(place("rows"), F.col("_j")), "doc_id", F.lit(True).alias("asks"))
    stay = others.join(sizes, "family").select("*", line("rows").alias("_i")).select("family", cell(F.col("_i"), place("columns")), "doc_id", F.lit(False).alias("asks"))
    # a member that asks and is asked in one group asks
    met = ask.unionByName(stay).groupBy("family", "block", "doc_id").agg(F.max("asks").alias("asks"))
    return scratch.table(_exact(met, texts, k, percent), "links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document of least id in its component), and the hash of the text that was judged."""
    made = features(docs, k)
    one = made.groupBy("doc_id").agg(F.min_by(F.struct(*made.columns), F.struct("set_a", "set_b", "text_hash")).alias("_one"))
    found = scratch.table(one.select("_one.*"), "features")
    classes = found.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    classes = scratch.table(classes, "classes")
    reps = scratch.table(found.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text_hash", "n_shingles", "bands", "signature"), "representatives")
    links = true_links(reps, docs, candidate_edges(reps, percent / 100), k, percent)
    joined = components(links, "linked").withColumnRenamed("node", "class_id")
    labels = classes.join(joined, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    rows = found.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b").join(labels.drop("class_id"), ["set_a", "set_b", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"), "text_hash")
