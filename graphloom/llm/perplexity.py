"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes, of order 5, so it needs no vocabulary and treats every language and script
alike. Trusted text (labelled quality 1 and not toxic) is counted in full: each task counts its
5-grams, Spark sums them, and the lower orders' continuation counts, the counts of counts, discounts,
context weights and interpolated probabilities all come from joins and aggregates of these count
tables, sharded by gram. A text's perplexity per byte comes from the probabilities of its 5-grams:
when the tables have at most ``BROADCAST_GRAMS`` rows (checked) they go to the tasks; beyond that the
texts' grams are counted and joined to the tables, shard by shard. Log probabilities are whole numbers of
``1 / SCALE``, so their sums are exact and both ways give the very same result.

The mean of few bytes is uncertain, so a text of n bytes is judged by its perplexity times
``exp(-LENIENCE / sqrt(n))``. It is kept when that is at most ``SLACK`` times the ``QUANTILE`` of its
language's trusted documents. For these quantiles a fifth of the trusted documents, by a hash of their id, is
left out of the counts. A language without any takes the quantile over all.

A null or empty text has no perplexity and is not kept. A null language is a language of its own.
Rows that repeat a doc_id are scored each; labels that repeat count as trusted if any row is.
Without trusted documents there is no threshold and every text is kept. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import scratch
from graphloom.llm.text import chunks

ORDER = 5
BROADCAST_GRAMS = 4_000_000
BROADCAST_LABELS = 1_000_000
QUANTILE, SLACK, LENIENCE = 0.99, 1.05, 1.5
HELD_OUT = 5
SCALE = 1 << 20
_BYTE = -round(math.log(256) * SCALE)
_STEP = 1000  # perplexities are compared in thousandths


def _codes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The 5-gram that ends in each byte, as a 40-bit number; before a text stand line feeds."""
    n = len(offs) - 1
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * (ORDER - 1), np.diff(offs))
    padded = np.full(len(data) + n * (ORDER - 1), 0x0A, dtype=np.int64)
    padded[at] = data
    code = padded[at]
    for j in range(1, ORDER):
        code |= padded[at - j] << (8 * j)
    return code


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n) over all texts of a one-column table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                held.append(np.unique(_codes(data, offs), return_counts=True))
                if sum(len(k) for k, _ in held) > 2_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield from _counted(*held.pop())
        if held:
            yield from _counted(*merged())

    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _counted(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], names=["gram", "n"])


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the counts of counts."""
    n = {r["n"]: r["k"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.1), i - 0.1) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Probabilities (size, gram, logp) and context weights (size, context, logw) of all orders."""
    counts = {ORDER: scratch.table(gram_counts(texts), "grams")}
    for size in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("gram")
        counts[size] = scratch.table(counts[size + 1].groupBy(suffix).agg(F.count("*").alias("n")), "grams")
    lower, probs, weights = None, None, None
    whole = lambda c: F.round(c * SCALE).cast("int")
    for size in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counts[size])
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = counts[size].withColumn("context", F.shiftright("gram", 8)).withColumn("cut", discount)
        context = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"))
        joined = rows.join(context, "context").withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1)))
        if lower is None:
            p_lower = F.lit(1 / 256)
        else:
            joined = joined.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("p_lower")), "suffix")
            p_lower = F.col("p_lower")
        p = (F.col("n") - F.col("cut") + F.col("cuts") * p_lower) / F.col("total")
        lower = scratch.table(joined.select("gram", p.alias("p")), "probabilities")
        level = lower.select(F.lit(size).alias("size"), "gram", whole(F.log("p")).alias("logp"))
        weight = context.select(F.lit(size).alias("size"), "context", whole(F.log(F.col("cuts") / F.col("total"))).alias("logw"))
        probs = level if probs is None else probs.unionByName(level)
        weights = weight if weights is None else weights.unionByName(weight)
    return scratch.table(probs, "model"), scratch.table(weights, "model")


class _Tables:
    """The model as sorted arrays, for one task."""

    def __init__(self, probs: DataFrame, weights: DataFrame) -> None:
        self.levels = []
        for table, key, value in ((probs, "gram", "logp"), (weights, "context", "logw")):
            rows = table.select("size", key, value).toArrow()
            size, keys, values = (rows.column(c).to_numpy() for c in ("size", key, value))
            for n in range(1, ORDER + 1):
                mine = size == n
                order = np.argsort(keys[mine])
                self.levels.append((keys[mine][order], values[mine][order]))

    def logp(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each gram: the longest known gram, and the weights of the contexts passed."""
        out, left, at = np.zeros(len(codes), np.int64), codes, np.arange(len(codes))
        for size in range(ORDER, 0, -1):
            grams, logp = self.levels[size - 1]
            here = left & ((1 << 8 * size) - 1)
            i = np.minimum(np.searchsorted(grams, here), max(0, len(grams) - 1))
            known = grams[i] == here if len(grams) else np.zeros(len(here), bool)
            out[at[known]] += logp[i[known]]
            at, left, here = at[~known], left[~known], here[~known]
            contexts, logw = self.levels[ORDER + size - 1]
            i = np.minimum(np.searchsorted(contexts, here >> 8), max(0, len(contexts) - 1))
            seen = contexts[i] == here >> 8 if len(contexts) else np.zeros(len(here), bool)
            out[at[seen]] += logw[i[seen]]
        out[at] += _BYTE
        return out


def _score_in_tasks(rows: DataFrame, probs: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, lang, text_hash, n_bytes, total) with the model in each task."""
    tables = rows.sparkSession.sparkContext.broadcast(_Tables(probs, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offs in chunks(batch.column(2)):
                codes, back = np.unique(_codes(data, offs), return_inverse=True)
                upto = np.concatenate([[0], np.cumsum(tables.value.logp(codes)[back])])
                size.append(np.diff(offs))
                total.append(upto[offs[1:]] - upto[offs[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(np.concatenate(size)), pa.array(np.concatenate(total))], names=["doc_id", "lang", "text_hash", "n_bytes", "total"])

    return rows.mapInArrow(score, "doc_id long, lang string, text_hash long, n_bytes long, total long")


def _score_by_joins(rows: DataFrame, probs: DataFrame, weights: DataFrame) -> DataFrame:
    """The same from joins of each text's counted grams with the model's shards."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offs in chunks(batch.column(2)):
                codes = _codes(data, offs)
                for row in range(len(offs) - 1):
                    keys, n = np.unique(codes[offs[row] : offs[row + 1]], return_counts=True)
                    same = pa.array(np.full(len(keys), lo + row))
                    yield pa.RecordBatch.from_arrays([batch.column(4).take(same), pa.array(keys), pa.array(n)], names=["row", "gram", "n"])

    keyed = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "keyed")
    left, sums, passed = keyed.select("doc_id", "lang", "text", "text_hash", "row").mapInArrow(grams, "row long, gram long, n long").withColumn("passed", F.lit(0).cast("long")), None, F.col("passed")
    for size in range(ORDER, 0, -1):
        own = F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1))
        p = probs.filter(F.col("size") == size).select(F.col("gram").alias("_g"), "logp")
        w = weights.filter(F.col("size") == size).select(F.col("context").alias("_c"), "logw")
        joined = left.withColumn("_g", own).join(p, "_g", "left").withColumn("_c", F.shiftright("_g", 8)).join(w, "_c", "left")
        joined = scratch.table(joined.select("row", "gram", "n", "logp", passed.alias("before"), (passed + F.coalesce("logw", F.lit(0))).alias("passed")), "scored")
        part = joined.filter("logp is not null").select("row", (F.col("n") * (F.col("before") + F.col("logp"))).alias("s"), "n")
        sums = part if sums is None else sums.unionByName(part)
        left = joined.filter("logp is null").select("row", "gram", "n", "passed")
    sums = sums.unionByName(left.select("row", (F.col("n") * (F.col("passed") + _BYTE)).alias("s"), "n"))
    total = sums.groupBy("row").agg(F.sum("n").alias("n_bytes"), F.sum("s").alias("total"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return keyed.join(total, "row", "left").select("doc_id", "lang", "text_hash", zero("n_bytes", "long"), zero("total", "long"))


def score(docs: DataFrame, probs: DataFrame, weights: DataFrame, most_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, lang, text_hash, n_bytes, perplexity per byte and the judged one of each whole text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    fits = probs.count() + weights.count() <= most_grams
    scored = (_score_in_tasks if fits else _score_by_joins)(rows, probs, weights)
    mean = -F.col("total") / SCALE / F.col("n_bytes")
    filled = lambda c, name: F.when(F.col("n_bytes") > 0, F.exp(c)).alias(name)
    return scored.select("doc_id", "lang", "text_hash", "n_bytes", filled(mean, "perplexity"), filled(mean - LENIENCE / F.sqrt("n_bytes"), "judged"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic, and whether each is held out for the quantiles."""
    ids = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.withColumn("held_out", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0)


def _quantiles(scored: DataFrame, quantile: float) -> DataFrame:
    """(lang, threshold): the exact quantile, in thousandths, of the rows of each language, and of all under null key ``every``."""
    bins = scored.filter("judged is not null").groupBy("lang", F.ceil(F.col("judged") * _STEP).alias("bin")).agg(F.count("*").alias("n"))
    both = bins.withColumn("every", F.lit(False)).unionByName(bins.withColumn("lang", F.lit(None).cast("string")).withColumn("every", F.lit(True)))
    bins = both.groupBy("every", "lang", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("every", "lang")
    placed = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return placed.filter(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy("every", "lang").agg((F.min("bin") / _STEP).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, most_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, judged, threshold and kept of each document, and the hash of its text."""
    trusted = scratch.table(trusted_ids(labels), "trusted")
    small = trusted.count() <= BROADCAST_LABELS
    learn = trusted.filter("not held_out").select("doc_id")
    texts = docs.filter("text is not null").join(F.broadcast(learn) if small else learn, "doc_id", "left_semi").select("text")
    probs, weights = train(texts)
    scored = scratch.table(score(docs, probs, weights, most_grams), "scored")
    limits = scratch.table(_quantiles(scored.join(trusted.filter("held_out"), "doc_id", "left_semi"), quantile), "limits")
    own = limits.filter("not every").select(F.col("lang").alias("_lang"), F.col("threshold").alias("_own"))
    every = limits.filter("every").select(F.col("threshold").alias("_all"))
    fallback: Column = F.lit((every.first() or [None])[0]).cast("double")
    rows = scored.join(F.broadcast(own) if own.count() <= 10_000 else own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    rows = rows.withColumn("threshold", F.coalesce("_own", fallback) * slack)
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("judged") <= F.col("threshold"), F.lit(True))
    return rows.select("doc_id", "lang", "n_bytes", "perplexity", "judged", "threshold", kept.alias("kept"), "text_hash")
