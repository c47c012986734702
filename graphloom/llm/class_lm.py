"""Language-model scoring by Brown classes: exchange clustering, class trigrams and word emissions.

The probability of a token is that of its class after the two classes before it, times that of the token in its
class. Words get classes by exchange: a word moves to the class under which the likelihood of the class bigrams is highest.
The words of most tokens (``CORE`` at most) are exchanged over several rounds from the counts of their bigrams, all
movers of a round in parallel against the counts of the round before, half of them at a time after the first;
the most frequent ones start as a class each. Every other word of at least ``LEAST`` tokens (``KNOWN`` words at most
with the core, by count) then moves once, to the class that its neighbours' classes make likeliest. Words of fewer tokens
share the class of the rare; they are proxies for unseen ones, which take the part that absolute
discounting leaves there. Class trigrams are smoothed by interpolated absolute discounting. For every history the
probabilities of all words and of one unknown word sum to one.

Counts cover all training texts. Only tables of bounded size go to the driver and the tasks: the known words, the
counts of class bigrams and trigrams. Counts of rare words stay a Spark table, joined to the rare tokens of the texts.

A text's tokens are its words (A-Z folded) and one end, which also stands before the text. A null or empty text is its end.
Rows that repeat are learnt and scored each; a null doc_id counts as an empty text for the split. Without training texts
every token is unknown. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import scratch
from graphloom.llm.text import chunks, distinct, mix, word_keys, words

CLASSES = 128  # the first is the end's, the last that of rare words
CORE, KNOWN, LEAST = 1 << 14, 1 << 20, 8
ROUNDS = 5
FOLDS, FOLD = 7, 2
END = 0  # id and class of the end
_STEPS = 8  # count steps per doubling in which the limits on words are met
_FLUSH = 1_000_000


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training, by its id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == FOLD


def _summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    at, which = distinct(*keys)
    return [k[at] for k in keys], np.bincount(which, weights=n, minlength=len(at)).astype(np.int64)


class _Tally:
    """Counts of keys (some arrays) that are summed as they grow and handed on when they are many."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.held = names, []

    def add(self, keys: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, n))
        if sum(len(n) for _, n in self.held) > 2 * _FLUSH:
            self._sum()
            if len(self.held[0][1]) > _FLUSH:
                yield from self.rest()

    def _sum(self) -> None:
        self.held = [_summed([np.concatenate(k) for k in zip(*(k for k, _ in self.held), strict=True)], np.concatenate([n for _, n in self.held]))]

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._sum()
            keys, n = self.held.pop()
            for lo in range(0, len(n), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[lo : lo + 100_000].view(np.int64)) for k in keys] + [pa.array(n[lo : lo + 100_000])], names=[*self.names, "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(lo, hi, n): tokens of each word of a one-column table by the word's 128-bit key; the end's key is 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(["lo", "hi"])
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                starts, ends, _ = words(data, offs)
                keys, n = _summed(list(word_keys(data, starts, ends)), np.ones(len(starts)))
                yield from tally.add([np.append(k, np.uint64(0)) for k in keys], np.append(n, len(offs) - 1))
        yield from tally.rest()

    return texts.mapInArrow(count, "lo long, hi long, n long").groupBy("lo", "hi").agg(F.sum("n").alias("n"))


class Known:
    """The known words: ids by rank of count, the end first; ids below ``core`` are exchanged."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, core: int) -> None:
        is_end = (lo == 0) & (hi == 0)
        order = np.lexsort((lo, hi, -n, ~is_end))
        self.n, self.core = n[order], core
        lo, hi = lo[order], hi[order]
        self.seed = 0
        while len(np.unique(fold := self._fold(lo, hi))) < len(lo):
            self.seed += 1
        by = np.argsort(fold)
        self.fold, self.lo, self.hi, self.at = fold[by], lo[by], hi[by], by

    def _fold(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix(lo + np.uint64(self.seed)) + hi

    def ids(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The id of each key, -1 where it is not known."""
        i = np.minimum(np.searchsorted(self.fold, self._fold(lo, hi)), len(self.fold) - 1)
        return np.where((self.lo[i] == lo) & (self.hi[i] == hi), self.at[i], -1)


def _least(steps: dict[int, int], most: int) -> int:
    """The lowest count step from which on there are at most ``most`` words."""
    total, least = 0, max(steps, default=0) + 1
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > most:
            break
        least = step
    return least


def known_words(table: DataFrame, core: int = CORE, known: int = KNOWN, least: int = LEAST) -> tuple[Known, DataFrame]:
    """The known words, and the counts (lo, hi, n) of all others; where limits cut is found from counts of counts, ties stay together."""
    step = F.floor(F.log2("n") * _STEPS).cast("int")
    table = table.withColumn("step", step).withColumn("end", (F.col("lo") == 0) & (F.col("hi") == 0))
    steps = {r["step"]: r["k"] for r in table.filter(f"n >= {least} and not end").groupBy("step").agg(F.count("*").alias("k")).collect()}
    cut = _least(steps, known - 1)
    is_known = F.col("end") | ((F.col("n") >= least) & (F.col("step") >= cut))
    rows = table.filter(is_known).select("lo", "hi", "n").toArrow()
    lo, hi, n = (rows.column(c).to_numpy() for c in ("lo", "hi", "n"))
    if not len(n):
        lo, hi, n = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    top = _least(steps, core - 1)
    n_core = 1 + sum(k for s, k in steps.items() if s >= max(top, cut))
    return Known(lo.view(np.uint64), hi.view(np.uint64), n, n_core), table.filter(~is_known).select("lo", "hi", "n")


def _sequence(known: Known, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Ids of all tokens with each text's end, where each text begins, and the keys of the tokens as (lo, hi, document, id)."""
    starts, ends, first = words(data, offs)
    lo, hi = word_keys(data, starts, ends)
    n_docs = len(offs) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    if len(starts):
        at, which = distinct(lo, hi)
        ids = known.ids(lo[at], hi[at])[which]
    else:
        ids = np.zeros(0, np.int64)
    out = np.full(len(starts) + n_docs, END, np.int64)
    out[np.arange(len(starts)) + doc] = ids
    return out, np.append(first[:-1] + np.arange(n_docs), len(out)), (lo, hi, doc, ids)


def bigram_counts(texts: DataFrame, known) -> DataFrame:
    """(pair, n) of neighbouring tokens, words outside the core as one; pair = left * (core + 1) + right."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, core = _Tally(["pair"]), known.value.core
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                ids, _, _ = _sequence(known.value, data, offs)
                ids = np.where((ids < 0) | (ids >= core), core, ids)
                pair, n = np.unique(np.append(END, ids[:-1]) * (core + 1) + ids, return_counts=True)
                yield from tally.add([pair.view(np.uint64)], n)
        yield from tally.rest()

    return texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _class_bigrams(pairs: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Counts of class bigrams."""
    m = len(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(k * k, np.int64)
        for batch in batches:
            pair = batch.column(0).to_numpy()
            table += np.bincount(classes[pair // m] * k + classes[pair % m], weights=batch.column(1).to_numpy(), minlength=k * k).astype(np.int64)
        slot = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(table[slot])], names=["slot", "n"])

    rows = pairs.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(k, k)


def _contexts(pairs: DataFrame, classes: np.ndarray, moving: np.ndarray, k: int) -> DataFrame:
    """(slot, n) of the moving words: slot = word * 2k + the class behind it, or k + the class before it."""
    m = len(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(["slot"])
        for batch in batches:
            pair, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a, b = pair // m, pair % m
            slot = np.concatenate([(a * 2 * k + classes[b])[moving[a]], (b * 2 * k + k + classes[a])[moving[b]]])
            yield from tally.add([slot.view(np.uint64)], np.concatenate([n[moving[a]], n[moving[b]]]))
        yield from tally.rest()

    return pairs.mapInArrow(count, "slot long, n long")


def _far_contexts(texts: DataFrame, known, classes: np.ndarray, k: int) -> DataFrame:
    """The same of the known words outside the core, from the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, core = _Tally(["slot"]), known.value.core
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                ids, _, _ = _sequence(known.value, data, offs)
                around = np.concatenate([[END], classes[np.where((ids < 0) | (ids >= core), core, ids)]])
                at = np.flatnonzero(ids >= core)
                slot = np.concatenate([ids[at] * 2 * k + around[at + 2], ids[at] * 2 * k + k + around[at]])
                slot, n = np.unique(slot, return_counts=True)
                yield from tally.add([slot.view(np.uint64)], n)
        yield from tally.rest()

    return texts.mapInArrow(count, "slot long, n long")


def _phi(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0.0)
    return x * np.log(np.maximum(x, 1.0))


def best_classes(slots: np.ndarray, n: np.ndarray, heads: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class with the highest likelihood of each word, taken out of its own first.

    ``slots`` and ``n`` are the words' contexts one after the other, ``heads`` where each begins, ``own`` the words' classes.
    """
    k = len(table)
    seen = np.concatenate([table.T, table])  # by context, over the classes a word may take
    size = np.diff(np.append(heads, len(slots)))
    word = np.repeat(np.arange(len(heads)), size)
    gain = np.zeros((len(heads), k))
    for lo in range(0, len(slots), 8192):
        part = slice(lo, lo + 8192)
        rest = seen[slots[part]]
        rows = np.arange(len(rest))
        rest[rows, own[word[part]]] -= n[part]
        more = _phi(rest + n[part, None]) - _phi(rest)
        cut = np.flatnonzero(np.append(True, word[part][1:] != word[part][:-1]))
        gain[word[part][cut]] += np.add.reduceat(more, cut, axis=0)
    for side, total in ((slots < k, table.sum(axis=1)), (slots >= k, table.sum(axis=0))):
        mine = np.bincount(word, weights=n * side, minlength=len(heads))
        for lo in range(0, len(heads), 8192):
            part = slice(lo, lo + 8192)
            rest = np.repeat(total[None, :], len(mine[part]), axis=0)
            rest[np.arange(len(rest)), own[part]] -= mine[part]
            gain[part] -= _phi(rest + mine[part, None]) - _phi(rest)
    gain[:, [END, k - 1]] = -np.inf
    return gain.argmax(axis=1)


def _moved(contexts: DataFrame, table: np.ndarray, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, class) of each word of the contexts; words beyond ``classes`` are rare so far."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, offs = lists.flatten(), lists.offsets.to_numpy()
            word = batch.column(0).to_numpy()
            own = np.where(word < len(classes), classes[np.minimum(word, len(classes) - 1)], k - 1)
            heads = offs[:-1] - offs[0]
            found = best_classes(flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(float), heads, own, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=["word", "class"])

    rows = contexts.select(F.floor(F.col("slot") / (2 * k)).alias("word"), (F.col("slot") % (2 * k)).cast("int").alias("slot"), "n")
    sums = rows.repartition("word").groupBy("word", "slot").agg(F.sum("n").alias("n"))
    lists = sums.groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("contexts"))
    out = lists.mapInArrow(choose, "word long, class int").toArrow()
    return out.column("word").to_numpy(), out.column("class").to_numpy()


def exchange(texts: DataFrame, known, k: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each known word by its id, and of the rare as the last entry."""
    core, size = known.value.core, len(known.value.n)
    pairs = scratch.table(bigram_counts(texts, known), "bigrams")
    classes = np.full(core + 1, k - 1, np.int64)
    classes[END] = END
    seeds = min(core, k - 1)
    classes[1:seeds] = np.arange(1, seeds)
    for turn in range(rounds):
        moving = np.zeros(core + 1, bool)
        moving[seeds if turn == 0 else 1 : core] = True
        if turn:
            moving &= np.arange(core + 1) % 2 == turn % 2
        if moving.any():
            word, found = _moved(_contexts(pairs, classes, moving, k), _class_bigrams(pairs, classes, k), classes, k)
            classes[word] = found
    out = np.full(size + 1, k - 1, np.int64)
    out[:core] = classes[:core]
    if size > core:
        word, found = _moved(_far_contexts(texts, known, classes, k), _class_bigrams(pairs, classes, k), classes, k)
        out[word] = found
    return out


@dataclass(frozen=True)
class Model:
    """Log10 probabilities: ``emit`` by id (the last entry is unused), ``after`` of a class after two others; counts and discount of the rare."""

    classes: np.ndarray
    emit: np.ndarray
    after: np.ndarray
    tokens: int
    types: int
    rare_tokens: int
    discount: float
    unknown: float


def _interpolated(counts: np.ndarray) -> np.ndarray:
    """Probabilities of the last class after the two before it, discounted at each order."""
    k = counts.shape[0]
    one = counts.sum(axis=(0, 1))
    p = (one + 1.0 / k) / (one.sum() + 1.0)
    for table in (counts.sum(axis=0), counts):
        n1, n2 = float((table == 1).sum()), float((table == 2).sum())
        cut = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 and n2 else 0.5
        total, kinds = table.sum(axis=-1, keepdims=True), (table > 0).sum(axis=-1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            mixed = (np.maximum(table - cut, 0) + cut * kinds * p) / total
        p = np.where(total > 0, mixed, np.broadcast_to(p, table.shape))
    return p


def _before(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes two and one before each token; a text has ends before it."""
    one = np.append(END, classes[:-1])
    two = np.append(END, one[:-1])
    return np.where(one == END, END, two), one


_SEQUENCES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, emit double, classes binary, lo array<long>, hi array<long>, k array<int>"


def sequences(docs: DataFrame, known, classes: np.ndarray, emit: np.ndarray, tokens: int, types: int) -> DataFrame:
    """Each text's classes, the sums of its known tokens, and the keys and numbers of its other tokens."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        base_of = np.append(np.log10(known.value.n + 1.0) - math.log10(tokens + types + 1), 0.0)
        for batch in batches:
            for at, end, data, offs in chunks(batch.column(2)):
                ids, bounds, (lo, hi, doc, plain) = _sequence(known.value, data, offs)
                is_known = (ids >= 0) & (known.value.n[ids] > 0)  # an end is unknown where nothing was learnt
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (is_known.astype(np.int64), base_of[ids], emit[ids])]
                far = np.flatnonzero(plain < 0)
                keys, n = _summed([doc[far].astype(np.uint64), lo[far], hi[far]], np.ones(len(far))) if len(far) else ([far.astype(np.uint64)] * 3, far)
                order = np.argsort(keys[0], kind="stable")
                cuts = pa.array(np.searchsorted(keys[0][order], np.arange(len(offs), dtype=np.uint64)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order])) for x in (keys[1].view(np.int64), keys[2].view(np.int64), n.astype(np.int32))]
                seq = classes[ids].astype(np.uint8).tobytes()
                parts = pa.array([seq[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                some = [c.slice(at, end - at) for c in (batch.column(0), batch.column(1))]
                own = pa.array(np.arange(row, row + end - at))
                row += end - at
                yield pa.RecordBatch.from_arrays([own, *some, pa.array(np.diff(bounds)), *map(pa.array, sums), parts, *lists], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "emit", "classes", "lo", "hi", "k"])

    return docs.mapInArrow(read, _SEQUENCES)


def _class_trigrams(seqs: DataFrame, k: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(k**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                c = np.frombuffer(text.as_buffer(), np.uint8).astype(np.int64)
                two, one = _before(c)
                slot, n = np.unique((two * k + one) * k + c, return_counts=True)
                table[slot] += n
        slot = np.flatnonzero(table)
        for lo in range(0, len(slot), 100_000):
            part = slot[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part])], names=["slot", "n"])

    rows = seqs.select("classes").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k**3)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(k, k, k)


def fit_and_score(docs: DataFrame, k: int = CLASSES, rounds: int = ROUNDS, core: int = CORE, known_most: int = KNOWN, least: int = LEAST) -> tuple[Model, DataFrame]:
    """The model, and doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.filter("not held_out").select("text")
    counts = scratch.table(word_counts(texts), "words")
    told = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).first()
    tokens, types = told["n"] or 0, told["v"]
    words_known, rare = known_words(counts, core, known_most, least)
    known = spark.sparkContext.broadcast(words_known)
    classes = exchange(texts, known, k, rounds)
    totals = np.bincount(classes[:-1], weights=words_known.n, minlength=k)
    rare_tokens, rare_types = tokens - int(words_known.n.sum()), types - int((words_known.n > 0).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        emit = np.append(np.where(words_known.n > 0, np.log10(words_known.n / totals[classes[:-1]]), 0.0), 0.0)
    cut = told["n1"] / (told["n1"] + 2 * told["n2"]) if told["n1"] and told["n2"] else 0.5
    unknown = math.log10(cut * rare_types / rare_tokens) if rare_tokens else 0.0
    seqs = scratch.table(sequences(rows.select("doc_id", "held_out", "text"), known, classes, emit, tokens, types), "sequences")
    after = np.log10(_interpolated(_class_trigrams(seqs.filter("not held_out"), k)))
    model = Model(classes, emit, after, tokens, types, rare_tokens, cut, unknown)
    return model, _scores(seqs, rare, model, spark.sparkContext.broadcast(after))


def _scores(seqs: DataFrame, rare: DataFrame, model: Model, after) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(7):
                c = np.frombuffer(text.as_buffer(), np.uint8)
                out.append(float(after.value[(*_before(c), c)].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(out, pa.float64())], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "emit", "transit"])

    whole = seqs.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "emit", "classes").mapInArrow(add, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, emit double, transit double")
    left = seqs.filter(F.size("lo") > 0).select("row", F.explode(F.arrays_zip("lo", "hi", "k")).alias("x")).select("row", "x.*")
    seen = left.join(rare, ["lo", "hi"], "left")
    floor = math.log10(model.tokens + model.types + 1)
    base = F.log10(F.coalesce("n", F.lit(0)) + 1.0) - floor
    emit = F.when(F.col("n").isNull(), model.unknown).otherwise(F.log10(F.col("n") - model.discount) - (math.log10(model.rare_tokens) if model.rare_tokens else 0.0))
    sums = seen.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("far_known"), F.sum(F.col("k") * base).alias("far_base"), F.sum(F.col("k") * emit).alias("far_emit"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = whole.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("far_known")).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("far_base")).alias("base_score"), (F.col("transit") + F.col("emit") + zero("far_emit")).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score(docs: DataFrame, k: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """The scores of all rows under the model learnt from those not held out."""
    return fit_and_score(docs, k, rounds)[1]
