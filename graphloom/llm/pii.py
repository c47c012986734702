"""Personal data: fixed patterns, and terms that give a protected entity away.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers, leftmost and
non-overlapping for each kind; a match that fails its check is dropped without a retry. Protected
entities are every distinct value and every mail domain. For the words near their mentions (``WINDOW``
words to either side) corpus co-occurrence tells how much they reveal: with ``p(e)`` the share of the corpus's words
that are mentions of ``e``, and ``p(e|t)`` the share of the term's occurrences in the whole corpus that
lie near a mention of ``e``, the pointwise mutual information ``log p(e|t) / p(e)`` is divided by the
entity's information content ``-log p(e)``: 1 says that the term stands for the entity. At ``GENERALISE`` a term is
replaced by a placeholder of its kind, at ``REMOVE`` it is removed. A pair needs ``EVIDENCE``
different neighbourhoods (neighbouring words), so that copies of one text prove nothing. A term that
reveals any entity is treated wherever it stands in the corpus, by its largest disclosure.

A secret (a key, a token, a password) needs no mention near it: the entity that it gives away is the very
place where it stands. Candidates are runs of ``OPAQUE`` or more characters ``[A-Za-z0-9+/_-]`` that change between
letters and digits ``CHANGES`` times or more, outside the patterns' spans. One is protected when the pairs of bytes of
the rest of the corpus give it ``BITS`` bits of information or more, and when its neighbourhoods (the words
before and after it) are so few that ``p(place|t) = 1 / neighbourhoods`` gives a disclosure of ``SECRET``, with
``p(place)`` one of the corpus's positions; copies of one place count once.

Spans are code points of the whole text, end exclusive. Null and empty texts have none. Rows that
repeat doc_id and text each come out, with the same spans. An empty table gives an empty result;
extra columns are kept by ``sanitise`` and ignored by ``find``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import scratch
from graphloom.llm.text import chunks, word_hashes, words

KINDS = ["email", "ip", "card", "phone"]
WINDOW = 8
EVIDENCE = 3
SLOTS = 1 << 20  # hash values by which words that are no revealing term are passed over before the join
GENERALISE, REMOVE = 0.95, 0.99
OPAQUE, CHANGES, BITS, SECRET = 16, 4, 80.0, 0.85

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_BLANK = " \t\n\x0b\f\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = ".,;:!?\"'()"
_DIGIT, _RUN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_RUN[[ord(c) for c in "+/_-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_TRIMMED = np.zeros(256, dtype=bool)
_TRIMMED[[ord(c) for c in _TRIM]] = True


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost e-mail matches in one walk over the @ signs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each pattern match that passes its check, by kind and start."""
    if not _ANY.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _term(word: str) -> str:
    """The one rule of terms, near mentions and in the counts: marks trimmed at either end, then lower case."""
    return word.strip(_TRIM).lower()


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word without the marks at its ends."""
    solid = np.append(np.flatnonzero(~_TRIMMED[data]), len(data))
    first = np.minimum(solid[np.searchsorted(solid, starts)], ends)
    last = np.searchsorted(solid, ends) - 1
    return first, np.where(last >= 0, np.maximum(solid[last] + 1, first), first)


def _term_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the term of each trimmed word; of the words outside ASCII each different one is lower-cased once."""
    out = word_hashes(data, starts, ends)
    wide = np.concatenate([[0], np.cumsum(data >= 0x80)])
    at = np.flatnonzero(wide[ends] > wide[starts])
    if len(at):
        _, first, inverse = np.unique(out[at], return_index=True, return_inverse=True)
        names = [bytes(data[starts[i] : ends[i]]).decode("utf-8", "replace").lower() for i in at[first].tolist()]
        out[at] = _term_hash(pd.Series(names)).to_numpy().view(np.uint64)[inverse]
    return out


def _near(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, str, int, int, int]]:
    """(entity, term, neighbourhood, start, end, glued) of the words near each mention, other mentions left out.

    What is glued to a mention without a blank is a term, too, though not a word of the corpus.
    """
    out, free = [], _outside(spans)
    glued_from, glued_to = 0, -1  # the long word walked back last: mentions glued to one another walk it once
    for kind, a, b in spans:
        entities = [_hash(f"{kind}:{text[a:b].lower()}")]
        if kind == "email":
            entities.append(_hash(f"domain:{text[a:b].lower().partition('@')[2]}"))
        left, at = [], a
        while at > 0 and len(left) < WINDOW + 1:  # words before the mention, from a slice that grows only as needed
            lo = max(0, at - 64)
            found = [m.span() for m in _WORD.finditer(text, lo, at)]
            if found and found[0][0] == lo and lo > 0 and text[lo - 1] not in _BLANK:
                if len(found) == 1:
                    start = lo
                    while start > 0 and text[start - 1] not in _BLANK:
                        if start == glued_to:
                            start = glued_from
                            break
                        start -= 1
                    glued_from, glued_to = start, lo
                    found = [(start, found[0][1])]
                else:
                    found = found[1:]
            if not found:
                at = lo
                continue
            left = found + left
            at = found[0][0]
        right = []
        for m in _WORD.finditer(text, b):
            right.append(m.span())
            if len(right) > WINDOW:
                break
        around = left[-WINDOW - 1 :] + right
        names: dict[int, str] = {}

        def name(i: int, around: list[tuple[int, int]] = around, names: dict[int, str] = names) -> str:
            if i not in names:
                names[i] = text[slice(*around[i])] if 0 <= i < len(around) else ""
            return names[i]

        for i, (s, e) in enumerate(around):
            if (i == 0 and len(left) > WINDOW) or i == len(around) - 1 and len(right) > WINDOW:
                continue  # only a neighbour of the outermost word
            if not free(s, e):
                continue
            term, bare = _term(name(i)), name(i).strip(_TRIM)
            if len(term) > 1:
                start = s + len(name(i)) - len(name(i).lstrip(_TRIM))
                glued = s > 0 and text[s - 1] not in _BLANK or e < len(text) and text[e] not in _BLANK
                pair = f"{_term(name(i - 1))} {_term(name(i + 1))}"
                out += [(entity, term, _hash(pair), start, start + len(bare), glued) for entity in entities]
    return out


FOUND = "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind:string,start:int,end:int>>, near array<struct<entity:long,term:string,around:long,start:int,end:int,glued:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string()), ("around", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("glued", pa.bool_())]))


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mentions(docs: DataFrame) -> DataFrame:
    """Pattern spans of each text and the words near them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                spans = [base_spans(t) for t in part.column(2).to_pylist()]
                near = [_near(t.as_py(), s) if s else [] for t, s in zip(part.column(2), spans, strict=True)]
                counts = [pa.array([sum(k == kind for k, _, _ in s) for s in spans], pa.int64()) for kind in KINDS]
                sha = pa.array([hashlib.sha256(_line(s).encode()).hexdigest() for s in spans])
                base = pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in s] for s in spans], _SPAN)
                close = pa.array([[dict(zip(("entity", "term", "around", "start", "end", "glued"), x, strict=True)) for x in n] for n in near], _NEAR)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *counts, sha, base, close], names=["doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "near"])

    return keyed(docs).mapInArrow(scan, FOUND)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term_hash, n): occurrences in the whole corpus of each word's term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                starts, ends, _ = words(data, offs)
                held.append(np.unique(_term_hashes(data, *_trimmed(data, starts, ends)), return_counts=True))
                if sum(len(k) for k, _ in held) > 2_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield _counted(*held.pop())
        if held:
            yield _counted(*merged())

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "term_hash long, n long")
    return rows.groupBy("term_hash").agg(F.sum("n").alias("n"))


def _counted(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["term_hash", "n"])


def _term_hash(terms: pd.Series) -> pd.Series:
    """The hash that ``term_counts`` gives a term."""
    out = [np.zeros(0, np.uint64)]
    for _, _, data, offs in chunks(pa.array(terms.tolist(), pa.string())):
        out.append(word_hashes(data, offs[:-1], offs[1:]))
    return pd.Series(np.concatenate(out).view(np.int64))


def revealing_terms(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of the pairs whose disclosure reaches ``GENERALISE``."""
    # a row counts as often as it stands in the corpus, a word once for each entity that it is near
    near = found.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("near").alias("x")).select("row", "x.*").dropDuplicates(["row", "entity", "term", "start"])
    kinds = near.groupBy("entity", "term", "around").agg(F.count("*").alias("n"))
    pairs = scratch.table(kinds.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("kinds")).filter(F.col("kinds") >= EVIDENCE), "pairs")
    spark = found.sparkSession
    if not pairs.head(1):
        return spark.createDataFrame([], "entity long, term string, disclosure double")
    counts = scratch.table(term_counts(docs), "terms")
    total = counts.agg(F.sum("n")).first()[0]
    glued = near.filter("glued").select("row", "term", "start").distinct().groupBy("term").agg(F.count("*").alias("n_glued"))
    near_e = found.select("doc_id", F.explode("near").alias("x")).select("doc_id", "x.entity", "x.start")
    entities = near_e.groupBy("entity").agg(F.ceil(F.count("*") / (2 * WINDOW)).alias("n_entity"))
    joined = pairs.withColumn("term_hash", F.pandas_udf(_term_hash, "long")("term")).join(counts, "term_hash", "left").join(glued, "term", "left").join(entities, "entity")
    n = F.coalesce("n", F.lit(0)) + F.coalesce("n_glued", F.lit(0))
    p_e, p_et = F.col("n_entity") / F.lit(total), F.least(F.lit(1.0), F.col("n_both") / n)
    scored = joined.select("entity", "term", (F.log(p_et / p_e) / -F.log(p_e)).alias("disclosure"))
    return scored.filter(F.col("disclosure") >= GENERALISE)


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end, disclosure) of every word of the corpus whose term is one of ``terms`` (term, disclosure).

    Other mentions are left out, as near them. Only words that share a hash slot with a term become rows.
    """
    slots = terms.select(F.pmod(F.pandas_udf(_term_hash, "long")("term"), F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow()
    wanted = np.zeros(SLOTS, dtype=bool)
    wanted[slots.column(0).to_numpy()] = True
    wanted = np.packbits(wanted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(wanted).astype(bool)
        for batch in batches:
            for row, _, data, offs in chunks(batch.column(2)):
                starts, ends, first = words(data, offs)
                starts, ends = _trimmed(data, starts, ends)
                hit = np.flatnonzero(held[(_term_hashes(data, starts, ends) % np.uint64(SLOTS)).astype(np.int64)] & (ends > starts))
                if not len(hit):
                    continue
                doc = np.searchsorted(first, hit, "right") - 1
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                places = zip(doc.tolist(), starts[hit].tolist(), ends[hit].tolist(), chars[starts[hit]].tolist(), chars[ends[hit]].tolist(), strict=True)
                out, at, free = [], -1, None
                for d, a, b, x, y in places:
                    if d != at:
                        at, free, base = d, None, int(chars[offs[d]])
                    bare = bytes(data[a:b]).decode("utf-8", "replace")
                    if not bare.isalpha():  # letters alone are never part of a mention that is longer than their word
                        free = free or _outside(base_spans(batch.column(2)[row + d].as_py()))
                        if not free(x - base, y - base):
                            continue
                    out.append((row + d, bare.lower(), x - base, y - base))
                take = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int32())], names=["doc_id", "text_hash", "term", "start", "end"])

    return keyed(docs).mapInArrow(scan, "doc_id long, text_hash long, term string, start int, end int").join(terms, "term").drop("term")


def _outside(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Whether (start, end) meets none of the spans."""
    spans = sorted((a, b) for _, a, b in spans)
    starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
    return lambda s, e: (i := bisect_left(starts, e)) == 0 or reach[i - 1] <= s


SURVEY = "doc_id long, text_hash long, term string, around long, start int, end int, pair int, n long"


def survey(docs: DataFrame) -> DataFrame:
    """The candidates for secrets (doc_id to end), and rows (pair, n) of how often two bytes stand side by side."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            out: list[tuple] = []
            for row, _, data, offs in chunks(batch.column(2)):
                codes = data[:-1].astype(np.int64) << 8 | data[1:]
                inner = offs[(offs > 0) & (offs < len(data))]
                pairs += np.bincount(codes, minlength=1 << 16) - np.bincount(codes[np.unique(inner) - 1], minlength=1 << 16)
                starts, ends = _opaque(data, offs)
                if len(starts):
                    out += _places(batch.column(2), row, data, offs, starts, ends)
            take = pa.array([o[0] for o in out], pa.int64())
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32()]
            held = [pa.array([o[i + 1] for o in out], kind) for i, kind in enumerate(kinds)]
            blank = [pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *held, *blank], names=names)
        seen = np.flatnonzero(pairs)
        blank = [pa.nulls(len(seen), kind) for kind in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*blank, pa.array(seen, pa.int32()), pa.array(pairs[seen])], names=names)

    names = ["doc_id", "text_hash", "term", "around", "start", "end", "pair", "n"]
    return keyed(docs).mapInArrow(scan, SURVEY)


def _opaque(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each run that may be a secret by its form."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    run = np.append(_RUN[data], False)
    before = np.concatenate([[False], run[:-1]])
    starts, ends = np.flatnonzero(run & (~before | edge)), np.flatnonzero(before & (~run | edge))
    long = ends - starts >= OPAQUE
    starts, ends = starts[long], ends[long]
    digit = _DIGIT[data]
    letter = _RUN[data] & ~digit & (data >= 65) & (data != 95)
    change = np.concatenate([[0], np.cumsum(digit[1:] & letter[:-1] | letter[1:] & digit[:-1], dtype=np.int64)])
    many = change[ends - 1] - change[starts] >= CHANGES if len(starts) else np.zeros(0, bool)
    return starts[many], ends[many]


def _places(texts: pa.Array, row: int, data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """(row, term, neighbourhood, start, end) of the runs outside the patterns' spans."""
    word, stop, first = words(data, offs)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    name = lambda i, d: _term(bytes(data[word[i] : stop[i]]).decode("utf-8", "replace")) if first[d] <= i < first[d + 1] else ""
    out, at, free = [], -1, None
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        d = int(np.searchsorted(offs, a, "right")) - 1
        if d != at:
            at, free = d, _outside(base_spans(texts[row + d].as_py() or ""))
        x, y = int(chars[a] - chars[offs[d]]), int(chars[b] - chars[offs[d]])
        if free(x, y):
            i = int(np.searchsorted(word, a, "right")) - 1
            out.append((row + d, bytes(data[a:b]).decode("ascii"), _hash(f"{name(i - 1, d)} {name(i + 1, d)}"), x, y))
    return out


def secrets(surveyed: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end, disclosure) of the protected secrets of a stored survey."""
    table = np.zeros((256, 256))
    for pair, n in surveyed.filter("pair is not null").groupBy("pair").agg(F.sum("n")).collect():  # 65536 rows at most
        table[pair >> 8, pair & 255] = n
    positions = max(2.0, float(table.sum()))
    firsts = table.sum(axis=1)

    @F.pandas_udf("double")
    def information(terms: pd.Series, n: pd.Series) -> pd.Series:
        """Bits of each term under the pairs of the rest of the corpus."""
        out = []
        for term, times in zip(terms, n, strict=True):
            raw = np.frombuffer(term.encode(), np.uint8).astype(np.int64)
            _, inverse, own = np.unique(raw[:-1] << 8 | raw[1:], return_inverse=True, return_counts=True)
            pair = table[raw[:-1], raw[1:]] - times * own[inverse]
            first = firsts[raw[:-1]] - times * np.bincount(raw[:-1], minlength=256)[raw[:-1]]
            out.append(float(np.log2((np.maximum(first, 0) + 256) / (np.maximum(pair, 0) + 1)).sum()))
        return pd.Series(out)

    places = surveyed.filter("pair is null")
    known = places.groupBy("term", "around").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    told = known.withColumn("disclosure", 1 - F.log("kinds") / math.log(positions)).filter(F.col("disclosure") >= SECRET).filter(information("term", "n") >= BITS)
    return places.drop("n").join(told, "term").select("doc_id", "text_hash", "start", "end", "disclosure")


def find(docs: DataFrame) -> DataFrame:
    """Per document the pattern counts, the hash of the pattern spans and all spans with the terms'."""
    found = scratch.table(mentions(docs), "mentions")
    flagged = scratch.table(revealing_terms(found, docs), "revealing")
    told = scratch.table(flagged.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "told")
    near = found.select("doc_id", "text_hash", F.explode("near").alias("x")).filter("x.glued").select("doc_id", "text_hash", "x.term", "x.start", "x.end")
    hidden = secrets(scratch.table(survey(docs), "survey"))
    spans = near.join(told, "term").drop("term").unionByName(occurrences(docs, told)).unionByName(hidden).groupBy("doc_id", "text_hash", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    struct = F.struct("start", "end", (F.col("disclosure") >= REMOVE).alias("remove"))
    terms = spans.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.array_sort(F.collect_list(struct)).alias("terms"))
    rows = found.drop("near").join(terms, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left").drop("_d", "_h")
    line = lambda arr, kind: F.transform(arr, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"]))
    both = F.concat(line("base", lambda s: s["kind"]), F.coalesce(line("terms", lambda s: F.lit("term")), F.array().cast("array<string>")))
    return rows.withColumn("spans", F.array_join(both, ","))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by its kind, and revealing terms generalised or removed."""
    found = find(docs).filter("spans <> ''").select("doc_id", "text_hash", "base", "terms").dropDuplicates(["doc_id", "text_hash"])
    places = found.select(*[F.col(c).alias(f"_{c}") for c in found.columns])
    same_id, text = docs["doc_id"].cast("long").eqNullSafe(places["_doc_id"]), docs["text"]
    joined = docs.join(places, same_id & (F.xxhash64(F.coalesce(text, F.lit(""))) == places["_text_hash"]), "left")

    @F.pandas_udf("string")
    def clean(text: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([_cleaned(t, b, x) for t, b, x in zip(text, base, terms, strict=True)])

    cleaned = F.when(places["_text_hash"].isNull(), text).otherwise(clean(text, places["_base"], places["_terms"]))
    return joined.select(*[cleaned.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns])


def _cleaned(text: str | None, base: list | None, terms: list | None) -> str | None:
    if text is None or base is None:
        return text
    spans = [(int(s["start"]), int(s["end"]), f"[{s['kind'].upper()}]") for s in base]
    for s in terms if terms is not None else []:
        a, b = int(s["start"]), int(s["end"])
        spans.append((a, b, "" if s["remove"] else "[NAME]" if text[a : a + 1].isupper() else "[TERM]"))
    out, at = [], 0
    for a, b, mark in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
