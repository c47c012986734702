"""Token counts under a sentencepiece BPE model, by rank-synchronous array merging.

A batch of pre-tokens is one flat array of symbol ids with the sequence each belongs to. A round
looks up the rank of every adjacent pair, takes each sequence's lowest-ranked pair (the leftmost of
equals) and merges it in all sequences at once; sequences without a pair left drop out. What
survives is counted: one per known symbol, one per UTF-8 byte of an unknown character (byte
fallback). No piece of such a model holds a space mark after another character, nor a line break,
so texts fall into independent pre-tokens there; each distinct one, by its bytes, is merged once per task. A
pre-token of over ``LONG`` symbols is merged by the same rule with a heap, so that one endless
word doesn't cost a round per symbol.

Null and empty texts have no tokens. Ties, repeated rows and extra columns change nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import chunks, distinct, word_keys

SPACE = "▁"
LONG = 200
CACHED = 1_000_000
_NONE = np.int64(1 << 40)


class PieceMerger:
    """The model's symbols, and for each pair that may merge its rank and what it becomes."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE models with byte fallback, a leading space and no text normalisation")
        scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("pieces must not cross a space or a line break")
        rank = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        if {c for p in scores for c in p} - scores.keys():
            raise ValueError("every character of a piece must be a piece, so that each merge saves one token")
        ids = {p: i for i, p in enumerate(scores)}
        self.n_symbols = len(ids) + 1  # the last is any other character
        pairs = sorted((ids[p[:i]] * self.n_symbols + ids[p[i:]], rank[scores[p]], ids[p]) for p in scores for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids)
        self.pair, self.rank, self.into = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.char = np.full(0x110000, self.n_symbols - 1, dtype=np.int64)
        for c, i in ids.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.known = np.zeros(self.n_symbols, dtype=bool)
        self.known[:-1] = True
        self.seen: dict[bytes, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], _NONE), self.into[at]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        symbol, seq = self.char[points], np.repeat(np.arange(len(texts)), size)
        cost = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        cost[self.known[symbol]] = 1
        out = np.bincount(seq, weights=cost, minlength=len(texts)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        long = size > LONG
        for i in np.flatnonzero(long):
            out[i] -= self._merges_by_heap(symbol[first[i] : first[i + 1]].tolist())
        symbol, seq = symbol[~long[seq]], seq[~long[seq]]
        while len(symbol) > 1:
            rank, into = self._ranks(symbol[:-1], symbol[1:])
            rank[seq[:-1] != seq[1:]] = _NONE
            heads = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            best = np.minimum.reduceat(np.append(rank, _NONE), heads)
            live = best < _NONE
            spread = np.repeat(best, np.diff(np.append(heads, len(seq))))
            hit = np.flatnonzero((rank == spread[:-1]) & (rank < _NONE))
            if not len(hit):
                break
            hit = hit[np.concatenate([[True], seq[hit[1:]] != seq[hit[:-1]]])]
            out[seq[hit]] -= 1
            symbol[hit] = into[hit]
            keep = np.repeat(live, np.diff(np.append(heads, len(seq))))
            keep[hit + 1] = False
            symbol, seq = symbol[keep], seq[keep]
        return out

    def _merges_by_heap(self, symbols: list[int]) -> int:
        """How many merges a long sequence takes, by the same order."""
        n, merges = len(symbols), 0
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        rank, into = self._ranks(np.array(symbols[:-1]), np.array(symbols[1:]))
        heap = [(int(rank[i]), i, symbols[i], symbols[i + 1], int(into[i])) for i in np.flatnonzero(rank < _NONE)]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            merges += 1
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0:
                    r, t = self._ranks(np.array([symbols[a]]), np.array([symbols[b]]))
                    if r[0] < _NONE:
                        heapq.heappush(heap, (int(r[0]), a, symbols[a], symbols[b], int(t[0])))
        return merges

    def count_texts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each whole text of a chunk."""
        n_docs = len(offs) - 1
        space, line = data == 0x20, data == 0x0A
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offs] = True
        solid = ~(space | line)
        before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
        starts = np.flatnonzero(solid & (~before | cut[:-1]))
        after = np.concatenate([solid[1:], [False]]) if len(data) else solid
        ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
        # runs of spaces; the mark that the model puts before a text lengthens the first run or is one of its own
        s_before = np.concatenate([[False], space[:-1]]) if len(data) else space
        s_starts = np.flatnonzero(space & (~s_before | cut[:-1]))
        s_after = np.concatenate([space[1:], [False]]) if len(data) else space
        s_ends = np.flatnonzero(space & (~s_after | cut[1:])) + 1
        filled = np.flatnonzero(np.diff(offs) > 0)
        lead = np.zeros(len(data) + 1, dtype=np.int64)  # spaces that stand right before a byte
        lead[s_ends] = s_ends - s_starts
        lead[offs] = 0  # a run that ends one text doesn't lead the next
        run = s_ends - s_starts
        opens = np.isin(s_starts, offs[filled])
        lead[s_ends[opens]] += 1
        alone_end = ~solid[np.minimum(s_ends, len(data) - 1)] | cut[s_ends] if len(data) else np.zeros(0, bool)
        bare = filled[~space[offs[filled]]]  # texts that begin with no space
        lead[offs[bare]] = 1
        gap = lead[starts]
        doc = np.searchsorted(offs, starts, side="right") - 1
        out = np.bincount(doc, weights=self._cached(data, starts, ends, gap), minlength=n_docs)
        alone = run[alone_end] + opens[alone_end]
        out += np.bincount(np.searchsorted(offs, s_starts[alone_end], side="right") - 1, weights=self._spaces(alone), minlength=n_docs)
        out += np.bincount(np.searchsorted(offs, np.flatnonzero(line), side="right") - 1, minlength=n_docs)
        by_line = bare[line[offs[bare]]]  # there the mark stands alone
        out[by_line] += self._spaces(np.ones(len(by_line), np.int64))
        return out.astype(np.int64)

    def _spaces(self, runs: np.ndarray) -> np.ndarray:
        kinds, which = np.unique(runs, return_inverse=True)
        return self.count([SPACE * int(n) for n in kinds])[which] if len(kinds) else np.zeros(0, np.int64)

    def _cached(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        at, which = distinct(*word_keys(data, starts, ends, lower=False), gap.astype(np.uint64))
        if len(self.seen) + len(at) > CACHED:
            self.seen.clear()
        raw = data.tobytes()
        names = [b" " * g + raw[a:b] for g, a, b in zip(gap[at].tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)]
        found = np.array([self.seen.get(name, -1) for name in names], dtype=np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            unseen = [names[i] for i in new.tolist()]
            found[new] = self.count([name.decode("utf-8", "replace").replace(" ", SPACE) for name in unseen])
            self.seen.update(zip(unseen, found[new].tolist(), strict=True))
        return found[which]


_loaded: dict[str, PieceMerger] = {}


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether that is over ``limit``, for each whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _loaded:
            _loaded[model] = PieceMerger(model)
        for batch in batches:
            counts = [_loaded[model].count_texts(data, offs) for _, _, data, offs in chunks(batch.column(2))]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), F.replace(text, F.lit(SPACE), F.lit(" ")).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
