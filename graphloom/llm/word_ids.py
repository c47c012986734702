"""Token ids of whole texts under a vocabulary that never joins text across white space.

A word of letters with marks after it is two units, its lower-cased letters and the marks; any other
word is one unit. Each distinct unit of a chunk is looked up once among those that the task has
seen, and only new ones are encoded: letters of the ASCII and Latin-1 ranges by merging the lowest
ranked pair of all of them at once, everything else by the tokenizer itself. Units are compared by
their bytes.
"""

from __future__ import annotations

import json
import os

import numpy as np

from graphloom.llm.text import distinct, word_keys, words

CACHED_UNITS = 1_000_000
JOINED = 1000  # new units that the tokenizer sees in one call
LONGEST = 64  # bytes of letters that are merged in arrays
_NONE = np.int64(1 << 40)
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[0x21:0x7F] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = False
_LATIN = np.zeros(256, dtype=bool)  # second bytes of the letters U+00C0 to U+00FF
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
# The normalisation and the splitting under which letters may be merged on their own.
_STEPS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Merges:
    """The vocabulary's merges as arrays."""

    def __init__(self, model: dict) -> None:
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        char = dict(zip(shown, map(chr, shown), strict=True))
        char |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in char)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[char[b] + end] for b in range(256)], dtype=np.int64)
        self.n = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], dtype=np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.into = key[order], order.astype(np.int64), into[order]

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE), self.into[at]

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has."""
        raw = np.frombuffer(b"".join(units), dtype=np.uint8)
        size = np.array([len(u) for u in units], dtype=np.int64)
        ends = np.cumsum(size)
        symbol, seq = self.inner[raw], np.repeat(np.arange(len(units)), size)
        symbol[ends - 1] = self.last[raw[ends - 1]]
        rank, into = self._look(symbol[:-1], symbol[1:])
        rank, into = np.append(rank, _NONE), np.append(into, 0)
        rank[ends - 1] = _NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            heads = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            runs = np.diff(np.append(heads, len(seq)))
            live = np.repeat(best < _NONE, runs)
            done.append((symbol[~live], seq[~live]))
            hit = np.flatnonzero((rank == np.repeat(best, runs)) & live)
            hit = hit[np.concatenate([[True], seq[hit[1:]] != seq[hit[:-1]]])] if len(hit) else hit
            symbol[hit] = into[hit]
            rank[hit] = rank[hit + 1]  # so that the last symbol of a unit stays the last
            keep = live
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            symbol, seq, rank, into = symbol[keep], seq[keep], rank[keep], into[keep]
            for left in (at, at - 1):
                left = left[(left >= 0) & (left + 1 < len(seq))]
                left = left[seq[left] == seq[left + 1]]
                rank[left], into[left] = self._look(symbol[left], symbol[left + 1])
        symbol, seq = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (raw.astype(np.int64), raw)
        return symbol[np.argsort(seq, kind="stable")], np.bincount(seq, minlength=len(units))


class WordIds:
    """Token ids of the units that a task has met, up to a bound."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        spec = json.loads(self.tokenizer.to_str())
        normal, cut = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        as_known = [x["type"] for x in normal.get("normalizers", [])] == _STEPS and [(x.get("pattern") or {}).get("Regex") for x in cut.get("pretokenizers", [])] == [_SPLIT, None]
        model = spec["model"]
        self.merges = _Merges(model) if as_known and model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix") else None
        self.clear()

    def clear(self) -> None:
        self.letters: dict[bytes, int] = {}
        self.others: dict[bytes, int] = {}
        self.pool, self.used, self.n = np.zeros(1 << 20, np.uint32), 0, 0
        self.first, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of the documents in order, and where each document's begin (n + 1 entries)."""
        if len(self.letters) + len(self.others) > CACHED_UNITS:
            self.clear()
        starts, ends, first_word = words(data, offs)
        folded, core_end, plain = self._cores(data, starts, ends)
        two = plain & (core_end < ends)
        place = np.concatenate([[0], np.cumsum(1 + two)])
        slot = np.zeros(place[-1], dtype=np.int64)
        if self.merges:
            slot[place[:-1][plain]] = self._slots(self.letters, folded, starts[plain], core_end[plain], self.merges.encode)
        rest = np.concatenate([place[:-1][~plain], place[:-1][two] + 1])
        slot[rest] = self._slots(self.others, data, np.concatenate([starts[~plain], core_end[two]]), np.concatenate([ends[~plain], ends[two]]), self._encode)
        length = self.length[slot]
        upto = np.concatenate([[0], np.cumsum(length)])
        take = np.repeat(self.first[slot] - upto[:-1], length) + np.arange(upto[-1])
        return self.pool[take], upto[place[first_word]]

    def _cores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes in lower case, where each word's letters end, and which words are letters and then marks."""
        folded = _FOLDED[data]
        if self.merges is None or not len(starts):
            return folded, ends, np.zeros(len(starts), dtype=bool)
        wide = np.flatnonzero(data[:-1] == 0xC3)
        wide = wide[_LATIN[data[wide + 1]]] + 1
        folded[wide[data[wide] <= 0x9E]] += 0x20
        letter = _ALPHA[data]
        letter[wide] = letter[wide - 1] = True
        count = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        letters, solid = count(letter), count(letter | _MARK[data])
        rises = count(letter[1:] & _MARK[data[:-1]])
        n = letters[ends] - letters[starts]
        plain = (solid[ends] - solid[starts] == ends - starts) & (rises[ends - 1] == rises[starts]) & (n > 0) & (n <= LONGEST)
        return folded, starts + np.where(plain, n, 0), plain

    def _slots(self, kept: dict[bytes, int], data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        at, which = distinct(*word_keys(data, starts, ends, lower=False))
        raw = data.tobytes()
        names = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        slot = np.array([kept.get(name, -1) for name in names], dtype=np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            unseen = [names[i] for i in new.tolist()]
            slot[new] = self._keep(*encode(unseen))
            kept.update(zip(unseen, slot[new].tolist(), strict=True))
        return slot[which]

    def _keep(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + len(size) > len(self.first):
            self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length))
        slots = np.arange(self.n, self.n + len(size))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[slots], self.length[slots] = self.used + np.cumsum(size) - size, size
        self.used, self.n = self.used + len(ids), self.n + len(size)
        return slots

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the tokenizer: many units in one call with a bar between them, those that hold a bar one by one."""
        texts = [u.decode("utf-8", "replace") for u in units]
        out: list[list[int]] = [[] for _ in texts]
        plain = [i for i, t in enumerate(texts) if self.bar is not None and "|" not in t]
        rest = [i for i, t in enumerate(texts) if self.bar is None or "|" in t]
        for lo in range(0, len(plain), JOINED):
            some = plain[lo : lo + JOINED]
            ids = self.tokenizer.encode_batch_fast([" | ".join(texts[i] for i in some)], add_special_tokens=False)[0].ids
            cuts = [-1, *[k for k, x in enumerate(ids) if x == self.bar], len(ids)]
            if len(cuts) != len(some) + 1:  # a bar that normalisation made
                rest += some
                continue
            for i, a, b in zip(some, cuts, cuts[1:], strict=False):
                out[i] = ids[a + 1 : b]
        for i, enc in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = enc.ids
        return np.array([x for ids in out for x in ids], dtype=np.int64), np.array([len(ids) for ids in out], dtype=np.int64)
