"""Byte-level word tools shared by the operators that work on Arrow batches.

A word is a maximal run of bytes outside space and 0x09-0x0D. Everything here is vectorised over
a chunk of documents, so that a word hardly ever becomes a Python object. Words and shingles are told
apart by 128 bits: short words by their own bytes, long ones by a cryptographic digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHOLE = 15  # bytes up to which a word's key is the word itself
_TIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, offsets) of a string column, of about ``limit`` bytes each.

    A longer text is a slice of its own; null counts as empty.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the index of its first word (n + 1 entries)."""
    solid = np.zeros(len(data) + 1, dtype=bool)
    solid[:-1] = ~_SPACE[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = solid[:-1]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offs] = True
    starts = np.flatnonzero(solid & (~before | cut))
    ends = np.flatnonzero(before & (~solid | cut))
    return starts, ends, np.searchsorted(starts, offs)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """128 bits (two arrays) for each word; ``lower`` folds A-Z first.

    Up to ``WHOLE`` bytes they are the word itself with its length, so different words differ; a
    longer word has its BLAKE2b digest.
    """
    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    eight = np.ndarray(len(data) + 9, dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    lo = eight[starts] & _MASKS[np.minimum(size, 8)]
    hi = eight[starts + 8] & _MASKS[np.clip(size - 8, 0, 7)] | np.minimum(size, WHOLE).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > WHOLE)
    if len(long):
        whole = memoryview(padded)
        digests = [hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
        lo[long], hi[long] = both[:, 0], both[:, 1] | np.uint64(0xFF << 56)
    return lo, hi


def _lanes(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits of each key stirred one-to-one, so that each half depends on all of them."""
    lo = lo ^ mix(hi + np.uint64(0x9E3779B97F4A7C15))
    hi = hi ^ mix(lo + np.uint64(0xD1B54A32D192ED03))
    return lo ^ mix(hi + np.uint64(0x8CB92BA72F3D8DD7)), hi


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` folds A-Z first."""
    return _lanes(*word_keys(data, starts, ends, lower))[0]


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different row of the key columns stands first, and for each row which of them it is."""
    folded = keys[0]
    for other in keys[1:]:
        folded = mix(folded) + other
    _, at, which = np.unique(folded, return_index=True, return_inverse=True)
    if any((k[at][which] != k).any() for k in keys):  # different rows of one folded value
        _, at, which = np.unique(np.stack(keys, axis=1), axis=0, return_index=True, return_inverse=True)
    return at, which.reshape(-1)


def combine(lanes: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes (two arrays) of each ``k`` consecutive values; the order counts."""
    n = len(lanes[0]) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    out = []
    for lane, times in zip(lanes, _TIMES, strict=True):
        sums = lane[:n].copy()
        for j in range(1, k):
            sums *= times
            sums += lane[j : j + n]
        out.append(mix(sums + np.uint64(k)))
    return out[0], out[1]


def word_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word, for ``combine``."""
    return _lanes(*word_keys(data, starts, ends, lower))


def as_set(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 128-bit values in order of their first half."""
    order = np.argsort(a)
    a, b = a[order], b[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int, lower: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each document's distinct ``k``-word shingles as 128-bit hashes (two arrays, in order of the first).

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    starts, ends, first = words(data, offs)
    lanes = word_lanes(data, starts, ends, lower)
    grams = combine(lanes, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(as_set(grams[0][a : b - k + 1], grams[1][a : b - k + 1]))
        elif b > a:
            out.append(combine((lanes[0][a:b], lanes[1][a:b]), b - a))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    return out
