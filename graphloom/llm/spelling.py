"""Groups of spelling variants: words one edit apart, found by k-d trees over letter counts.

A word of Latin letters is a point of its letters' counts, words of one length form a tree. One replaced letter
moves a point by two in L1 distance (one up, one down), one inserted letter by one up, so the partners of a
word lie in few boxes of the tree of its own length and of the next. The upper part of each tree is made in Spark
from all words: a cell that holds too much is cut at the letter and count that halve it best, until every cell
fits one task. Each word is sent to the cells whose boxes it can reach; inside a cell a tree with tight boxes
finds the points in range, and the letters' order decides.

Words of one and the same letter counts cannot be cut further. A cell full of such words is joined on the words with one
letter left out, which pair just the words one edit apart. A cell that many words reach is dealt to several
tasks. Nothing is capped: every pair is found once. For each pair of lengths the smaller set of words is sent.

A null text has no words. Rows that repeat count again; a null doc_id counts as an empty one. An empty table gives an
empty result. Extra columns are not read. A word of any length is kept whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import scratch
from graphloom.llm.merkle import crc32_sql
from graphloom.llm.text import chunks, distinct, word_keys

SHORTEST, FEWEST = 5, 3
SLIP = 97  # one run of so many, by its hash, loses a letter
CELL_BYTES = 1 << 20  # words of a cell, in bytes of letters and counts
REACH = 4  # words sent to a cell, as a multiple of what it may hold, before it is dealt to several tasks
LEAF = 16
LETTERS = 90  # a to z, U+00C0 to U+00FF
_HELD = 500_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII = np.zeros(256, dtype=bool)
_ASCII[65:91] = _ASCII[97:123] = True
_CODE = np.zeros(256, dtype=np.uint8)
_CODE[97:123] = np.arange(26)
_CODE[192:256] = np.arange(26, LETTERS)
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def _runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of letters; U+00C0 to U+00FF are the byte C3 and one more."""
    solid = np.zeros(len(data) + 1, dtype=bool)
    lead = data == 0xC3
    solid[:-1] = _ASCII[data] | lead
    solid[1:-1] |= lead[:-1]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = solid[:-1]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offs] = True
    return np.flatnonzero(solid & (~before | cut)), np.flatnonzero(before & (~solid | cut))


def _crcs(start: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, going on from ``start``."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-size, kind="stable")
    at, left, state = starts[order], size[order], start[order] ^ np.uint32(0xFFFFFFFF)
    long = int((left > 64).sum())
    for i in range(long):
        a = int(at[i])
        state[i] = zlib.crc32(data[a : a + int(left[i])].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for j in range(int(left[long]) if long < len(left) else 0):
        m = int(np.searchsorted(-left, -j, side="left"))  # those longer than j
        part = state[long:m]
        state[long:m] = _CRC[(part ^ data[at[long:m] + j]) & 0xFF] ^ part >> np.uint32(8)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def word_counts(docs: DataFrame, slip: int | None = None, shortest: int = SHORTEST) -> DataFrame:
    """(word, n) of all letter runs of at least ``shortest`` letters, A-Z folded.

    With ``slip``, a run whose CRC-32 after its doc_id and a colon is divisible by it loses the letter that the CRC-32 points at.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            ids = batch.column(0)
            for row, _, raw, offs in chunks(batch.column(1)):
                starts, ends = _runs(raw, offs)
                data = _LOWER[raw]
                letters = np.concatenate([[0], np.cumsum(data != 0xC3)])
                size = letters[ends] - letters[starts]
                keep = size >= shortest
                starts, ends, size = starts[keep], ends[keep], size[keep]
                if slip and len(starts):
                    doc = np.searchsorted(offs, starts, "right") - 1
                    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.slice(row, len(offs) - 1).to_pylist()], np.uint32)
                    crc = _crcs(heads[doc], data, starts, ends - starts)
                    hit = crc % np.uint32(slip) == 0
                    for a, b, h, n in zip(starts[hit].tolist(), ends[hit].tolist(), crc[hit].tolist(), size[hit].tolist(), strict=True):
                        if n > shortest:
                            word, at = data[a:b].tobytes().decode(), h % n
                            word = (word[:at] + word[at + 1 :]).encode()
                            held[word] = held.get(word, 0) + 1
                    starts, ends = starts[~hit], ends[~hit]
                at, which = distinct(*word_keys(data, starts, ends)) if len(starts) else (starts, starts)
                for a, b, n in zip(starts[at].tolist(), ends[at].tolist(), np.bincount(which, minlength=len(at)).tolist(), strict=True):
                    word = data[a:b].tobytes()
                    held[word] = held.get(word, 0) + n
                if len(held) > _HELD:
                    yield from _counted(held)
                    held = {}
        yield from _counted(held)

    rows = docs.select(F.col("doc_id").cast("string"), F.col("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    words, n = list(held), list(held.values())
    for lo in range(0, len(words), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + 20_000], pa.binary()).cast(pa.string()), pa.array(n[lo : lo + 20_000], pa.int64())], names=["word", "n"])


def _codes(words: list[str]) -> np.ndarray:
    """The letters of words of one length, one row each."""
    return _CODE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(len(words), -1)


def _points(codes: np.ndarray) -> np.ndarray:
    """The letter counts of each row."""
    n, length = codes.shape
    flat = (np.arange(n)[:, None] * LETTERS + codes).ravel()
    return np.bincount(flat, minlength=n * LETTERS).reshape(n, LETTERS).astype(np.int16 if length < 30_000 else np.int64)


class Trees:
    """The upper trees: a node is (letter, count, below, from there on) or a cell number; a root for each length."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, int, int, int] | None] = []
        self.roots: dict[int, int] = {}

    def root(self, length: int) -> int:
        if length not in self.roots:
            self.roots[length] = self._new()
        return self.roots[length]

    def _new(self) -> int:
        self.nodes.append(None)
        return len(self.nodes) - 1

    def cut(self, cell: int, letter: int, count: int) -> None:
        self.nodes[cell] = (letter, count, self._new(), self._new())

    def reached(self, length: int, points: np.ndarray, over: int, under: int) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows) of the cells whose box a point misses by at most ``over`` letters too many and ``under`` too few."""
        todo = [(self.roots[length], np.arange(len(points)), np.zeros((2, len(points)), np.int64), {})]
        while todo:
            at, rows, off, box = todo.pop()
            if not len(rows):
                continue
            if self.nodes[at] is None:
                yield at, rows
                continue
            letter, count, below, above = self.nodes[at]
            have = points[rows, letter].astype(np.int64)
            lo, hi = box.get(letter, (0, 1 << 40))
            for side, child in enumerate((below, above)):
                new = (lo, min(hi, count - 1)) if side == 0 else (max(lo, count), hi)
                more = off.copy()
                more[0] += np.maximum(have - new[1], 0) - np.maximum(have - hi, 0)
                more[1] += np.maximum(new[0] - have, 0) - np.maximum(lo - have, 0)
                ok = (more[0] <= over) & (more[1] <= under)
                todo.append((child, rows[ok], more[:, ok], {**box, letter: new}))

    def homes(self, length: int, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for cell, rows in self.reached(length, points, 0, 0):
            out[rows] = cell
        return out


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """(length, rows, words) of a batch whose first column are words."""
    words = batch.column(0).to_pylist()
    size = np.array([len(w) for w in words])
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        for lo in range(0, len(rows), max(1, (1 << 24) // (length + LETTERS))):
            part = rows[lo : lo + max(1, (1 << 24) // (length + LETTERS))]
            yield length, part, [words[i] for i in part.tolist()]


def grow(words: DataFrame, cell_bytes: int = CELL_BYTES) -> tuple[Trees, set[int]]:
    """The upper trees over all words (word, length), and the cells that are full of words of the same letters.

    Only sizes and one cut a cell come to the driver: as many as words fill cells.
    """
    trees = Trees()
    sizes = {trees.root(r["length"]): (r["length"], r["n"]) for r in words.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()}
    dense: set[int] = set()
    while full := {c: n for c, (length, n) in sizes.items() if n * (length + LETTERS) > cell_bytes and c not in dense}:
        lengths = sorted({sizes[c][0] for c in full})

        def letters(batches: Iterator[pa.RecordBatch], full=full, trees=trees) -> Iterator[pa.RecordBatch]:
            wanted = np.array(sorted(full), np.int64)
            for batch in batches:
                for length, _, some in _by_length(batch):
                    points = _points(_codes(some))
                    cell = trees.homes(length, points)
                    rows, letter = np.nonzero(points * np.isin(cell, wanted)[:, None])
                    keys, n = np.unique(np.stack([cell[rows], letter, points[rows, letter]]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i], pa.int64()) for i in range(3)] + [pa.array(n, pa.int64())], names=["cell", "letter", "count", "n"])

        tally = words.filter(F.col("length").isin(lengths)).select("word").mapInArrow(letters, "cell long, letter long, count long, n long").groupBy("cell", "letter", "count").agg(F.sum("n").alias("n"))
        upto = F.expr("sum(n) over (partition by cell, letter order by count desc)")
        total = F.create_map(*[F.lit(x) for c in full.items() for x in c])[F.col("cell")] if len(full) <= 200 else None
        if total is None:
            spark = words.sparkSession
            tally = tally.join(F.broadcast(spark.createDataFrame(list(full.items()), "cell long, total long")), "cell")
        else:
            tally = tally.withColumn("total", total)
        cuts = tally.withColumn("above", upto).filter("above < total").groupBy("cell").agg(F.min_by(F.struct("letter", "count", "above"), F.struct(F.abs(2 * F.col("above") - F.col("total")), "letter", "count")).alias("cut"))
        found = {r["cell"]: r["cut"] for r in cuts.collect()}
        for cell in full:
            if cell not in found:
                dense.add(cell)
                continue
            letter, count, above = found[cell]
            trees.cut(cell, letter, count)
            length, n = sizes.pop(cell)
            sizes |= {trees.nodes[cell][2]: (length, n - above), trees.nodes[cell][3]: (length, above)}
    return trees, dense


_ROUTED = "cell long, role int, word string, n long"
_POINT, _SAME, _SHORTER, _LONGER = range(4)  # a cell's own word, or one sent to it by the length it has beside the cell's


def _routed(words: DataFrame, trees: Trees) -> DataFrame:
    """(cell, role, word, n): each word in its cell, and in the cells it can reach."""
    sizes = {r["length"]: r["n"] for r in words.groupBy("length").agg(F.count("*").alias("n")).collect()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, some in _by_length(batch):
                points = _points(_codes(some))
                home = trees.homes(length, points)
                out = [(home, rows, _POINT)]
                for cell, at in trees.reached(length, points, 1, 1):
                    at = at[home[at] < cell]
                    out.append((np.full(len(at), cell), rows[at], _SAME))
                mine = sizes[length]
                if length + 1 in sizes and mine <= sizes[length + 1]:
                    out += [(np.full(len(at), cell), rows[at], _SHORTER) for cell, at in trees.reached(length + 1, points, 0, 1)]
                if length - 1 in sizes and mine < sizes[length - 1]:
                    out += [(np.full(len(at), cell), rows[at], _LONGER) for cell, at in trees.reached(length - 1, points, 1, 0)]
                take = pa.array(np.concatenate([r for _, r, _ in out]))
                role = np.concatenate([np.full(len(r), k, np.int32) for _, r, k in out])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c for c, _, _ in out]), pa.int64()), pa.array(role), batch.column(0).take(take), batch.column(1).take(take)], names=["cell", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(route, _ROUTED)


def _in_range(p: np.ndarray, q: np.ndarray, over: int, under: int, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows of q, rows of p, whether the points are all alike) whose counts can be one edit apart, by a tree over p with tight boxes."""
    used = np.flatnonzero(p.any(axis=0) | q.any(axis=0)) if len(p) else np.zeros(0, np.int64)
    p, q = p[:, used], q[:, used]
    todo = [(np.arange(len(p)), np.arange(len(q)))]
    while todo:
        mine, near = todo.pop()
        if not len(mine) or not len(near):
            continue
        here = p[mine]
        lo, hi, theirs = here.min(axis=0), here.max(axis=0), q[near]
        ok = (np.maximum(theirs - hi, 0).sum(axis=1) <= over) & (np.maximum(lo - theirs, 0).sum(axis=1) <= under)
        near, theirs = near[ok], theirs[ok]
        alike = bool((lo == hi).all())
        if len(mine) <= leaf or alike:
            if alike:
                yield near, mine, True
                continue
            for at in range(0, len(near), 4096):
                gap = theirs[at : at + 4096, None, :] - here[None, :, :]
                a, b = np.nonzero((np.maximum(gap, 0).sum(axis=2) <= over) & (np.maximum(-gap, 0).sum(axis=2) <= under))
                yield near[at + a], mine[b], False
            continue
        best = None
        for count in range(1, int(hi.max()) + 1):
            above = (here >= count).sum(axis=0)
            off = np.where((above > 0) & (above < len(mine)), np.abs(2 * above - len(mine)), 1 << 40)
            letter = int(off.argmin())
            if best is None or off[letter] < best[0]:
                best = (int(off[letter]), letter, count)
        side = here[:, best[1]] >= best[2]
        todo += [(mine[side], near), (mine[~side], near)]


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of letters are one replacement, or one insertion into the first, apart."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    ahead = np.cumprod(short == long[:, :-1], axis=1).sum(axis=1)
    behind = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= short.shape[1]


def _matched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two tables of letters that are equal."""
    _, which = np.unique(np.concatenate([a, b]), axis=0, return_inverse=True)
    left, right = which.reshape(-1)[: len(a)], which.reshape(-1)[len(a) :]
    order = np.argsort(right, kind="stable")
    lo, hi = np.searchsorted(right[order], left, "left"), np.searchsorted(right[order], left, "right")
    rows = np.repeat(np.arange(len(a)), hi - lo)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    return rows, order[np.repeat(lo, hi - lo) + within]


def _alike(q: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows one edit apart by the words with one letter left out, where letter counts tell nothing apart."""
    longer = np.delete if p.shape[1] >= q.shape[1] else None
    for i in range(max(p.shape[1], q.shape[1])):
        if p.shape[1] == q.shape[1]:
            yield _matched(np.delete(q, i, axis=1), np.delete(p, i, axis=1))
        elif longer:
            yield _matched(q, np.delete(p, i, axis=1))
        else:
            yield _matched(np.delete(q, i, axis=1), p)


def _pairs_of(q: np.ndarray, p: np.ndarray, over: int, under: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of q and p (letters) that are one edit apart."""
    found = []
    for near, mine, alike in _in_range(_points(p), _points(q), over, under):
        if alike and len(near) * len(mine) > 1 << 14:
            parts = [(near[a], mine[b]) for a, b in _alike(q[near], p[mine])]
        else:
            parts = [(np.repeat(near, len(mine)), np.tile(mine, len(near)))] if alike else [(near, mine)]
        for a, b in parts:
            step = max(1, (1 << 24) // p.shape[1])
            for lo in range(0, len(a), step):
                x, y = a[lo : lo + step], b[lo : lo + step]
                ok = _one_edit(q[x], p[y]) if q.shape[1] <= p.shape[1] else _one_edit(p[y], q[x])
                found.append(np.stack([x[ok], y[ok]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0], both[1]


_PAIRS = "a string, n_a long, b string, n_b long"


def _cell_pairs(table: pa.Table) -> pa.Table:
    """The pairs of one cell: its words among themselves, and with the words sent to it."""
    words, n, role = table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("role").to_numpy()
    own = np.flatnonzero(role == _POINT)
    first = table.column("salt")[0].as_py() == 0
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(own):
        p = _codes([words[i] for i in own.tolist()])
        for kind, over, under in ((_POINT, 1, 1), (_SAME, 1, 1), (_SHORTER, 0, 1), (_LONGER, 1, 0)):
            sent = np.flatnonzero(role == kind)
            if not len(sent) or (kind == _POINT and not first):
                continue
            a, b = _pairs_of(_codes([words[i] for i in sent.tolist()]), p, over, under)
            if kind == _POINT:
                a, b = a[a < b], b[a < b]
            left.append(sent[a])
            right.append(own[b])
    a, b = np.concatenate(left), np.concatenate(right)
    word = table.column("word").combine_chunks()
    return pa.table({"a": word.take(pa.array(a)), "n_a": pa.array(n[a], pa.int64()), "b": word.take(pa.array(b)), "n_b": pa.array(n[b], pa.int64())})


def _without(word: Column, place: Column) -> Column:
    return F.concat(word.substr(F.lit(1), place - 1), word.substr(place + 1, F.length(word)))


def _dense_pairs(rows: DataFrame) -> DataFrame:
    """The pairs of cells of words of the same letters, which have none among themselves."""
    word, place = F.col("word"), F.sequence(F.lit(1), F.length("word"))
    tagged = F.transform(place, lambda i: F.concat_ws(":", i, _without(F.col("word"), i)))
    bare = F.array_distinct(F.transform(place, lambda i: _without(F.col("word"), i)))
    parts = []
    for kind, of_sent, of_own in ((_SAME, tagged, tagged), (_SHORTER, F.array(word), bare), (_LONGER, bare, F.array(word))):
        sent = rows.filter(F.col("role") == kind).select("cell", F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(of_sent).alias("key"))
        own = rows.filter(F.col("role") == _POINT).select("cell", F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(of_own).alias("key"))
        parts.append(sent.join(own, ["cell", "key"]).select("a", "n_a", "b", "n_b").distinct())
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def near_words(words: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(a, n_a, b, n_b) once for each two of the words (word, n) that are one edit apart."""
    words = words.withColumn("length", F.length("word"))
    trees, dense = grow(words, cell_bytes)
    routed = scratch.table(_routed(words, trees), "routed")
    is_dense = F.col("cell").isin(sorted(dense)) if dense else F.lit(False)
    sparse = routed.filter(~is_dense)
    most = REACH * cell_bytes
    load = sparse.filter(F.col("role") != _POINT).groupBy("cell").agg(F.ceil(F.sum(F.length("word") + LETTERS) / most).cast("int").alias("salts"))
    dealt = sparse.join(load, "cell", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salt = F.when(F.col("role") == _POINT, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("salts")).cast("int")))
    dealt = dealt.withColumn("salt", F.explode(salt)).select("cell", "salt", "role", "word", "n")
    pairs = dealt.groupBy("cell", "salt").applyInArrow(_cell_pairs, _PAIRS)
    return pairs.unionByName(_dense_pairs(routed.filter(is_dense))) if dense else pairs


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word: its form is the near word of largest n that has at least twice its own."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    is_form = -F.col("best.less") >= 2 * F.col("n")
    table = words.select("word", "n").join(best, "word", "left").select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    table = scratch.table(table, "forms")
    links = scratch.table(table.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    moving = bool(links.head(1))
    while moving:  # each form has at least twice its word's count, so few doublings of the way reach the end
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = scratch.table(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moving = bool(links.filter("moved").head(1))
        links = links.drop("moved")
    return table.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, slip: int | None = None, shortest: int = SHORTEST, fewest: int = FEWEST, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """The words of a corpus with their forms and roots."""
    words = scratch.table(word_counts(docs, slip, shortest).filter(F.col("n") >= fewest), "words")
    return forms(words, scratch.table(near_words(words, cell_bytes), "near-words"))


def oracle_sql() -> str:
    """DuckDB SQL of the query: words one edit apart share what is left when one letter is left out."""
    return f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
f AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r WHERE length(run) >= {SHORTEST} GROUP BY ALL),
h AS (SELECT run, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM f),
d AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {FEWEST}),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT DISTINCT a.word, b.word AS near, b.n AS m FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
UNION SELECT w.word, k.word, k.n FROM w JOIN k ON k.rest = w.word UNION SELECT k.word, w.word, w.n FROM w JOIN k ON k.rest = w.word),
b AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -m, near := near)) AS best FROM e GROUP BY word),
t AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * w.n THEN best.near END AS form, CASE WHEN -best.less >= 2 * w.n THEN -best.less END AS form_n FROM w LEFT JOIN b USING (word)),
p(word, root) AS (SELECT word, word FROM t UNION ALL SELECT p.word, t.form FROM p JOIN t ON t.word = p.root WHERE t.form IS NOT NULL)
SELECT t.word, t.form, p.root, t.n, t.n_near, t.form_n FROM t JOIN p ON p.word = t.word JOIN t z ON z.word = p.root WHERE z.form IS NULL"""
