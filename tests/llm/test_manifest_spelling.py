"""The Merkle manifest and the spelling variants against plain twins."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle, registry, spelling

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, part int, _changed string, tree long, word string, n long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(spark, n):
    """A hot source, a null one, lone and odd ones, repeated rows and ids, nulls everywhere."""
    out = [(i, "hot", "en", i, f"Text {i}", 1, "x", 2, "y", 3) for i in range(n)]
    out += [(i, None, None, None, None if i % 2 else "", 1, None, None, None, None) for i in range(17)]
    out += [(5, "é", "fr", 3, "Été"), (5, "é", "fr", 3, "Été"), (None, "é", "fr", 1, "A"), (None, "é", "fr", 1, "B"), (7, "z", "de", 9, "Long " * 50_000), (8, "Z", "de", 9, "\U0001f600")]
    return spark.createDataFrame([tuple(r) + (1, "x", 2, "y", 3)[: 10 - len(r)] if len(r) < 10 else r for r in out], SCHEMA)


def plain_manifest(rows):
    """Every leaf's root and proof by walking the whole trees."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))
    by = {}
    for r in rows:
        lower = r["text"] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        own = leaf(r, r["text"])
        by.setdefault(r["source"], []).append((r["doc_id"], own, leaf(r, lower) if tampered else own))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def walk(levels, place, h):
        proof = ""
        for nodes in levels[:-1]:
            run = nodes[place // 16 * 16 : place // 16 * 16 + 16]
            left, right = "".join(run[: place % 16]), "".join(run[place % 16 + 1 :])
            proof, h, place = proof + left + right, sha(left + h + right), place // 16
        return proof, h

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[1] for x in sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for place, (doc_id, own, changed) in enumerate(sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            low, h = walk(trees[s], place, changed)
            high, h = walk(top, at, h)
            out.append((str(doc_id), own, trees[s][-1][0], top[-1][0], sha(low + high), h, h == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("n,leaves", [(300, 8192), (300, 40), (16, 7), (1, 8192)])
def test_manifest_equals_whole_trees(spark, monkeypatch, n, leaves):
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    docs = rows_of(spark, n)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    m = merkle.manifest(docs, changes={"text": lower}, when=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    got = sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in merkle.checked(m).collect())
    assert got == plain_manifest(docs.collect())
    assert {r["digest"] for r in m.roots().filter("tree = -1").collect()} == {got[0][3]}
    if leaves == 40:
        kept = merkle.proofs(m)
        assert kept.filter(merkle.folded(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0 and kept.count() == docs.count()


def test_manifest_of_no_rows(spark):
    assert merkle.checked(merkle.manifest(rows_of(spark, 1).limit(0))).count() == 0


def test_missing_is_the_least_union():
    # one leaf needs its whole path; a full run needs nothing below the next level
    assert merkle.missing([0], 17) == [(0, p) for p in range(1, 16)] + [(1, 1)]
    assert merkle.missing(list(range(16)), 17) == [(1, 1)]
    assert merkle.missing(list(range(17)), 17) == [] and merkle.missing([0], 1) == []
    assert merkle.missing([16], 17) == [(1, 0)]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts):
    """Word by word over all pairs."""
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best and counts[best] >= 2 * n else None, n, len(close))
    rows = []
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, counts[form] if form else None))
    return sorted(rows, key=str)


def plain_counts(docs, slip):
    counts = {}
    for r in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= 3}


def test_variants_of_odd_texts(spark):
    texts = ["Colour colour COLOUR color color color colours colours colours", None, "", " \n", "Été étés étés étés étéss étéss étéss ×÷×÷× abcde_abcde abcde1abcdeāabcde"]
    texts += ["x" * 70_000 + " " + "x" * 69_999] * 3 + ["hotword hotword hotward"] * 400
    rows = [(i if i % 7 else None, t, "en", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    for slip in (None, 3, 97):
        want = plain_counts(docs.collect(), slip)
        got = spelling.variants(docs, slip=slip)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_forms(want)
    assert spelling.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell_bytes", [400, 3000, 1 << 22])
def test_pairs_whatever_the_cells(spark, cell_bytes):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abeé"), size=n)) for n in (5, 6, 6, 7, 8) for _ in range(60)}
    words |= {"".join(p) for p in itertools.permutations("aabbc")} | {"".join(p) for p in itertools.permutations("aabbcc")} | {"".join(p) for p in itertools.permutations("aabbcd")}
    counts = {w: int(rng.integers(3, 50)) for w in sorted(words)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.near_words(table, cell_bytes).collect()
    pairs = sorted(tuple(sorted((r["a"], r["b"]))) for r in got)
    assert pairs == sorted((a, b) for a, b in itertools.combinations(sorted(words), 2) if near(a, b))
    assert all(counts[r["a"]] == r["n_a"] and counts[r["b"]] == r["n_b"] for r in got)
    if cell_bytes == 400:  # so small that cells of one letter count are full, and dealt to several tasks
        assert spelling.grow(table.withColumn("length", F.length("word")), cell_bytes)[1]
    assert sorted(map(tuple, spelling.forms(table, spark.createDataFrame(got)).collect()), key=str) == plain_forms(counts)


def test_alike_words_inside_a_cell():
    # many words of two letter counts one replacement apart, and one insertion apart: pairs come from the letters left out
    q = spelling._codes(sorted({"".join(p) for p in itertools.permutations("aabbcc")} | set()))
    for other in ("aabbcd", "aabbccd", "aabbc"):
        words = sorted({"".join(p) for p in itertools.permutations(other)})
        p = spelling._codes(words)
        mine = ["".join("abcdefghijklmnopqrstuvwxyz"[c] for c in row) for row in q]
        over, under = {6: (1, 1), 7: (0, 1), 5: (1, 0)}[len(other)]
        a, b = spelling._pairs_of(np.repeat(q, 1, axis=0), p, over, under)
        assert {(mine[i], words[j]) for i, j in zip(a, b, strict=True)} == {(x, y) for x in mine for y in words if near(x, y)}


def test_query_on_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = sorted(map(tuple, registry.op12_spelling_variants(spark, DATA).collect()), key=str)
    assert got == plain_forms(plain_counts(docs, 97))
