"""Class-based scoring: counts against a plain twin, probabilities that sum to one, clusters that help."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from graphloom.llm import class_lm, registry

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def is_held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def plain_base(rows):
    train = collections.Counter(t for r in rows if not is_held(r["doc_id"]) for t in tokens(r["text"]))
    n, v = sum(train.values()), len(train)
    out = []
    for r in rows:
        own = tokens(r["text"])
        out.append((str(r["doc_id"]), is_held(r["doc_id"]), len(own), sum(train[t] > 0 for t in own), n, round(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in own), 6)))
    return sorted(out), train


def plain_scores(rows, model, train, class_of):
    """Each text token by token, from the model's tables alone."""
    totals = collections.Counter()
    for t, n in train.items():
        totals[class_of.get(t, class_lm.CLASSES - 1)] += n
    rare = {t: n for t, n in train.items() if t not in class_of}
    cut = model.discount
    out = {}
    for r in rows:
        two = one = 0
        total = 0.0
        for t in tokens(r["text"]):
            c = class_of.get(t, class_lm.CLASSES - 1)
            total += model.after[two, one, c]
            if t in class_of:
                total += math.log10(train[t] / totals[c])
            elif t in rare:
                total += math.log10((rare[t] - cut) / sum(rare.values()))
            else:
                total += math.log10(cut * len(rare) / sum(rare.values()))
            two, one = (0 if c == 0 else one), c
            if one == 0:
                two = 0
        out.setdefault(str(r["doc_id"]), []).append(round(total, 5))
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def docs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "the one without an id"), (10**7, None), (10**7 + 1, ""), (10**7 + 2, " \n\t "), (10**7 + 3, "The OF and " * 20_000), (10**7 + 3, "The OF and " * 20_000), (10**7 + 4, "supercalifragilisticexpialidocious " * 3)], docs.schema)
    return docs.unionByName(odd).selectExpr("*", "1 as row", "2 as n", "'x' as word", "'y' as classes", "true as held_out", "3 as lo")


def keyed_classes(model, known, train):
    """The class of each known word, by its text."""
    from graphloom.llm.text import word_keys

    names = [t for t in train if t is not None]
    data = np.frombuffer("".join(names).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in names])
    ids = known.ids(*word_keys(data, ends - np.array([len(t.encode()) for t in names]), ends))
    return {t: int(model.classes[i]) for t, i in zip(names, ids, strict=True) if i >= 0} | {None: 0}


def test_scores_equal_the_plain_twin(spark, docs):
    rows = docs.collect()
    model, found = class_lm.fit_and_score(docs)
    got = found.collect()
    base, train = plain_base(rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == base
    texts = docs.filter(~class_lm.held_out(docs["doc_id"])).selectExpr("coalesce(text, '') as text")
    known, _ = class_lm.known_words(class_lm.word_counts(texts))
    class_of = keyed_classes(model, known, train)
    assert all(train[t] >= class_lm.LEAST for t in class_of if t is not None) and len(class_of) == len(known.n)
    want = plain_scores(rows, model, train, class_of)
    mine = {}
    for r in got:
        mine.setdefault(str(r["doc_id"]), []).append(round(r["score"], 5))
    assert set(mine) == set(want) and all(np.allclose(sorted(mine[k]), want[k], atol=1e-4) for k in want)
    # every history's probabilities sum to one over the classes, every class's over its words and the unknown one
    assert np.allclose((10**model.after).sum(axis=-1), 1)
    sums = np.bincount(model.classes[:-1], weights=10 ** model.emit[:-1], minlength=class_lm.CLASSES)
    assert np.allclose(sums[sums > 0], 1)
    rare = [n for t, n in train.items() if t not in class_of]
    assert sum((n - model.discount) / model.rare_tokens for n in rare) + 10**model.unknown == pytest.approx(1)


def test_classes_beat_the_base_on_held_out_texts(spark):
    got = registry.op13_lm_scoring(spark, "/root/testdata/sf0.01")
    held = got.filter("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    # 1254 against 11658 when written
    assert 10 ** (-held["sum(score)"] / held["sum(n_tokens)"]) < 0.2 * 10 ** (-held["sum(base_score)"] / held["sum(n_tokens)"])


def test_exchange_finds_alternating_classes(spark):
    # numbers follow words and words follow numbers; rarer words join the class of their kind by their contexts
    rng = np.random.default_rng(3)
    one, two = [f"w{i}" for i in range(60)], [f"n{i}" for i in range(60)]
    weight = 1 / np.arange(1, 61)
    pick = lambda names: names[rng.choice(60, p=weight / weight.sum())]
    texts = [(i, " ".join(f"{pick(one)} {pick(two)}" for _ in range(80))) for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for core in (1 << 14, 30):
        model, _ = class_lm.fit_and_score(docs, k=6, core=core)
        rows = docs.filter(~class_lm.held_out(docs["doc_id"])).select("text")
        known, _ = class_lm.known_words(class_lm.word_counts(rows), core)
        assert core > 30 or known.core < 31 < len(known.n)
        _, train = plain_base(docs.collect())
        kinds = collections.defaultdict(set)
        for t, c in keyed_classes(model, known, train).items():
            if t is not None:
                kinds[c].add(t[0])
        assert all(len(v) == 1 for v in kinds.values()) and 2 <= len(kinds) <= 4


def test_limits_on_words_keep_ties_together_and_score_all(spark, docs):
    counts = class_lm.word_counts(docs.filter("text is not null").select("text"))
    known, rare = class_lm.known_words(counts, core=50, known=200)
    assert known.core <= 50 and len(known.n) <= 200 and (known.n[1:-1] >= known.n[2:]).all()
    assert rare.count() + len(known.n) == counts.count()
    _, found = class_lm.fit_and_score(docs, core=50, known_most=200)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found.collect())
    assert got == plain_base(docs.collect())[0]


def test_nothing_to_learn_from(spark):
    rows = [(i, "a b c") for i in range(60) if is_held(i)]
    got = class_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in got)
    assert class_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
