"""Queries without SQL, and the pipeline, against plain Python on whole small tables."""

import hashlib

import brute
import public_tokenizers
import pytest

import corpus_pipeline
from graphloom.llm import components, perplexity, pii, registry, scratch

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100 - i, 99 - i) for i in range(10)] + [(200, 300 + i) for i in range(50)] + [(500, 400 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 90 for i in range(90, 101)} | {i: 200 for i in [200, *range(300, 350)]} | {i: 400 for i in [500, *range(400, 450)]}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_classifier(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    trusted = {r["doc_id"]: r["held_out"] for r in perplexity.trusted_ids(labels).collect()}
    want = brute.judged([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], trusted)
    got = {r["doc_id"]: r for r in registry.op8_quality_classifier(spark, DATA).collect()}
    assert got.keys() == want.keys()
    for i, (score, judged, threshold, kept) in want.items():
        assert got[i]["perplexity"] == pytest.approx(score, rel=1e-4)
        assert got[i]["threshold"] == pytest.approx(threshold, abs=0.003)
        if judged is None or abs(judged / threshold - 1) > 1e-3:
            assert got[i]["kept"] == kept


def test_personal_data(spark, docs):
    told = [(10_000 + i, f"{w} wrote Zorblatt {v} a@b.com then {w} left {v} 4111 1111 1111 1111, 300.1.1.1 (10.0.0.255)") for i, (w, v) in enumerate([("one", "red"), ("two", "blue"), ("three", "green"), ("four", "grey")])]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(told, "doc_id long, text string"))
    want, whole = brute.all_spans(texts(rows)), texts(rows)
    for r in pii.find(rows).collect():
        base, terms = want[r["doc_id"]]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in [*base, *(("term", a, b) for a, b, _ in terms)])
    assert any(terms for _, terms in want.values())
    for i, text in texts(pii.sanitise(rows)).items():
        assert text == (None if whole[i] is None else brute.cleaned(whole[i], *want[i]))


def test_pipeline(spark, docs):
    from tokenizers import Tokenizer

    trusted = {r["doc_id"]: r["held_out"] for r in perplexity.trusted_ids(spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    stages = [scratch.table(docs, "documents")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages.append(scratch.table(stage(spark, stages[-1], DATA), name.replace(" ", "-")))
    at = [texts(df) for df in stages]
    good = brute.judged([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], trusted)
    left = {i: t for i, t in at[0].items() if t is not None and good[i][3]}
    assert at[1] == left
    found = brute.components(left, 5, 80)
    left = {i: t for i, t in left.items() if found[i] == i}
    assert at[2] == left
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    hit = {i for i, _ in brute.contained(left, items, 5, 80)}
    left = {i: t for i, t in left.items() if i not in hit}
    assert at[3] == left
    spans = brute.all_spans(left)
    left = {i: brute.cleaned(t, *spans[i]) for i, t in left.items()}
    assert at[4] == left
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, bins = brute.pieces(left, lambda t: lib.encode(t, add_special_tokens=False).ids)
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert len({r["sequence_id"] for r in rows}) == bins
    for number in {r["sequence_id"] for r in rows}:
        upto = 0
        for offset, length in sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == number):
            assert offset == upto
            upto += length
        assert upto <= 4096
