"""Edge cases and brute-force twins of the training-data operators."""

import hashlib
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, decontamination, licences, near_dup, packing, perplexity, pii, quality_rules, registry, shards, token_counts

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, gram long"
ODD = [(1, None), (2, ""), (3, "a b c d e f g"), (4, "a b c d e f g"), (5, "x " * 30000), (6, " \n\t "), (7, "+1 (017) 555-7713 me.you@mail.example.com"), (None, "no id"), (3, "a b c d e f g")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", None, 0, 5, 6) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_token_counts(spark, docs, odd):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    for df in (docs, odd):
        texts = [r["text"] or "" for r in df.collect()]
        got = sorted((r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, model).collect())
        assert got == sorted((len(t.encode()), len(lib.encode(t))) for t in texts)


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for df in (docs, odd):
        rows = packing.packed_documents(df, path).collect()
        want = []
        for r in df.collect():
            ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            want += [(str(r["doc_id"]), k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[k : k + 4096]))) for k in range(0, len(ids), 4096)]
        assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        plain = []
        for n in sorted((r["length"] for r in rows), reverse=True):
            fit = [b for b in range(len(plain)) if plain[b] >= n]
            if fit:
                plain[min(fit, key=lambda b: plain[b])] -= n
            else:
                plain.append(4096 - n)
        assert len(bins) == len(plain)


def test_near_duplicates(spark, docs, odd):
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    for df in (docs, odd):
        sets = {}
        for r in df.filter("doc_id is not null").collect():
            w = words(r["text"])
            sets[r["doc_id"]] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
        comp = {i: i for i in sets}
        for i in sets:
            for j in sets:
                if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    a, b = comp[i], comp[j]
                    comp = {k: min(a, b) if v in (a, b) else v for k, v in comp.items()}
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df, 2, 80).collect()}
        assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_decontamination(spark, docs, odd):
    items = spark.createDataFrame([(1, "c d e f g"), (2, None), (3, ""), (4, "B C"), (5, "zz yy xx ww vv uu")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contained_items(odd, items).collect()}
    assert got == {(3, 1), (4, 1), (3, 4), (4, 4)}
    assert {r["doc_id"] for r in decontamination.without_contaminated(odd, items).collect()} == {1, 2, 5, 6, 7, None}
    assert decontamination.contained_items(odd, items.limit(0)).count() == 0


def test_pii(spark, odd):
    got = {r["doc_id"]: r for r in pii.find(odd).collect()}
    assert got[7]["n_phone"] == 1 and got[7]["n_email"] == 1
    assert got[7]["spans"] == "email:18:41,phone:0:17"
    assert got[7]["base_sha256"] == hashlib.sha256(b"email:18:41,phone:0:17").hexdigest()
    assert got[1]["spans"] == "" and len(got) == 8
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(odd).collect()}
    assert clean[7] == "[PHONE] [EMAIL]" and clean[1] is None and clean[3] == "a b c d e f g"
    told = spark.createDataFrame([(i, f"{w} wrote Zorblatt {v} a@b.com then {w} left {v}") for i, (w, v) in enumerate([("one", "red"), ("two", "blue"), ("three", "green"), ("four", "grey")])] + [(i, "then left wrote plain words") for i in range(10, 200)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find(told).collect()}
    assert all("term:10:18" in spans[0] for _ in [0]) and spans[10] == ""


def test_chat(spark):
    for text in ["</s>[INST] ok [/INST]", "<\\|end|><|end|>", "[\\INST]", "", "\\", "<|turn|>a\n<|end|>\n"]:
        assert chat.unescape(chat.escape(text)) == text
        assert chat.parse(chat.render("us\\er\n", text)[0]) == [("us\\er\n", text)]
    log = spark.createDataFrame([(1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", None), (1, 3, "delta", 1, None, "He"), (1, 4, "delta", 1, None, "y"), (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, None, "Yo"), (1, 7, "edit", 0, None, "hello")], "conv_id long, seq long, kind string, turn long, role string, text string")
    row = chat.format_conversations(log).first()
    assert chat.parse(row["formatted"]) == [("user", "hello"), ("assistant", "Yo")]
    assert [row["formatted"][a:b] for a, b in row["loss_spans"]] == ["Yo"]
    again = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "assistant", "z"), (1, 0, "assistant", None), (1, None, None, "n"), (None, 3, "user", "")]
    read = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_conversations(chat.turn_events(spark.createDataFrame(again, "conv_id long, turn long, role string, text string"))).collect()}
    assert sorted(read[1]) == sorted([("user", "b"), ("user", "b"), ("assistant", "z"), ("assistant", ""), ("", "n")]) and read[None] == [("user", "")]
    rows = {r["conv_id"]: r for r in registry.op5_chat_formatting(spark, DATA).collect()}
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect()
    for conv in {r["conv_id"] for r in turns}:
        mine = [(r["role"], r["text"] or "") for r in turns if r["conv_id"] == conv]
        assert rows[conv]["n_turns"] == len(mine)
        assert rows[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert rows[conv]["loss_sha256"] == hashlib.sha256("".join(b for a, b in mine if a == "assistant").encode()).hexdigest()
    assert rows[-1]["loss_chars"] == 21


def test_quality_rules(spark, odd):
    got = quality_rules.verdicts(odd)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["n_words"] == 0 and rows[1]["base_failed"] and rows[5]["n_repeat_words"] == 30000
    table = {r["rule"]: r for r in quality_rules.ablations(got, "web", 1).collect()}
    assert table["few_words"]["rejected"] == 8 and table["repeated_windows"]["rejected"] == 1


def test_shards(spark, docs, odd):
    limit = 20_000
    rows = shards.shard(docs, limit).collect()
    assert len(rows) == docs.count()
    total = {}
    for r in rows:
        total[r["shard"]] = total.get(r["shard"], 0) + r["n_bytes"]
    assert all(r["shard_bytes"] == total[r["shard"]] for r in rows)
    big = {r["shard"] for r in rows if r["over_limit"]}
    assert all(v <= limit for k, v in total.items() if k not in big)
    names = sorted(total)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    by_bits = lambda p: sum(v for k, v in total.items() if k.startswith(p))
    assert all(by_bits(k[:-1]) > limit for k in total)
    assert shards.shard(odd, 10).count() == 9 and shards.shard(odd.limit(0)).count() == 0


def test_perplexity(spark, docs, odd):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    a = {r["doc_id"]: r for r in perplexity.classify(docs, labels).collect()}
    b = {r["doc_id"]: r for r in perplexity.classify(docs, labels, most_grams=0).collect()}
    assert a == b
    good = {r["doc_id"] for r in labels.filter("quality = 1 and toxic = 0").collect()}
    bad = {r["doc_id"] for r in labels.filter("quality = 0").collect()}
    assert sum(a[i]["kept"] for i in good) >= 0.95 * len(good) and sum(a[i]["kept"] for i in bad) <= 0.4 * len(bad)
    rows = {r["doc_id"]: r for r in perplexity.classify(odd, labels).collect()}
    assert not rows[1]["kept"] and not rows[2]["kept"]
    probs, weights = perplexity.train(docs.filter("text is not null").limit(40).select("text"))
    mass = probs.filter("size = 1").agg(F.sum(F.exp(F.col("logp") / perplexity.SCALE))).first()[0]
    assert 0.5 < mass <= 1.0001


def test_empty_tables(spark, odd):
    none, labels = odd.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    results = [near_dup.near_duplicates(none), quality_rules.verdicts(none), pii.find(none), perplexity.classify(none, labels), packing.packed_documents(none, public_tokenizers.path("word_bpe_49k.json")), token_counts.token_counts(none, public_tokenizers.path("piece_bpe_32k.model"))]
    assert [df.count() for df in results] == [0] * 6
