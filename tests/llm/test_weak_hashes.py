"""Thue-Morse words of one length collide under polynomial hashes modulo a power of two: nothing may confuse them."""

import zlib

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import decontamination, packing, token_counts

BITS = "a"
for _ in range(11):
    BITS += BITS.translate(str.maketrans("ab", "ba"))
OTHER = BITS.translate(str.maketrans("ab", "ba"))


def test_weak_hashes(spark):
    docs = spark.createDataFrame([(1, f"{BITS} x {OTHER}"), (2, OTHER), (3, BITS)], "doc_id long, text string").coalesce(1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    crc = lambda ids: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert got == {i: crc([*lib.encode(t, add_special_tokens=False).ids, 1]) for i, t in texts.items()}
    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, model).collect()} == {i: len(pieces.encode(t)) for i, t in texts.items()}
    items = spark.createDataFrame([(7, BITS)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontamination.contained_items(docs, items).collect()) == [1, 3]
