"""Edge cases of the stages and of the operators that keep their input's columns: clashing columns, nulls, repeats, empties."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, decontamination, licences, perplexity, shards

DATA = "/root/testdata/sf0.001"
CLASH = ["_id", "_lang", "_text", "_hit", "_key", "_row", "_gone", "base", "terms", "_h", "_d", "_hash", "_place", "shard", "kept", "text_hash"]


@pytest.fixture(scope="module")
def wide(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, wide, name, stage):
    got = stage(spark, wide, DATA)
    assert got.columns == wide.columns
    assert stage(spark, wide.limit(0), DATA).count() == 0
    plain = stage(spark, wide.drop(*CLASH), DATA)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(r["doc_id"] for r in plain.select("doc_id").collect())


def test_rows_are_judged_by_their_own_text(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    good = docs.filter("length(text) > 1000 and lang = 'en'").orderBy("doc_id").first()["text"]
    odd = spark.createDataFrame([(None, f"{good} {item}", "en", "s", 1), (None, good, "en", "s", 1), (10**6, "zzzz " * 400, "en", "s", 1), (10**6, good + " more words", "en", "s", 1), (10**6 + 1, None, "en", "s", 1), (10**6 + 2, "", None, "s", 1), (10**6 + 3, "word " * 200_000, "en", "s", 1)], docs.schema)
    both = docs.unionByName(odd)
    judged = corpus_pipeline.quality(spark, both, DATA).filter("doc_id is null or doc_id >= 1000000").collect()
    texts = {(r["doc_id"], r["text"]) for r in judged}
    assert (10**6, good + " more words") in texts and (10**6, "zzzz " * 400) not in texts and (None, good) in texts
    assert not {10**6 + 1, 10**6 + 2} & {i for i, _ in texts}
    clean = decontamination.without_contaminated(both, spark.read.parquet(f"{DATA}/benchmark.parquet")).filter("doc_id is null").collect()
    assert [r["text"] for r in clean] == [good]
    twice = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (1, "h i j k l m n", "en", "s", 1), (None, "x", "en", "s", 1)], docs.schema)
    ids = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, twice, DATA).collect()]
    assert sorted(ids, key=str) == [1, None]


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(1, "a" * 50, "p"), (1, "a" * 50, "q"), (1, "b" * 50, "r"), (None, "c" * 90, "s"), (2, None, "t"), (3, "", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    placed = shards.write(docs, str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, ((r["doc_id"], r["text"], r["shard"]) for r in back.collect()))) == sorted(map(str, rows))
    assert placed.count() == 6 and placed.filter("over_limit").count() == 0
    assert back.select("_shard").distinct().count() > 1
    same = spark.createDataFrame([(7, "z" * 80)] * 3 + [(8, "y" * 20)], "doc_id long, text string")
    got = shards.shard(same, 100).collect()
    assert sorted(r["over_limit"] for r in got) == [False, True, True, True]


def test_both_scoring_paths_are_one(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    a, b = (sorted(map(tuple, perplexity.classify(docs, labels, most_grams=n).collect())) for n in (10**9, 0))
    assert a == b


def test_streamed_log(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t} <|end|>") for t in range(40)] + [(2, 0, "user", "b"), (2, 0, "user", "b"), (2, 0, "user", "b"), (2, 0, "assistant", None), (3, None, None, ""), (None, 1, "user", "long " * 50_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.streamed_events(table)
    assert {r["kind"] for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    read = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_conversations(log).collect()}
    assert read[1] == [(r, t) for _, _, r, t in rows[:40]]
    assert sorted(read[2]) == sorted([("user", "b")] * 3 + [("assistant", "")]) and read[3] == [("", "")] and read[None] == [("user", "long " * 50_000)]
    assert chat.digests(chat.format_conversations(chat.streamed_events(table.limit(0)))).count() == 0


def test_columns_of_a_log_are_ignored(spark):
    rows = [(1, 0, "user", "question"), (1, 1, "assistant", "answer of some length"), (1, 2, "assistant", "more")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = [F.create_map(F.lit("a"), F.lit(1)).alias("_row"), F.lit("z").alias("_tie"), (-F.col("seq")).alias("_step"), F.struct(F.lit(1)).alias("_later"), F.lit(2).alias("text_hash")]
    for log in (chat.streamed_events(table), chat.turn_events(table)):
        want = [tuple(r) for r in chat.digests(chat.format_conversations(log)).collect()]
        got = [tuple(r) for r in chat.digests(chat.format_conversations(log.select("*", *extra))).collect()]
        assert got == want and got[0][3] == len("answer of some length") + len("more")
    own = spark.createDataFrame([(1, 1, "message", 1, "assistant", None), (1, 2, "delta", 1, None, "ab"), (1, 3, "delta", 1, None, "cd")], "conv_id long, seq long, kind string, turn long, role string, text string")
    assert chat.format_conversations(own.select("*", (-F.col("seq")).alias("_within"), *extra)).first()["loss_spans"] == [[19, 23]]


WRAPPED = {
    "mit": '/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the "Software"), to deal\n * in the Software without restriction, including without limitation the rights\n */\nint x;',
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\nimport os",
}


def test_licences(spark):
    said = [*WRAPPED.items(), ("mit", "License: MIT"), ("gpl", "Code: GPLv3"), ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3."), ("apache-2.0", "one\nSPDX-License-Identifier: Apache-2.0\ntwo"), ("unknown", "Licensed under the Eclipse Public License, version 2.0.")]
    extended = ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: MIT-0", "Available under CC BY-NC-ND 3.0."]
    dual = [("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}), ("Licensed under the Apache License, Version 2.0 or the MIT License.", {"mit", "apache-2.0"}), ("This work is licensed under the GNU General Public License, version 3, or the Mozilla Public License.", {"gpl", "mpl-2.0"})]
    said += [("unknown", t) for t in extended] + [(families, t) for t, families in dual]
    odd = [(100, None), (101, ""), (102, "\n\n"), (103, "plain words"), (104, "word " * 100_000 + "\nLicense: MIT"), (105, "License: MIT"), (105, "License: MIT"), (None, "License: MIT")]
    made = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(said)] + odd, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("family", F.lit("f"))
    rows = made.unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit(1).alias("line"), F.lit("f").alias("family")))
    model = licences.train(rows)
    got = licences.scan(rows).collect()
    for i, (family, _) in enumerate(said):
        assert {r["family"] for r in got if r["doc_id"] == i} == ({family} if isinstance(family, str) else family), i
    assert sorted((r["doc_id"], r["first_line"]) for r in got if r["doc_id"] in (100, 101, 102, 103, 104, 105)) == [(104, 1), (105, 0)]
    assert [r["family"] for r in got if r["doc_id"] is None] == ["mit"]
    assert not any(r["confirmed"] for r in licences.Model.confirmed(model, spark.createDataFrame([(t,) for t in licences.UNSEEN], "line string").select(F.struct("line").alias("key"), "line")).collect())
    want = set(brute.licence_rows({(r["doc_id"], r["text"]) for r in rows.collect()}, model))
    assert {(r["doc_id"], r["first_line"], r["n_lines"], r["family"]) for r in got} == want
    assert licences.scan(rows.limit(0)).count() == 0
