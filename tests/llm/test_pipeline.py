"""The pipeline on the smallest tables: each stage takes effect and returns the columns of documents."""

import corpus_pipeline
from graphloom.llm import scratch

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, DATA), name.replace(" ", "-"))
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.filter("text like '%@mail%'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == before
