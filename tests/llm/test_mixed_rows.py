"""Rows without an id, or that share one, in the pipeline's mix."""

import pytest

from veil.llm import mixing

pipeline = pytest.importorskip("corpus_pipeline")


def test_copies_come_from_each_row(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, f"no id {i} " + "word " * 20, "web") for i in range(60)]
    rows += [(i, f"id {i} " + "word " * 20, "web") for i in range(40)]
    # many rows of one id, so that the edge of the budget runs through them
    rows += [(999, f"shared {i} " + "word " * 20, "news") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = [r.asDict() for r in pipeline.mix_sources(spark, docs, f"file://{tmp_path}").collect()]
    want = {(r["source"], r["target"]) for r in mixing.mix_documents(docs, labels).collect()}
    assert len(want) == 2
    for source, target in want:
        words = sum(len(r["text"].split()) for r in out if r["source"] == source)
        assert abs(words - target) <= 12, (source, words, target)
    assert any(r["doc_id"] is None for r in out)
