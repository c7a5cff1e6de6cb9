"""Candidate words of the toxicity model when there are very many, and when the fit sees few of them."""

import numpy as np

from veil.llm import toxicity


def tables(spark, n_rare):
    """n_rare words, each in four toxic texts only, beside words of slight correlation."""
    texts = [(4 * i + j, f"good day friend. rare{i}x", 1) for i in range(n_rare) for j in range(4)]
    texts += [(4 * n_rare + i, f"good day friend. calm{i % 50}x word", 0) for i in range(20 * n_rare)]
    return spark.createDataFrame(texts, "doc_id long, text string, toxic int")


def test_no_word_is_cut(spark):
    d = tables(spark, 5000)
    words, _, _, _ = toxicity.candidates(d.select("doc_id", "text", "toxic"))
    assert len(words) == 5000


def test_words_outside_the_fit_have_weights(spark, monkeypatch):
    d = tables(spark, 300)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 600)
    m = toxicity.learn(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    assert len(m.words) > 100 and (m.weights > 0).all()
    rows = toxicity.score(d.select("doc_id", "text"), m).join(d.select("doc_id", "toxic"), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in rows]) > 0.9
