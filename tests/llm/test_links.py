"""Numbers of links of the n-gram join against brute force, where few links make many components."""

import random
import re

import pytest

from veil.llm import entries, ngram_join

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def links(texts):
    """{id: (class_id, n_links)} of texts by id."""
    sets = {}
    for i, t in texts.items():
        w = SPACE.findall((t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))) if w else frozenset()
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = [i for s, i in first.items() if s]
    n = dict.fromkeys(sets, 0)
    for k, a in enumerate(reps):
        for b in reps[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                n[a] += 1
                n[b] += 1
    return {i: (first[s], n[first[s]]) if s else (i, 0) for i, s in sets.items()}


def found(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def test_links_of_the_tables(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = found(entries.queries()["op7_ngram_join"](spark, sf_dir))
    assert got == links(texts) and any(n for _, n in got.values())


@pytest.mark.parametrize("block", [1000, 7])
def test_links_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = {1: None, 2: "", 3: "one two"}
    for i in range(10, 70):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(200)] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    texts |= {80: texts[20], 81: texts[20].upper()}
    want = links(texts)
    # a repeated row and a null id
    rows = [*texts.items(), (30, texts[30]), (None, texts[40])]
    df = ngram_join.near_links(spark.createDataFrame(rows, "doc_id long, text string"))
    got = found(df)
    # a row without an id links as any other
    assert got.pop(None) == want[40]
    assert got == want
    every = sum(n for _, n in want.values())
    assert every > 10 * len(want), "most pairs are links, far more than a tree of them"
