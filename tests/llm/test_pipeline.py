"""Stages of the pipeline on their own input, and the whole of it."""

import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.test_contracts import LOWER, SPACE, names
from tests.llm.test_edges import ROWS, written
from tests.llm.test_methods import key_of
from tokenizers import Tokenizer

from veil.llm import entries, langid
from veil.llm.common import cut

pipeline = pytest.importorskip("corpus_pipeline")


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(pipeline.STAGES)
    q = entries.queries()
    known = cut(steps["language"](spark, docs, sf_dir))
    assert known.columns == docs.columns and 0.9 * docs.where("trim(text) <> ''").count() <= known.count() <= docs.count()
    single = cut(steps["near_copies"](spark, docs, sf_dir))
    assert ids(single) == sorted(r["doc_id"] for r in q["op7_ngram_join"](spark, sf_dir).collect() if r["component_id"] == r["doc_id"])
    clean = cut(steps["decontaminate"](spark, docs, sf_dir))
    assert ids(clean) == sorted(r["doc_id"] for r in q["op1_decontamination"](spark, sf_dir).collect() if not r["contaminated"])
    mixed = cut(steps["mix_sources"](spark, docs, sf_dir))
    want = [r["doc_id"] for r in q["op3_mixing"](spark, sf_dir).collect() for _ in range(r["taken"] // max(r["size"], 1))]
    assert ids(mixed) == sorted(want) and single.columns == clean.columns == mixed.columns == docs.columns


def test_the_whole_against_a_plain_version(spark, sf_dir):
    """Languages as identified; near copies, windows, draws and tokens each by a plain version of its own."""
    model = langid.learn(spark.read.parquet(f"{sf_dir}/documents.parquet").where(~F.coalesce(langid.held_out(F.col("doc_id"), 4, 2), F.lit(False))))
    docs = {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    known = {r["doc_id"] for r in langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), model).collect() if r["score"] >= pipeline.LEAST_LANGUAGE}
    # one of each group of near copies
    sets = {}
    for i in sorted(known):
        w = SPACE.findall((docs[i]["text"] or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in [b for b in sets if b > a and sets[a] and sets[b]]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    single = [i for i in sets if top(i) == i]
    # no window of an item
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = names(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1) if w else 0)}
    sizes = {len(w) for w in windows}
    clean = []
    for i in single:
        w = names(docs[i]["text"])
        if not any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1)):
            clean.append(i)
    # draws
    size = {i: len(SPACE.findall(docs[i]["text"] or "")) for i in clean}
    good = {r["doc_id"]: 2.0 if r["quality"] > 0 else 0.5 for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").collect()}
    by_source = defaultdict(list)
    for i in clean:
        by_source[docs[i]["source"]].append((key_of(i, docs[i]["text"], good.get(i, 1.0)), i))
    total = {s: sum(size[i] for _, i in rows) for s, rows in by_source.items()}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, left, free = {}, 1.5 * sum(total.values()), set(total)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full} if full else share
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    copies = []
    for s, rows in by_source.items():
        before, epochs = 0, int(target[s] // total[s])
        for _, i in sorted(rows):
            n = epochs + (before + size[i] / 2 < target[s] - epochs * total[s])
            copies += [i] * (n if size[i] else 0)
            before += size[i]
    # tokens
    tok, at, want = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), 0, []
    for i in sorted(copies):
        t = [*tok.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(t), zlib.crc32(struct.pack(f"<{len(t)}I", *t))))
        at += len(t)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in pipeline.run(spark, sf_dir).collect())
    assert got == want


@pytest.mark.parametrize("rows", [ROWS, []])
def test_odd_and_empty(spark, tmp_path, rows):
    out = pipeline.run(spark, written(spark, str(tmp_path), rows)).collect()
    assert bool(out) == bool(rows)
