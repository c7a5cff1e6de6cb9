"""Passages against brute force, and all queries on nulls, ties, repeats, long and empty tables."""

import re
from collections import defaultdict

import pytest

from veil.llm import entries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977} x{i % 1013}" for i in range(60_000))
SHARED = " ".join(f"passage{i}" for i in range(60))
CLASH = "words: string, pos: int, gram: long, n: int, key: long, size: int, label: string, bucket: int, at: int"
DOCUMENTS = "doc_id: long, text: string, lang: string, source: string, n_chars: long, " + CLASH
EXTRA = ("x", 1, 2, 3, 4, 5, "y", 6, 7)
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "web", 0),
    (3, "one", "en", None, 3),
    (5, "under the MIT license, under the MIT license", "en", "web", 40),
    (6, "the same words stand here again and again", "en", "web", 40),
    (7, "the same words stand here again and again", "en", "web", 40),
    (8, LONG, "en", "web", len(LONG)),
    (9, f"alpha {SHARED} beta", "en", "news", 500),
    (10, f"gamma delta {SHARED}", None, "news", 500),
    (11, "éè 中文 \U0001f600 \x00", "fr", "web", 9),
    (12, " \n\t ", "fr", "", 4),
]
TABLES = {
    "benchmark": ("item_id: long, text: string, words: string", [(1, SHARED, "x"), (1, SHARED, "x"), (2, None, "x"), (3, "", "x"), (None, "same words stand", "x")]),
    "labels": ("doc_id: long, quality: int, toxic: int, text: string", [(5, 1, 0, "x"), (5, 1, 0, "x"), (6, None, None, None), (None, 1, 1, "x"), (9, 0, 1, "x")]),
    "conversations": ("conv_id: long, turn: int, role: string, text: string, out: string", [(1, 0, "user", "a\\b</s>", "x"), (1, 0, "user", "a\\b</s>", "x"), (1, None, None, None, "x"), (None, 1, "assistant", "", "x"), (2, 1, "assistant", "[INST]" * 2000, None)]),
}


def written(spark, path, rows):
    def put(name, schema, data):
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")

    put("documents", DOCUMENTS, [(*r, *EXTRA) for r in rows])
    for name, (schema, data) in TABLES.items():
        put(name, schema, data if rows else [])
    return f"file://{path}"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return written(spark, str(tmp_path_factory.mktemp("odd")), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, str(tmp_path_factory.mktemp("empty")), [])


def test_suffix_dedup(spark, sf_dir):
    docs = {r["doc_id"]: SPACE.findall(r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    places = defaultdict(list)
    for i, w in docs.items():
        for s in range(len(w) - 49):
            places[tuple(w[s : s + 50])].append((i, s))
    covered = defaultdict(set)
    for where in places.values():
        for i, s in where if len(where) > 1 else []:
            covered[i].update(range(s, s + 50))
    # spans that touch are one
    want = {}
    for i, at in covered.items():
        run = longest = 0
        for p in range(len(docs[i])):
            run = run + 1 if p in at else 0
            longest = max(longest, run)
        want[i] = (len(at), longest)
    got = {r["doc_id"]: (r["n_dup_words"], r["longest"]) for r in entries.queries()["op4_suffix_dedup"](spark, sf_dir).collect()}
    assert got == want and want


@pytest.mark.parametrize("name", sorted(entries.queries()))
def test_odd_rows(spark, odd, name):
    rows = {r[0]: r.asDict() for r in entries.queries()[name](spark, odd).collect()}
    if name == "op6_chat_format":
        assert {i: r["n_turns"] for i, r in rows.items()} == {1: 3, None: 1, 2: 1, -7: 2}
        return
    if name == "op4_suffix_dedup":
        # the long text repeats itself with a period beyond its length, so only the passage counts
        assert {i: r["longest"] for i, r in rows.items()} == {9: 60, 10: 60}
        return
    assert sorted(rows) == [r[0] for r in ROWS]
    if name == "op1_decontamination":
        assert {i: (r["n_hit"], r["n_items"]) for i, r in rows.items() if r["contaminated"]} == {6: (3, 0), 7: (3, 0), 9: (60, 1), 10: (60, 1)}
    if name == "op7_ngram_join":
        assert {i: r["component_id"] for i, r in rows.items() if r["component_id"] != i} == {7: 6, 10: 9}
    if name == "op8_language_id":
        assert all(rows[i]["lang_pred"] == "und" for i in (1, 2, 12))
    if name == "op9_license_scan":
        assert (rows[5]["n_base"], rows[5]["first_word"], rows[5]["last_word"]) == (2, 0, 4)
    if name == "op2_token_files":
        assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == 1


@pytest.mark.parametrize("name", sorted(entries.queries()))
def test_empty_tables(spark, empty, name):
    rows = entries.queries()[name](spark, empty).collect()
    assert [r[0] for r in rows] == ([-7] if name == "op6_chat_format" else [])


def test_repeated_rows_and_null_ids(spark, tmp_path):
    """What is one place or one conversation; test_methods has the queries that give a row for every row."""
    path = written(spark, str(tmp_path), [*ROWS[:8], ROWS[7], (None, f"no id here {SHARED}", "en", "web", 9)])
    got = sorted((r["doc_id"] or 0, r["n_dup_words"], r["longest"]) for r in entries.queries()["op4_suffix_dedup"](spark, path).collect())
    assert got == [(0, 60, 60), (9, 60, 60), (9, 60, 60)]
    path = written(spark, str(tmp_path / "b"), [*ROWS[:8], ROWS[7]])
    assert entries.queries()["op4_suffix_dedup"](spark, path).collect() == []
    assert {r["conv_id"]: r["n_turns"] for r in entries.queries()["op6_chat_format"](spark, path).collect()} == {1: 3, None: 1, 2: 1, -7: 2}
