"""Span algebra against brute force on random spans, and small helpers."""

import random

import pytest
from pyspark.sql import functions as F

from veil import store
from veil.operators import spans
from veil.operators.rules import ENTITY, Config, detect
from veil.streaming import rewrite

NAMES = ("start", "end", "source", "pii_type", "text", "confidence", "priority")


def resolved(rows):
    kept = []
    for s in sorted(set(rows), key=lambda s: (s[0] - s[1], -s[6], s[0], s[2])):
        if not any(s[0] < k[1] and k[0] < s[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def test_resolve_on_random_spans(spark):
    r = random.Random(5)
    sets = []
    for i in range(300):
        rows = []
        for n in range(r.randrange(13)):
            a, size = r.randrange(41), r.randrange(1, 13)
            rows.append((a, a + size, f"s{n:02d}", "EMAIL", "x" * size, 1.0, r.choice([10, 20, 30])))
        sets.append((i, rows))
    d = spark.createDataFrame(sets, f"doc_id long, entities array<{ENTITY}>")
    out = d.select("doc_id", spans.resolve(F.col("entities")).alias("a"), spans.resolve(F.reverse("entities")).alias("b"))
    again = {r["doc_id"]: r for r in out.withColumn("c", spans.resolve(F.col("a"))).collect()}
    for i, rows in sets:
        want = [tuple(x[:3]) for x in resolved(rows)]
        assert [tuple(x)[:3] for x in again[i]["a"]] == want
        assert again[i]["a"] == again[i]["b"] == again[i]["c"]


@pytest.mark.parametrize(("text", "edits", "want"), [
    ("abc", [], "abc"), ("", [], ""), ("abc", [(0, 3, "x")], "x"), ("a😀c", [(1, 2, "")], "ac"), ("one two", [(4, 7, "2"), (0, 3, "1")], "1 2"), ("abc", [(0, 1, None)], None),
])
def test_apply(spark, text, edits, want):
    rows = [(1, text, [(a, b, "s", "EMAIL", text[a:b], 1.0, 20, new) for a, b, new in edits])]
    d = spark.createDataFrame(rows, f"doc_id long, text string, assigned array<{ENTITY[:-1]},replacement:string>>")
    assert d.select(spans.apply(F.col("text"), F.col("assigned"))).first()[0] == want


def test_blocks_need_no_shuffle(spark):
    d = spark.createDataFrame([(1, "a\n\nbc"), (2, None)], "doc_id long, text string")
    out = spans.blocks_of(d)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.orderBy("doc_id", "block").collect()] == [(1, 0, 0, 1, "a"), (1, 1, 2, 2, ""), (1, 2, 3, 5, "bc"), (2, 0, 0, 0, "")]


def test_detection_is_one_scan_of_the_text(spark, sf_dir):
    d = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), Config(as_of="2024-06-30")).select("doc_id", "entities")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_scratch_tables_go(spark, tmp_path):
    d = spark.range(5)
    with store.scratch(spark) as path:
        t = store.cut(d)
        assert t._veil_path.startswith(path) and t.count() == 5
    u = store.cut(d)
    store.release(u)
    for x in (t, u):
        with pytest.raises(Exception, match="(?i)not.exist|PATH_NOT_FOUND|FileNotFound"):
            spark.read.parquet(x._veil_path).count()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *a):
            return a[-1] if len(a) > 1 else None

    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = staticmethod(Conf)

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    session = type("Session", (), {"sparkContext": Context, "conf": Conf()})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(session)


def test_a_stream_is_rewritten_batch_by_batch(spark, tmp_path):
    spark.createDataFrame([(i, f"mail u{i}@x.org") for i in range(6)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = rewrite.start(stream, Config(as_of="2024-06-30"), str(tmp_path / "at"), lambda rows, n: seen.extend(r["rewritten"] for r in rows.collect()))
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 6 and not any(f"u{i}@x.org" in s for i in range(6) for s in seen)
