"""Queries of sources and sinks: Word packages, labelled corpora, floors, reports and streams, made from the tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions.text import spans
from veil.operators import scoring
from veil.operators.rules import Config
from veil.sources import corpora as C
from veil.sources import docx, reports
from veil.store import cut, remove, shared_path

from . import quality
from .engine import Engine
from .registry import cases, cases_sql, documents, query, table

AS_OF = "2024-06-30"
CONFIG = Config(as_of=AS_OF)
HEADER, CODE, AUTHOR = "Head of {n}", 'HYPERLINK "http://x{n}.org"', "Bob {n}"


def packages(spark, sf_dir) -> DataFrame:
    """(doc_id, content): each document as a package of its lines, with a header, a field code, an author and a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                says = lambda x, i=i: x.replace("{n}", str(i))
                made.append(docx.build((text or "").split("\n"), says(HEADER), says(CODE), says(AUTHOR), (f"mailto:the{i}@x.org",), run_length=11))
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])

    return documents(spark, sf_dir).mapInArrow(run, "doc_id long, content binary")


# The lines that a package can hold, then the paragraph of the field code, the header and the code
_LINES = r"""k AS (SELECT doc_id, string_split(replace(regexp_replace(coalesce(text, ''), '[^\x09\x0A\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g'), chr(9), ' '), chr(10)) AS ls FROM documents),
    a AS (SELECT doc_id, list_concat(ls, ['', 'Head of ' || doc_id, 'HYPERLINK "http://x' || doc_id || '.org"']) AS ls FROM k), u AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM a),
    b AS (SELECT doc_id, i - 1 AS block, CASE WHEN i = len(ls) THEN 'instr' ELSE 'paragraph' END AS kind, CASE WHEN i = len(ls) - 1 THEN 'word/header1.xml' ELSE 'word/document.xml' END AS part,
      coalesce(list_sum(list_transform(ls[1:i-1], lambda s: length(s) + 1)), 0) AS s, ls[i] AS text FROM u)"""


@query(f"WITH {_LINES} SELECT doc_id, CAST(block AS BIGINT) AS block, kind, part, CAST(s AS BIGINT) AS span_start, CAST(s + length(text) AS BIGINT) AS span_end, text FROM b")
def package_blocks(spark, sf_dir):
    d = docx.block_rows(docx.opened(packages(spark, sf_dir)))
    return d.select("doc_id", F.col("block").cast("long").alias("block"), "kind", "part", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "text")


@query(f"WITH {_LINES} SELECT doc_id, string_agg(text, chr(10) ORDER BY block) AS text FROM b GROUP BY doc_id")
def package_text(spark, sf_dir):
    return docx.opened(packages(spark, sf_dir)).select("doc_id", "text")


@query("""
    SELECT doc_id, part_name, part_name LIKE '%.xml' OR part_name LIKE '%.rels' AS audited FROM documents, (VALUES ('[Content_Types].xml'), ('_rels/.rels'), ('word/document.xml'), ('word/_rels/document.xml.rels'), ('docProps/core.xml'), ('docProps/app.xml'), ('word/header1.xml')) v(part_name)""")
def package_parts(spark, sf_dir):
    d = docx.part_rows(packages(spark, sf_dir))
    return d.select("doc_id", "part_name", (F.endswith("part_name", F.lit(".xml")) | F.endswith("part_name", F.lit(".rels"))).alias("audited"))


@query(f"""
    WITH {_LINES}, n AS (SELECT doc_id, block, replace(text, 'the', '<THE>') AS text FROM b)
    SELECT doc_id, string_agg(n.text, chr(10) ORDER BY block) AS text, '' AS people, CASE WHEN max(strpos(b2.text, 'the')) > 0 THEN 'mailto:<THE>' || doc_id || '@x.org' ELSE 'mailto:the' || doc_id || '@x.org' END AS target
    FROM n JOIN (SELECT doc_id, block, text FROM b) b2 USING (doc_id, block) GROUP BY doc_id""")
def package_edits(spark, sf_dir):
    """Every `the` of every package replaced in its runs; read back with the fields that name people and the link."""
    d = docx.opened(packages(spark, sf_dir))
    found = spans(F.coalesce("text", F.lit("")), "the")
    edits = F.transform(found, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"), F.lit("<THE>").alias("replacement")))
    new = cut(docx.saved(d.withColumn("assigned", edits)))
    parts = docx.part_rows(new)
    said = parts.groupBy("doc_id").agg(
        F.max(F.when(F.col("part_name") == "docProps/core.xml", F.concat(F.regexp_extract("text", "<dc:creator>(.*?)</dc:creator>", 1), F.regexp_extract("text", "<cp:lastModifiedBy>(.*?)</cp:lastModifiedBy>", 1)))).alias("people"),
        F.max(F.when(F.col("part_name") == "word/_rels/document.xml.rels", F.replace(F.replace(F.regexp_extract("text", 'Target="(.*?)"', 1), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")))).alias("target"),
    )
    return docx.opened(new.drop("error")).select("doc_id", "text").join(said, "doc_id")


_RUNS = [("one two three", 4, 4, 7, "X", "one |X |thre|e"), ("abcdef", 2, 1, 5, "-", "a-||f"), ("abcdef", 6, 0, 6, "", ""), ("abcdef", 3, 3, 4, "++", "abc|++ef")]


@query(f"SELECT doc_id, said FROM {cases_sql(_RUNS, ('text', 'size', 'a', 'b', 'fresh', 'said'))}")
def run_splices(spark, sf_dir):
    """A replacement goes to the first run it touches; those inside become empty; the last keeps its rest."""
    d = cases(spark, sf_dir, _RUNS, ("text", "size", "a", "b", "fresh", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, text, size, a, b, new, _ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out.append("|".join(docx.spliced([text[i : i + size] for i in range(0, len(text), size)], [(a, b, new)])))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["doc_id", "said"])

    return d.mapInArrow(run, "doc_id long, said string")


@query("SELECT c_custkey AS doc_id, c_custkey % 3 = 0 AS unreadable FROM customer")
def package_errors(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [b"no package" if i % 3 == 0 else docx.build([f"line {i}"]) for i in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])

    return docx.opened(d.mapInArrow(run, "doc_id long, content binary")).select("doc_id", (F.col("error").isNotNull() & F.col("text").isNull()).alias("unreadable"))


@query("SELECT s_suppkey AS doc_id, 'Mail <x>' AS start, CAST(2 AS BIGINT) AS replaced, true AS clean, true AS saved FROM supplier")
def rewrite_packages(spark, sf_dir):
    """Packages with a mail address in the text and in a field code, through the whole engine and its checks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [docx.build([f"Mail jane{i}@site.org now", "nothing"], field_code=f'HYPERLINK "mailto:jane{i}@site.org"', author="Bob", links=(f"mailto:jane{i}@site.org",), run_length=3) for i in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])

    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id")).mapInArrow(run, "doc_id long, content binary")
    engine = Engine(CONFIG)
    done = cut(engine.rewrite_packages(d))
    engine.verify(done)
    again = docx.opened(done.select("doc_id", F.col("saved").alias("content"))).select("doc_id", F.col("text").alias("new"))
    j = done.join(again, "doc_id")
    return j.select("doc_id", F.regexp_replace(F.regexp_extract("new", r"^(Mail \S+)", 1), r"\S+@\S+", "<x>").alias("start"), F.size("assigned").cast("long").alias("replaced"), (~F.contains("new", F.concat(F.lit("jane"), F.col("doc_id").cast("string"), F.lit("@")))).alias("clean"), (F.col("new") == F.col("rewritten")).alias("saved"))


@query("WITH k AS (SELECT s_suppkey AS n FROM supplier) SELECT 'p' || n || '.docx' AS name, CAST(0 AS BIGINT) AS block, 'line ' || n AS text FROM k")
def package_files(spark, sf_dir):
    """Packages written by the data source, and read by it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.record_batch([pa.array([f"p{i}.docx" for i in ids]), pa.array([docx.build([f"line {i}"]) for i in ids], pa.binary())], ["name", "content"])

    docx.register(spark)
    folder = shared_path(spark, "packages")
    table(spark, sf_dir, "supplier").select("s_suppkey").mapInArrow(run, "name string, content binary").write.format("docx").mode("append").save(folder)
    d = cut(spark.read.format("docx").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("block").cast("long").alias("block"), "text"))
    remove(spark, folder)
    return d


# Labelled corpora and floors as JSON


def corpus_objects(spark, sf_dir) -> DataFrame:
    """(value): a corpus object a customer, with a mail address and a name as labels."""
    n = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    text = F.concat(F.lit("write u"), n, F.lit("@x.org, Asha"))
    label = lambda no, kind, said, a, b: F.struct(F.concat(n, F.lit(no)).alias("id"), F.lit(kind).alias("pii_type"), said.alias("text"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    whole = F.struct(F.concat(F.lit("synthetic://"), n).alias("source_document"), F.lit("1").alias("extraction_version"), scoring.fingerprint(F.lit("1"), text).alias("extraction_fingerprint"), text.alias("extracted_text"), F.array(label("a", "EMAIL", F.concat(F.lit("u"), n, F.lit("@x.org")), 6, 19), label("b", "FULL_NAME", F.lit("Asha"), 21, 25)).alias("entities"))
    return table(spark, sf_dir, "customer").select(F.to_json(whole).alias("value"))


@query("""
    WITH k AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS n FROM customer)
    SELECT 'synthetic://' || n AS source_document, 'EMAIL' AS pii_type, CAST(6 AS BIGINT) AS span_start, CAST(19 AS BIGINT) AS span_end, 'u' || n || '@x.org' AS value, 'truth:' || n || 'a' AS source, 20 AS priority FROM k
    UNION ALL SELECT 'synthetic://' || n, 'FULL_NAME', 21, 25, 'Asha', 'truth:' || n || 'b', 20 FROM k""")
def truth_scan(spark, sf_dir):
    """Corpus objects written as files of text, and read by the JSON source."""
    path = shared_path(spark, "corpora")
    corpus_objects(spark, sf_dir).write.text(path)
    d = C.parsed(spark.read.text(path), "value", C.CORPUS, "entities").select("_x.*").withColumnRenamed("extracted_text", "text")
    t = C.truth(d)
    return t.select("source_document", "pii_type", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), F.col("text").alias("value"), "source", "priority")


@query("SELECT 'micro' AS pii_type, count(*) AS tp, CAST(0 AS BIGINT) AS fp, count(*) AS fn, CAST(1.0 AS DOUBLE) AS precision_, CAST(0.5 AS DOUBLE) AS recall_ FROM customer")
def corpus_quality(spark, sf_dir):
    """Rules alone over the corpus objects: the mail addresses are found, the names are not."""
    d = cut(C.parsed(corpus_objects(spark, sf_dir), "value", C.CORPUS, "entities").select("_x.*").withColumnRenamed("extracted_text", "text"))
    scores, _, _ = quality.evaluate(d, CONFIG)
    return scores.where("pii_type is null").select(F.lit("micro").alias("pii_type"), "tp", "fp", "fn", F.col("precision").alias("precision_"), F.col("recall").alias("recall_"))


@query("""
    SELECT label, tp, fp, fn, unavailable FROM (SELECT unnest([{'label': 'rules-only', 'tp': 11, 'fp': 0, 'fn': 1, 'unavailable': false}, {'label': 'title-case', 'tp': 12, 'fp': 1, 'fn': 0, 'unavailable': false}, {'label': 'title-case+agreement', 'tp': 12, 'fp': 1, 'fn': 0, 'unavailable': false}, {'label': 'none-such', 'tp': NULL, 'fp': NULL, 'fn': NULL, 'unavailable': true}, {'label': 'none-such+agreement', 'tp': NULL, 'fp': NULL, 'fn': NULL, 'unavailable': true}], recursive := true))""")
def config_comparison(spark, sf_dir):
    """The sample corpus under several configurations; one names a model that is not there."""
    d = C.parsed(_object(spark, C.sample()), "value", C.CORPUS, "entities").select("_x.*").withColumnRenamed("extracted_text", "text")
    r = quality.compare(cut(d), CONFIG, ["title-case", "none-such"])
    return r.select("label", F.col("tp").cast("int").alias("tp"), F.col("fp").cast("int").alias("fp"), F.col("fn").cast("int").alias("fn"), F.col("error").isNotNull().alias("unavailable"))


def _object(spark, data: dict) -> DataFrame:
    import json

    return spark.range(1).select(F.lit(json.dumps(data)).alias("value"))


@query("""
    WITH t AS (SELECT unnest(['EMAIL', 'PHONE', 'ADDRESS', 'SSN', 'CREDIT_CARD', 'DOB', 'IP_ADDRESS']) AS pii_type)
    SELECT 'sample_rules' AS suite, pii_type, metric, CAST(0.98 AS DOUBLE) AS minimum FROM t, (VALUES ('precision'), ('recall')) m(metric)
    UNION ALL SELECT 'sample_rules', NULL, metric, least FROM (VALUES ('precision', 0.98), ('recall', 0.9), ('f1', 0.94)) m(metric, least)""")
def floor_scan(spark, sf_dir):
    d = C.parsed(_object(spark, C.floors()), "value", C.FLOORS, "suites").select(F.explode("_x.suites").alias("s")).select("s.*")
    return C.floor_rows(d).where("suite = 'sample_rules'").select("suite", "pii_type", "metric", "minimum")


@query("SELECT c_custkey AS doc_id, CAST(7 AS BIGINT) AS seed, CAST(1 AS BIGINT) AS entities, 'EMAIL' AS kinds FROM customer")
def run_reports(spark, sf_dir):
    """Reports parsed again: what undoes a rewriting is all there."""
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("mail u"), F.col("c_custkey").cast("string"), F.lit("@x.org")).alias("text"))
    r = reports.run_report(Engine(CONFIG).rewrite(d), "0.1.0", 7)
    x = F.from_json("report", "version string, seed long, entities array<struct<start:int,text:string,replacement:string>>, mapping map<string,string>, counts_by_type map<string,long>, text string")
    r = r.select("doc_id", x.alias("x"))
    return r.select("doc_id", "x.seed", F.size("x.entities").cast("long").alias("entities"), F.array_join(F.map_keys("x.counts_by_type"), ",").alias("kinds"))


# Streams


@query("""
    WITH k AS (SELECT ts, event_id % 4 AS t FROM events)
    SELECT CASE t WHEN 0 THEN 'EMAIL' ELSE 'IP_ADDRESS' END AS pii_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM k WHERE t < 2 GROUP BY ALL""")
def stream_counts(spark, sf_dir):
    """Events as a stream: values by type and hour of the event's time."""
    from veil.streaming import rewrite

    t = F.col("event_id") % 4
    said = F.when(t == 0, F.concat(F.lit("mail u"), F.col("event_id").cast("string"), F.lit("@x.org"))).when(t == 1, F.lit("host 10.1.2.3 up")).otherwise("nothing")
    stored = shared_path(spark, "events")
    table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), said.alias("text")).write.parquet(stored)
    stream = spark.readStream.schema("event_id long, ts timestamp, text string").parquet(stored)
    out, name = rewrite.type_counts(stream, Config(enabled_types=("EMAIL", "IP_ADDRESS"), as_of=AS_OF), window="1 hour", delay="3650 days"), f"counts_{abs(hash(stored)) % 10**9}"
    q = out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return cut(spark.table(name).select("pii_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n"))
