"""Labelled corpora, rates, floors and reports."""

import json

import pytest
from pyspark.sql import functions as F

from veil.operators import audit, scoring
from veil.operators.model import TITLE_CASE
from veil.operators.rules import Config
from veil.plans import quality
from veil.sources import corpora as C
from veil.sources import reports
from veil.store import cut

CONFIG = Config(as_of="2024-06-30")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpora")
    C.write(str(path))
    return path


@pytest.fixture(scope="module")
def corpora(spark, folder):
    return cut(C.read_corpora(spark, f"file://{folder}/sample.json").unionByName(C.read_corpora(spark, f"file://{folder}/pages.json")))


def of(corpora, name):
    return corpora.where(F.col("source_document") == f"synthetic://{name}")


def test_labels(corpora):
    n = {r[0]: r[1] for r in corpora.select("source_document", F.size("entities")).collect()}
    assert n == {"synthetic://sample": 12, "synthetic://pages": 49}
    kinds = {r[0]: r[1] for r in C.truth(of(corpora, "pages")).groupBy("pii_type").count().collect()}
    assert kinds == {"FULL_NAME": 16, "COMPANY": 10, "EMAIL": 9, "PHONE": 7, "ADDRESS": 6, "DOMAIN": 1}


def test_rules_alone_over_the_sample(corpora):
    scores, accuracy, errors = quality.evaluate(of(corpora, "sample"), CONFIG)
    total = scores.where("pii_type is null").first()
    assert (total["tp"], total["fp"], total["fn"]) == (11, 0, 1) and total["precision"] == 1.0 and round(total["recall"], 3) == 0.917
    assert accuracy.first()["accuracy"] > 0.97 and [r["pii_type"] for r in errors.collect()] == ["FULL_NAME"]
    text = reports.evaluation_markdown(scores, scoring.macro(scores), accuracy, errors, "sample")
    assert "| micro | 1.000 | 0.917 | 0.957 | 11 | 0 | 1 |" in text and "| DOMAIN" not in text and "- fn FULL_NAME" in text
    assert json.loads(reports.evaluation_json(scores, accuracy, "1", 0, None))["relaxed"]["micro"]["tp"] == 11


def test_floors_hold(spark, corpora, folder):
    floors = C.read_floors(spark, f"file://{folder}/floors.json")
    assert floors.count() == 3 + 14 + 3 + 12
    assert quality.held(corpora, floors, CONFIG, [("sample_rules", "sample", None), ("pages_model", "pages", TITLE_CASE)]).collect() == []
    missed = quality.held(corpora, floors, CONFIG, [("pages_model", "pages", None)]).collect()
    assert {(r["pii_type"], r["metric"]) for r in missed} == {(None, "recall"), (None, "f1"), ("FULL_NAME", "recall")}


def test_changed_corpora_and_objects_without_labels_raise(spark, corpora):
    with pytest.raises(ValueError, match="fingerprint"):
        quality.evaluate(of(corpora, "sample").withColumn("extraction_version", F.lit("2")), CONFIG)
    with pytest.raises(Exception, match="no entities"):
        C.parsed(spark.createDataFrame([('{"source_document": "x"}',)], "value string"), "value", C.CORPUS, "entities").collect()


def test_matching_takes_the_largest_overlap_and_equal_types_first(spark):
    span = "doc_id long, start int, end int, pii_type string"
    make = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], span)

    def out(truth, predicted, exact=False):
        return sorted(r["outcome"] for r in scoring.match(make(*truth), make(*predicted), exact).collect())

    assert out([(0, 10, "EMAIL")], [(0, 4, "EMAIL"), (2, 10, "EMAIL")]) == ["fp", "tp"]
    assert out([(0, 10, "EMAIL")], [(0, 10, "PHONE"), (0, 10, "EMAIL")]) == ["fp", "tp"]
    assert out([(0, 10, "EMAIL")], [(0, 10, "PHONE")]) == ["type_confusion"]
    assert out([(0, 10, "EMAIL")], [(10, 20, "EMAIL")]) == ["fn", "fp"]
    assert out([(0, 10, "EMAIL")], [(0, 9, "EMAIL")], exact=True) == ["fn", "fp"]


def test_an_audit_report(spark):
    pairs = spark.createDataFrame([(1, "mail jane.roe@x.org", "mail al@y.net"), (2, "host 10.1.2.3", "host 10.1.2.3")], "doc_id long, text string, rewritten string")
    parts = spark.createDataFrame([(1, "docProps/core.xml", "<dc:creator></dc:creator>")], "doc_id long, part_name string, text string")
    said, code = reports.audit_text(audit.category_score(pairs, CONFIG), audit.over_rewriting(pairs), audit.totals(pairs, CONFIG, parts=parts))
    assert code == 1 and "Email addresses           1 of      1 removed (100.0 %)" in said and "not clean" in said
    said, code = reports.audit_text(audit.category_score(pairs.where("doc_id = 1"), CONFIG), audit.over_rewriting(pairs), audit.totals(pairs.where("doc_id = 1"), CONFIG, parts=parts))
    assert code == 0


def test_a_model_below_the_threshold_gives_nothing_and_chunks_keep_offsets(spark):
    from veil.operators import model

    text = "x" * 30 + "\n" + "Then Asha Menon came\n" * 3
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert model.raw_spans(d, TITLE_CASE, threshold=1.5).collect() == []
    found = model.raw_spans(d, TITLE_CASE, most=25).collect()
    assert len(found) == 3 and all(text[r["start"] : r["end"]] == "Then Asha Menon" for r in found)
    with pytest.raises(model.ModelUnavailable):
        model.raw_spans(d, "none_such")
