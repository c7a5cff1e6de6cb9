"""Detection, span algebra and rewriting on small texts with known answers."""

import pytest
from pyspark.sql import functions as F

from veil.operators import audit, mapping, spans
from veil.operators.rules import REGISTRY, RULES, Config, Registry, explode_entities
from veil.plans.engine import Engine

CONFIG = Config(as_of="2024-06-30")


def entities(spark, *texts, config=CONFIG):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = explode_entities(Engine(config).detect(docs), "doc_id").orderBy("doc_id", "start").collect()
    return [(r["doc_id"], r["pii_type"], r["text"]) for r in rows]


def test_each_rule_finds_its_kind(spark):
    found = entities(
        spark,
        "Write to jane.roe@mail.example.org. Thanks",
        "SSN 123-45-6789",
        "card 4111 1111 1111 1111",
        "host 10.1.2.3 is up",
        "born 12/03/1980 in Pune",
        "Contact Person: Ravi Kumar\nTelephone",
        "with Blue Harbour Private Limited in",
        "see www.example.com now",
        "call +91 98765 43210 now",
    )
    assert [(d, k) for d, k, _ in found] == [(0, "EMAIL"), (1, "SSN"), (2, "CREDIT_CARD"), (3, "IP_ADDRESS"), (4, "DOB"), (5, "FULL_NAME"), (6, "COMPANY"), (7, "DOMAIN"), (8, "PHONE")]
    assert found[0][2] == "jane.roe@mail.example.org" and found[5][2] == "Ravi Kumar"


def test_labelled_references_and_bad_values_are_left_alone(spark):
    assert entities(spark, "Invoice No. 123-45-6789", "version 1.2.3.4", "12/03/1980", "our Company Limited", None, "") == []
    # nine digits are a telephone number where they are no SSN
    assert entities(spark, "000-12-3456") == [(0, "PHONE", "000-12-3456")]


def test_the_flag_lets_references_through(spark):
    assert entities(spark, "Invoice No. 123-45-6789", config=Config(enabled_types=("SSN",), let_reference_numbers_through=True)) == [(0, "SSN", "123-45-6789")]


def test_disabled_types_have_no_spans_and_unknown_types_fail(spark):
    assert entities(spark, "a@b.org 10.1.2.3", config=Config(enabled_types=("EMAIL",))) == [(0, "EMAIL", "a@b.org")]
    with pytest.raises(ValueError):
        Config(enabled_types=("NONE",))


def test_a_rule_registers_once():
    assert len(REGISTRY.rules) == len(RULES)
    with pytest.raises(ValueError):
        Registry([RULES[0], RULES[0]])


def test_rewriting_is_consistent_and_leaves_no_value(spark):
    docs = spark.createDataFrame([(1, "jane.roe@example.org wrote; jane.roe@example.org paid 4111 1111 1111 1111"), (2, None), (3, "nothing here")], "doc_id long, text string")
    engine = Engine(CONFIG)
    d = engine.rewrite(docs)
    rows = {r["doc_id"]: r for r in d.select("doc_id", "rewritten", "assigned").collect()}
    fakes = [e["replacement"] for e in rows[1]["assigned"] if e["pii_type"] == "EMAIL"]
    assert len(fakes) == 2 and len(set(fakes)) == 1
    assert "jane.roe" not in rows[1]["rewritten"] and "4111 1111" not in rows[1]["rewritten"]
    assert rows[2]["rewritten"] is None and rows[3]["rewritten"] == "nothing here"
    engine.verify(d)


def test_blocks_and_offsets(spark):
    docs = spark.createDataFrame([(1, "ab\n\ncde")], "doc_id long, text string")
    blocks = spans.blocks_of(docs)
    assert [tuple(r)[1:] for r in blocks.orderBy("block").collect()] == [(0, 0, 2, "ab"), (1, 3, 3, ""), (2, 4, 7, "cde")]
    asked = spark.createDataFrame([(1, 0), (1, 5)], "doc_id long, offset int")
    assert [r["block"] for r in spans.offset_to_block(asked, blocks).orderBy("offset").collect()] == [0, 2]


def test_churn_counts_changed_lines(spark):
    pairs = spark.createDataFrame([(1, "a\nb", "a\nc"), (2, "a", "a\nb")], "doc_id long, text string, rewritten string")
    assert [tuple(r) for r in audit.churn(pairs).orderBy("doc_id").collect()] == [(1, 2, 1), (2, 1, None)]


def test_resolved_spans_never_overlap(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = Engine(CONFIG).detect(docs).select("doc_id", "text", "entities")
    assert spans.violations(explode_entities(d, "doc_id"), docs).count() == 0
    assert d.where(F.size("entities") > 0).count() > 0


def test_ranks_run_from_one_in_each_type(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3, "A").otherwise("B").alias("pii_type"), F.col("id").cast("string").alias("key"))
    got = mapping.ranked(rows, "key", 7)
    assert got.columns == ["pii_type", "key", "rank"]
    for kind, n in (("A", 3), ("B", 4997)):
        assert sorted(r["rank"] for r in got.where(F.col("pii_type") == kind).collect()) == list(range(1, n + 1))


def test_probe_values_name_their_probe(spark):
    from veil.operators import audit

    d = spark.createDataFrame([(1, "write to a.b@example.com or Attn: Jane Doe"), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in audit.probe_values(d).collect()} == {(1, "email", "a.b@example.com"), (1, "labelled_person", "Jane Doe")}
