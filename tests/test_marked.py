"""A rule's pattern is read over a text once, by an expression that compiles it once."""

import re

import pytest
from pyspark.sql import functions as F

from veil.functions.text import BEHIND, MARK, OTHER, spans
from veil.plans import catalogue

MARKED = ["detect_all", "counts_by_type", "rule_values"]


@pytest.mark.parametrize("name", MARKED)
def test_no_text_is_split_by_a_rule(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(_copy" in plan and not re.search(r"(split|regexp_extract_all)\(_text", plan)


@pytest.mark.parametrize(("pattern", "group"), [(r"(?<!x)a+b?", 0), (r"a+(b?)", 1), (r"[^b]{2}", 0), (r"(?:\G|b)a", 0), (r"[^a]\w?(.)", 1)])
def test_marks_find_what_a_split_finds(spark, pattern, group):
    texts = ["", "b", "aab xab ab", "baab", "$0a\\1b", f"a{MARK}ab{BEHIND}{OTHER}a", MARK * 3, f"ab{BEHIND}", "\U0001f600ab é aa", "a\nb\n\na"]
    d = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = d.select(spans(F.col("t"), pattern, group).alias("a"), spans(F.col("t"), F.lit(pattern), group).alias("b")).collect()
    assert [x.a for x in got] == [x.b for x in got] and any(x.a for x in got)
