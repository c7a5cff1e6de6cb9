"""Texts made from a small table's keys are dealt over tasks, as a small file is read by one."""

import random

import pytest
from pyspark.sql import functions as F

from veil.functions import context
from veil.functions.lexicon import BIRTH_CUES, NEGATIVE_CONTEXT
from veil.functions.text import strings
from veil.plans import catalogue

DEALT = ["many_firms", "resolve_all", "rule_values", "counts_by_type", "detect_all"]


@pytest.mark.parametrize("name", DEALT)
def test_made_texts_are_dealt(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_reference_is_told_as_by_the_labels_one_by_one(spark):
    r = random.Random(5)
    parts = [*NEGATIVE_CONTEXT, *BIRTH_CUES, " ", " ", ": ", "#", "x", "é", "\n", ".", "-", "Ref", "NO. "]
    texts = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 4))) for _ in range(3000)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    end = F.length("t")
    one_by_one = F.coalesce(F.array_contains(strings(NEGATIVE_CONTEXT), context.preceding_label(F.col("t"), end)), F.lit(False))
    got = d.select(context.is_reference(F.col("t"), end).alias("a"), one_by_one.alias("b")).groupBy("a", "b").count().collect()
    assert {(x.a, x.b) for x in got} == {(True, True), (False, False)}
