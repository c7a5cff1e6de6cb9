"""The corpus map has a fake for every key of every type, or raises."""

import pytest

from veil.operators import mapping
from veil.plans import catalogue_values as values


def test_every_key_of_every_type_has_its_own_fake(spark, sf_dir):
    entities = values.corpus_entities(spark, sf_dir)
    m = mapping.corpus_mapping(entities, values.CONFIG, values.candidate_pool(spark, 500)).collect()
    assert {r["pii_type"] for r in m} == {r[0] for r in entities.select("pii_type").distinct().collect()} and len({r["pii_type"] for r in m}) == 10
    assert all(r["fake"] for r in m) and len({(r["pii_type"], r["fake"]) for r in m}) == len(m)


def test_a_pool_that_ends_raises(spark, sf_dir):
    entities = values.corpus_entities(spark, sf_dir)
    with pytest.raises(Exception, match="no free surrogate"):
        mapping.corpus_mapping(entities, values.CONFIG, values.candidate_pool(spark, 3)).collect()


def test_the_pool_repeats_nothing(spark):
    pool = values.candidate_pool(spark, 2000)
    assert pool.count() == pool.distinct().count()


def test_ranks_are_dense_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mapping, "RANGE_KEYS", 7)
    d = spark.range(500).selectExpr("concat('t', id % 3) as pii_type", "cast(id as string) as key")
    got = mapping.ranked(d, "key", 5).collect()
    for t in ("t0", "t1", "t2"):
        ranks = sorted(r["rank"] for r in got if r["pii_type"] == t)
        assert ranks == list(range(1, len(ranks) + 1))
