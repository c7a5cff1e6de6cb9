"""Queries with SQL give the rows that DuckDB gives."""

import pytest
from tests.test_catalogue import db, plain  # noqa: F401

from veil.llm import entries


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_same_rows_as_duckdb(spark, db, sf_dir, name):  # noqa: F811
    df = entries.queries()[name](spark, sf_dir)
    found = db.execute(entries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.columns, map(tuple, df.collect())) == plain(names, found.fetchall())
