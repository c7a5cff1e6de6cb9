"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from veil.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_duckdb(spark, db, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    found = db.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.columns, map(tuple, df.collect())) == plain(names, found.fetchall())
