"""Every query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from affinity import queries
from tests.conftest import SMALL, TABLES


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SMALL)
    want = db.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
