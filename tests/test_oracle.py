"""Every query of the core with SQL against DuckDB, at sf0.01."""

import os

import duckdb
import pytest

from murmurate import queries

from .conftest import ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ORACLE}/{t}.parquet'")
    return con


def plain(x):
    return x.item() if hasattr(x, "item") else x


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.skipif(not os.path.isdir(ORACLE), reason="no data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, ORACLE)
    found = [tuple(r) for r in df.collect()]
    if name not in queries.ORACLES:
        assert found
        return
    want = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, found) == rows(columns, want.fetchall())


def test_databases_are_listed_in_a_new_session(spark):
    """The listing must not depend on what an earlier query has registered."""
    spark.sql(f"DROP DATABASE IF EXISTS {queries.DATABASE} CASCADE")
    assert [r[0] for r in queries.list_databases(spark, ORACLE).collect()] == [queries.DATABASE]


@pytest.mark.parametrize("name", ["delegated_anti_join", "delegated_except"])
def test_something_is_left(spark, name):
    assert queries.QUERIES[name](spark, ORACLE).count() > 0
