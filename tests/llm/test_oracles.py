"""Every corpus query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from murmurate.llm import queries

from ..conftest import SMALL


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SMALL)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    columns = sorted(names)
    assert sorted(found.columns) == columns
    have = sorted(map(repr, map(tuple, found.select(*columns).collect())))
    assert have == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in want.fetchall())
