"""Queries of the subpackage that SQL can state by brute force, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from embedflow.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are missing")


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(dict(zip(want.columns, r))[c] for c in columns) for r in want.fetchall())
