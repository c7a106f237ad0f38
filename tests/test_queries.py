"""Every query with a SQL counterpart against DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from embedflow.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


def bag(rows, columns):
    return sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert bag([r.asDict() for r in df.collect()], df.columns) == bag(rows, want.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "j", "v"] and e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship_stays_in_the_jvm(spark):
    from embedflow.plans.token_queries import hashed_components, texts

    plan = hashed_components(texts(spark, str(DATA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_embedding_query(spark):
    df = catalog.QUERIES["embed_documents"](spark, str(DATA))
    assert df.where("size(embedding) = 64").count() == spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL").count()
