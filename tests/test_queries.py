"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from argusframe.plans import files  # noqa: F401
from argusframe.plans.oracle import ORACLE_SQL
from argusframe.plans.queries import QUERIES, _walk

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def rows(cells):
    return sorted(tuple(repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) else str(v) for v in r) for r in cells)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    mine = QUERIES[name](spark, sf)
    cols = sorted(mine.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    got = rows(mine.select(*cols).collect())
    assert got == rows(want.select(*[f'"{c}"' for c in cols]).fetchall()) and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_every_vector_walks(spark, sf, duck):
    want = {f"s{i:08d}" for (i,) in duck.sql("select distinct vec_id // 3 from embeddings").fetchall()}
    got = {r.seq for r in _walk(spark, sf).select("seq").distinct().collect()}
    assert len(want) > 20 and got == want
