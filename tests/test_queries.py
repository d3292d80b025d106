"""Each query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(columns)
    near = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return order, sorted((tuple(near(r[columns.index(c)]) for c in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    found = duck.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in found.description], found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_searches_need_no_full_sort(spark, small):
    plan = QUERIES["vector_topk"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_overlaps_have_a_key(spark, small):
    for name in ("chunk_page_range", "chunk_sections"):
        assert "NestedLoop" not in QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
