"""Every query of the engine that has SQL against DuckDB on the smallest tables."""

import os

import pytest

from quillon.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=str)
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == names
        at = [rel.columns.index(c) for c in names]
        want = sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=str)
        assert got == want
    else:
        assert got


def test_entry_without_llm(spark, monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as e

    assert set(e.queries()) == set(QUERIES) and e.entry(spark).count() > 0
