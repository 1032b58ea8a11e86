"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from cardloom.plans import corpus, decisions, fulltext, graph, layout, state, taxonomy, usage, workflow

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = {n: (m, q) for m in (graph, taxonomy, corpus, usage, workflow, layout, decisions, state, fulltext) for n, q in m.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(n for n, (m, _) in PLANS.items() if n in m.SQL))
def test_query_matches_sql(spark, duck, name):
    module, query = PLANS[name]
    got, want = query(spark, SF), duck.execute(module.SQL[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    order = [[c[0] for c in want.description].index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(n for n, (m, _) in PLANS.items() if n not in m.SQL))
def test_query_without_sql_runs(spark, name):
    if name != "force_layout":
        assert PLANS[name][1](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
