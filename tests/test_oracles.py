"""Every query with SQL gives the rows that DuckDB gives; the others run."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows) -> list[tuple]:
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return x if isinstance(x, (int, bool, type(None))) else str(x)

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    mine, theirs = plain(got.select(*names).collect()), plain(tuple(r[i] for i in at) for r in want.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.queries().keys() >= QUERIES.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
