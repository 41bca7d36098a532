"""Every query that has SQL against DuckDB on the smallest tables, and the others for a stable schema."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)[:19].replace(" 00:00:00", "") if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted(tuple(plain(r[n]) for n in names) for r in got.collect())
    want = duck.sql(catalogue.ORACLES[name])
    at = [want.columns.index(n) for n in names]
    assert sorted(want.columns) == names
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs_without_sql(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    assert got.columns and got.count() >= 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
