"""Every registered query against its SQL oracle on the smallest driver tables."""

from __future__ import annotations

import collections
import datetime
import decimal
import math

import duckdb
import pytest

from botlake.plans import registry
from botlake.plans.inputs import TABLES

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def counted(rows):
    return collections.Counter(tuple(plain(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    theirs = duck.sql(ORACLES[name])
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    assert counted(df.select(*columns).collect()) == counted([r[i] for i in at] for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows or name in ("dt06_anniversaries",)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
