"""Registered queries against their DuckDB oracle on the sf0.001 tables.

All of them run, as in the check the driver performs at sf0.01."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from verdant.sources.tables import RAW_TABLES

from conftest import SF_SMALL

NAMES = sorted(E.oracle_sql())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs),
                  key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_every_query_has_a_builder_and_entry_runs(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    out = E.entry(spark)
    assert out.count() > 0
