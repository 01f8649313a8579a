"""The driver contract and the oracle gate on the smallest data set."""

import datetime as dt
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from platewise.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["orders", "customer", "lineitem", "nation", "region"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "pct_error" in df.columns
    # a stable schema: the same columns and types on every call
    again = E.entry(spark)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == \
        [(f.name, f.dataType.simpleString()) for f in again.schema.fields]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_has_every_query():
    assert catalog.queries().items() <= E.queries().items() and catalog.oracle_sql().items() <= E.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle_matches(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    want = Counter(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert got == want
