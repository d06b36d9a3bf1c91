import math
import os
from decimal import Decimal

import pytest

from krigmesh import queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 4)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    df, sql = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    want = sorted((tuple(plain(dict(zip(sql.columns, r))[c]) for c in cols) for r in sql.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
