"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomgraph.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(D):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{D}/{t}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
