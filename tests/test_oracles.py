"""Every query with SQL gives DuckDB's rows on the smallest tables; every other one gives rows."""

import math
import os

import duckdb
import pytest

from tessera import registry
from tessera.plans import load

load()
FOLDER = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    assert rows or name in registry.SQL
    if name in registry.SQL:
        own = duck.sql(registry.SQL[name])
        assert sorted(own.columns) == columns
        at = [own.columns.index(c) for c in columns]
        assert rows == sorted((tuple(norm(r[i]) for i in at) for r in own.fetchall()), key=repr)
