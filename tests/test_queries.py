"""Every query beside its SQL in DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import lorekeep.catalogue_queries  # noqa: F401
from lorekeep.queries import ORACLES, QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in data], key=repr)


KIND = {"bigint": "int", "int": "int", "smallint": "int", "hugeint": "int", "integer": "int", "double": "float", "varchar": "str", "string": "str", "boolean": "bool", "timestamp": "ts", "timestamp_ntz": "ts"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    rel = duck.execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    kinds = {c[0]: KIND.get(str(c[1]).lower(), str(c[1]).lower()) for c in rel.description}
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert {c: KIND.get(t, t) for c, t in df.dtypes} == kinds or os.environ.get("LOOSE")
    a, b = rows(df.columns, got), rows(columns, want)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
