"""Every registered query with SQL against DuckDB on the same files."""

import math
import os

import duckdb
import pytest

from emberloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.5f}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, duck):
    found = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = sorted(d[0] for d in want.description)
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(found.columns) == columns
    a = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    b = sorted(tuple(plain(r[at[c]]) for c in columns) for r in want.fetchall())
    assert len(a) == len(b)
    assert a == b
