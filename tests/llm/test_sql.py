"""The queries with SQL against DuckDB on sf0.01."""

import math

import duckdb
import pytest

from emberloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    a = sorted(str(tuple(plain(r[c]) for c in names)) for r in found.collect())
    assert a == sorted(str(r) for r in want.fetchall())
