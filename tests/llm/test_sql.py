"""The operators that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from callgrain.llm.entry import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(name, sf, spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.sql(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    df = queries()[name](spark, f"/root/testdata/{sf}")
    columns = sorted(df.columns)
    want = con.sql(oracle_sql()[name])
    at = [list(want.columns).index(c) for c in columns]
    assert len(at) == len(want.columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
