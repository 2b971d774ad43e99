"""Every query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

import callgrain.plans.stream_queries  # noqa: F401
from callgrain.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, con, sf):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(norm, r)) for r in df.select(*columns).collect())
    got = con.sql(ORACLES[name])
    at = [list(got.columns).index(c) for c in columns]
    assert len(got.columns) == len(columns)
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in got.fetchall())
    assert rows or name in ("ref_archive_search_ext", "ref_archive_search")


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
