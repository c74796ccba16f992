"""Every query runs, and those with SQL give the same rows as DuckDB."""

import importlib
from pathlib import Path

import pytest

import __spark_entry__ as entry
import compare

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test data here")


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def core_queries():
    return {k: q for m in map(importlib.import_module, entry.CORE) for k, q in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, name, monkeypatch):
    import duckdb

    df = core_queries()[name](spark, str(SF))
    rows = sorted(repr(tuple(compare.plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        db = duckdb.connect()
        for p in SF.glob("*.parquet"):
            db.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
        got = db.sql(sql)
        order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
        assert sorted(df.columns) == sorted(got.columns)
        assert rows == sorted(repr(tuple(compare.plain(r[i]) for i in order)) for r in got.fetchall())
