"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "error_rate" in df.columns


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 180
    assert all(callable(f) for f in queries.values())
