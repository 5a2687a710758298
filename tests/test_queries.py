"""Every query with SQL gives the rows that DuckDB gives; every other runs and keeps its schema."""

from __future__ import annotations

import datetime
import math
import random

import duckdb
import pytest

from tidewater.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def flat(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(flat, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted("|".join(map(flat, r)) for r in df.select(*columns).collect())
    ran = duck.execute(ORACLE[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    want = sorted("|".join(flat(r[names.index(c)]) for c in columns) for r in ran.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_paired_lines_keep_short_lines(spark, tmp_path):
    """Every line of the first list gives a record: short ones, mismatches, and ones that have no partner."""
    item = [0, 1, 3, 5, 6, 8, 9]
    n_chars = {0: 24, 1: 25, 3: 10, 5: 3, 6: 134, 8: None}
    con = duckdb.connect()
    spark.createDataFrame([(i,) for i in item], "item_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(n_chars.items()), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["sup_paired_lines"](spark, str(tmp_path)).select("pos", "state", "frames").collect()))
    assert got == sorted(con.execute(f"SELECT pos, state, frames FROM ({ORACLE['sup_paired_lines']})").fetchall())
    assert got == [(0, "ok", 0), (1, "ok", 1), (3, "id mismatch", None), (5, "ok", -2), (6, "ok", 11), (8, "ok", None), (9, "missing", None)]


def test_leaderboard_adds_in_row_order(spark, tmp_path):
    """Means that lie halfway between two millionths are rounded as by the SQL on one thread, however the table is cut; no system is left out."""
    rng, con = random.Random(5), duckdb.connect(config={"threads": 1})
    rows = [(u, rng.randrange(10000) / 100) for _ in range(64) for u in range(400)]
    rows += [(400, float("nan")), (400, 1.0), (401, None), (None, 12.5), (None, 13.0), (402, None), (403, -2.25), (403, None)]
    spark.createDataFrame(rows, "user_id long, value double").coalesce(1).write.option("maxRecordsPerFile", 3000).parquet(f"{tmp_path}/events.parquet")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    flat_rows = lambda x: sorted("|".join(map(flat, r)) for r in x)
    want = flat_rows(con.execute(f"SELECT user_id, n, score, place FROM ({ORACLE['sup_leaderboard_by_mean']})").fetchall())
    for size in (128 << 20, 20000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            got = QUERIES["sup_leaderboard_by_mean"](spark, str(tmp_path)).select("user_id", "n", "score", "place").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert flat_rows(got) == want and len(got) == 405
