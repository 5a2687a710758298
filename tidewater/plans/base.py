"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, longs: tuple[str, ...] = ()) -> Callable[[Callable], Query]:
    """Register a function of one `Tables` under its name, with SQL that gives the same rows; `longs` are sums that the SQL side widens."""
    if sql and longs:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in longs)}) FROM ({sql}) AS q"

    def register(f: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(ship(spark), sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return run

    return register


class Tables:
    """The tables of a folder, read when named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
