"""Ordered choices: best of a group, margins, running curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def winners(df: DataFrame, keys: list[str], order: list[Column], name: str, score: str) -> DataFrame:
    """The best row of each group, with its margin to the second (null if alone)."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    first = lambda c: F.max(F.when(F.col("_r") == 1, F.col(c)))
    second = F.max(F.when(F.col("_r") == 2, F.col(score)))
    return rows.groupBy(*keys).agg(first(name).alias("winner"), first(score).alias("best"), second.alias("second")).withColumn("margin", F.col("second") - F.col("best"))


def binned_counts(df: DataFrame, score: Column, target: Column) -> DataFrame:
    """Distinct scores with how many targets and others have them: what error curves depend on."""
    return df.groupBy(score.alias("score")).agg(F.count_if(target).alias("pos"), F.count_if(~target).alias("neg"))


def running_totals(df: DataFrame, order: str, bucket: Column, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """df with, for each column, its running total in the order and its grand total, under the two names given.

    bucket rises with the order; rows are added up within buckets, and buckets, which are few, among themselves.
    """
    rows = df.withColumn("_bucket", bucket)
    sums = rows.groupBy("_bucket").agg(*[F.sum(c).alias(c) for c in columns])
    before, every = W.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    first = sums.select("_bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in columns], *[F.sum(c).over(every).alias(total) for c, (_, total) in columns.items()])
    up = W.partitionBy("_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(first, "_bucket")
    return out.select(*df.columns, *[(F.col(f"_{c}") + F.sum(c).over(up)).alias(run) for c, (run, _) in columns.items()], *[total for _, total in columns.values()])
