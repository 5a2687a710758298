"""Manifest operators: length filters, shards, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def length_filter(df: DataFrame, source_len: Column, target_len: Column, min_source: int = 0, max_source: int = 2048, min_target: int = 0, max_target: int = 2048, max_total: int = 2200) -> DataFrame:
    """Rows whose lengths lie in their ranges, and whose sum stays below max_total."""
    return df.where(source_len.between(min_source, max_source) & target_len.between(min_target, max_target) & (source_len + target_len <= max_total))


def positions(df: DataFrame, order: list[Column | str], buckets_of: Column, name: str = "pos") -> DataFrame:
    """df with a dense position from 0 in the given order.

    buckets_of is a coarse column that rises with the order: rows are numbered within a bucket, and buckets are put
    end to end by their counts, so no task numbers all rows.
    """
    rows = df.withColumn("_bucket", buckets_of)
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each bucket
    first = counts.select("_bucket", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    own = rows.withColumn("_i", F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1)
    return own.join(first, "_bucket").withColumn(name, F.col("_first") + F.col("_i")).drop("_bucket", "_first", "_i")


def file_slice(pos: Column, total: Column, parts: int) -> Column:
    """Which of `parts` slices of ceil(total / parts) rows a position falls into."""
    return F.floor(pos / (F.floor((total - 1) / parts) + 1)).cast("int")


def batches_by_tokens(df: DataFrame, group: str, order: list[str], length: str, limit: int, max_length: int | None = None, max_rows: int = 1 << 30) -> DataFrame:
    """df with a batch number: a batch closes when rows * longest of them would pass limit, or rows would pass max_rows.

    The recurrence needs the rows of a group in order; groups are buffers of bounded size.
    """
    state = "struct<batch:int,rows:int,longest:long,out:array<struct<k:int,batch:int>>>"
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(length).cast("long").alias("_len"))))
    grouped = df.groupBy(group).agg(items.alias("_items"))

    def step(s: Column, x: Column) -> Column:
        longest = F.greatest(s["longest"], x["_len"])
        fits = (longest * (s["rows"] + 1) <= limit) & (s["rows"] < max_rows)
        batch = F.when(fits, s["batch"]).otherwise(s["batch"] + 1)
        entry = F.struct(F.size(s["out"]).alias("k"), batch.alias("batch"))
        return F.struct(batch.alias("batch"), F.when(fits, s["rows"] + 1).otherwise(1).alias("rows"), F.when(fits, longest).otherwise(x["_len"]).alias("longest"), F.concat(s["out"], F.array(entry)).alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("rows"), F.lit(0).cast("long").alias("longest"), F.array().cast("array<struct<k:int,batch:int>>").alias("out")).cast(state)
    kept = F.col("_items") if max_length is None else F.filter("_items", lambda x: x["_len"] <= max_length)
    done = grouped.select(group, kept.alias("_items")).select(group, "_items", F.aggregate("_items", start, step)["out"].alias("_out"))
    rows = done.select(group, F.explode(F.arrays_zip("_items", "_out")).alias("_r"))
    return rows.select(group, *[F.col(f"_r._items.{c}").alias(c) for c in order], F.col("_r._items._len").alias(length), F.col("_r._out.batch").alias("batch"))
