"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows are ranked in a seeded shuffle within their source; a row's fractional rank is (rank + 1/2) / rows of
its source. Sorting all rows by it interleaves the sources in proportion, so that each of the equal cuts
of that order is a shard with the mixture of the whole. The law is `rows`: shard sizes differ by one at most.

Neither the ranks nor the order is made in one task. Rows fall into 4,096 buckets of their shuffle hash, and
again into 4,096 buckets of fractional rank; counts by bucket give each bucket's first rank, and windows
number the rows of one bucket only. A source with a third of all rows is thus spread over all its buckets.

Cases: a null text has no bytes (size 1, crc 0); null sources form a stratum of their own; null ids are kept, and
rows that agree in id, source and text are numbered in any order among themselves; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import prepare, stage

BUCKETS = 4096


def _first_ranks(rows: DataFrame, within: list[str], bucket: str) -> DataFrame:
    """For each bucket (within the given columns): rows in the buckets before it."""
    counts = rows.groupBy(*within, bucket).agg(F.count(F.lit(1)).alias("_n"))
    # for `within` empty, this window has one row for each of at most BUCKETS buckets
    w = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    before = F.sum("_n").over(w.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    return counts.select(*within, bucket, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("_all"))


def _numbered(rows: DataFrame, within: list[str], bucket: str, order: list[Column], rank: str, total: str) -> DataFrame:
    """rows with a rank from 0 (and the total) within the given columns, in the order of bucket, then order."""
    keys = [*within, bucket]
    first = _first_ranks(rows, within, bucket)
    own = rows.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return own.join(first, keys).withColumn(rank, F.col("_before") + F.col("_i") - 1).withColumn(total, F.col("_all")).drop("_i", "_before", "_all")


def interleaved_shards(docs: DataFrame, shards: int = 8, seed: int = 7, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    prepare(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(id_column).alias("_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("_source"),
        (F.octet_length(body) + F.lit(1).cast("long")).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )
    narrow = narrow.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text_crc32").cast("string"))))
    narrow = stage(narrow.withColumn("_b", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int")), "shard-rows")
    ranked = _numbered(narrow, ["_source"], "_b", [F.col("_key"), F.col("_id")], "_rank", "_n")
    # an exact fraction: (2 rank + 1) / 2n, compared through its 4,096th part and then its remainder
    part = F.expr(f"((2 * _rank + 1) * {BUCKETS}) div (2 * _n)").cast("int")
    ranked = ranked.withColumn("_f", (F.col("_rank") + 0.5) / F.col("_n")).withColumn("_fb", part)
    ranked = stage(ranked.select("_id", "_source", "size", "text_crc32", "_key", "_f", "_fb"), "shard-ranks")
    placed = _numbered(ranked, [], "_fb", [F.col("_f"), F.col("_source"), F.col("_key"), F.col("_id")], "_pos", "_total")
    shard = F.expr(f"(_pos * {shards}) div _total")
    # the first position of shard s is ceil(s * total / shards)
    start = F.expr(f"((({shards} * _pos) div _total) * _total + {shards - 1}) div {shards}")
    return placed.select(
        F.col("_id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("_pos") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
