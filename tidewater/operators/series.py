"""Frame series, islands and intervals as windows and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], pos: str, mark: Column, aggregates: list[Column]) -> DataFrame:
    """Maximal runs of rows where mark holds: first, last (exclusive), length, and the aggregates."""
    w = W.partitionBy(*keys).orderBy(pos)
    rows = df.withColumn("_m", mark)
    start = F.col("_m") & ~F.coalesce(F.lag("_m").over(w), F.lit(False))
    rows = rows.withColumn("_run", F.sum(start.cast("int")).over(w)).where("_m")
    return rows.groupBy(*keys, "_run").agg(F.min(pos).alias("first"), (F.max(pos) + 1).alias("last"), F.count(F.lit(1)).alias("length"), *aggregates).drop("_run")


def merge_near(df: DataFrame, keys: list[str], first: str, last: str, gap: int) -> DataFrame:
    """Intervals whose distance to the one before is below gap become one; the last end counts."""
    w = W.partitionBy(*keys).orderBy(first)
    rows = df.withColumn("_new", F.coalesce((F.col(first) - F.lag(last).over(w) >= gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("_g", F.sum("_new").over(w))
    return rows.groupBy(*keys, "_g").agg(F.min(first).alias(first), F.max_by(last, first).alias(last), F.count(F.lit(1)).alias("parts")).drop("_g")


def walked_speaker(begin: Column, end: Column, turns: Column) -> Column:
    """The speaker of a span by a walk over turns (spk, a, b) in order; 0 without any overlap.

    A turn that overlaps more than the record takes the span; each overlapping turn of the holder adds to the record.
    """
    state = "struct<spk:long,record:long>"

    def step(s: Column, x: Column) -> Column:
        over = F.greatest(F.least(end, x["b"]) - F.greatest(begin, x["a"]), F.lit(0))
        taken = over > s["record"]
        spk = F.when(taken, x["spk"]).otherwise(s["spk"])
        return F.struct(spk.alias("spk"), (F.greatest(s["record"], over) + F.when((over > 0) & (spk == x["spk"]), over).otherwise(0)).alias("record")).cast(state)

    return F.aggregate(turns, F.struct(F.lit(0).alias("spk"), F.lit(0).alias("record")).cast(state), step)["spk"]


def merge_segments(bounds: Column, max_length: int, min_length: int) -> Column:
    """Speech segments merged up to max_length: cut points are all starts and ends, beginning at 0."""
    kind = "struct<begin:long,out:array<struct<begin:long,end:long>>>"
    points = F.array_sort(F.array_distinct(F.concat(F.transform(bounds, lambda x: x["begin"]), F.transform(bounds, lambda x: x["end"]))))
    pairs = lambda p: F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("at"), b.alias("next")))

    def step(s: Column, x: Column) -> Column:
        cut = x["next"] - s["begin"] >= max_length
        add = cut & (x["at"] - s["begin"] > min_length)
        out = F.when(add, F.concat(s["out"], F.array(F.struct(s["begin"].alias("begin"), x["at"].alias("end"))))).otherwise(s["out"])
        return F.struct(F.when(cut, x["at"]).otherwise(s["begin"]).alias("begin"), out.alias("out")).cast(kind)

    start = F.struct(F.lit(0).cast("long").alias("begin"), F.array().cast("array<struct<begin:long,end:long>>").alias("out")).cast(kind)
    done = F.aggregate(pairs(points), start, step, lambda s: F.concat(s["out"], F.array(F.struct(s["begin"].alias("begin"), F.element_at(points, -1).alias("end")))))
    return F.when(F.size(bounds) <= 1, bounds).otherwise(done)


def best_overlap(queries: DataFrame, spans: DataFrame, cell: int, keys: list[str]) -> DataFrame:
    """For each query interval (id, begin, end) the span (span, span_begin, span_end) of its keys that it overlaps most.

    Both sides are cut into time cells, so the join is on equal keys and cells; the exact overlap follows.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / cell)))
    q = queries.withColumn("_cell", cells("begin", "end"))
    s = spans.withColumn("_cell", cells("span_begin", "span_end"))
    both = q.join(s, [*keys, "_cell"]).withColumn("overlap", F.least("end", "span_end") - F.greatest("begin", "span_begin")).where("overlap > 0")
    # a pair meets in every cell they share; it is one candidate
    best = both.groupBy("id").agg(F.max(F.struct("overlap", (-F.col("span")).alias("_neg"))).alias("_b"))
    return best.select("id", (-F.col("_b._neg")).alias("span"), F.col("_b.overlap").alias("overlap"))
