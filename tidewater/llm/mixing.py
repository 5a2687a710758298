"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Sources, by code point with null last, weigh 5, 2, 1, repeating. They share `share` times all words by weight; no
target passes `most` times its source's words, the excess being reshared by weight until none does
(water filling: each target is the least of its limit and level * weight).

The rates r of a source's documents are those nearest to 1 in entropy (the sum of r ln r - r) that meet the token
constraint sum(r * size) = target with r <= most. The dual has one multiplier for each source, and
r = min(most, exp(m * size / mean size)). Newton steps solve it, kept inside a bracket; all
sources step at once, each step one aggregation of the histogram (source, size, documents), which is all the
dual depends on. Documents of equal source and size have equal rates. Rounding walks a source's documents from the
largest size, then by a hash of the id: extra copies are the steps of the running sum of the rates' fractions, so the words
taken differ from the target by less than the largest document's size, and mostly far less. Ranks come from counts by bucket.

Nothing is random: reruns agree. The histogram has as many rows for a source as it has distinct sizes; a hot source,
or a hot size within it, is counted before the shuffle and numbered in 256 buckets of the hash.

Cases: null text has size 0 and takes 0; null ids and sources are kept, null is one source, last in order; a source
without words has target 0; repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import carried, discard, prepare, restored, stage, words

WEIGHTS = (5, 2, 1)
#: Steps after which the solver gives up with an error; brackets halve, so far fewer are needed.
MAX_STEPS = 200
TOLERANCE = 1e-9


def source_targets(hist: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """_source, source_size and target; hist has _source, size and _n."""
    sizes = hist.groupBy("_source").agg(F.sum(F.col("size") * F.col("_n")).cast("long").alias("source_size"))
    # windows over one row for each source
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("_source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("_w", F.get(cycle, F.pmod(place, F.lit(len(weights)))))
    by_ratio = W.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("_w"), F.col("_source").asc_nulls_last())
    all_rows = W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("_all", F.sum("source_size").over(all_rows)).withColumn("_level", (F.lit(share) * F.col("_all") - F.lit(most) * before) / rest)
    # sources below the first whose limit reaches its level stop at their limit; the others take that level
    s = s.withColumn("_open", F.min(F.when(F.col("_level") * F.col("_w") <= F.lit(most) * F.col("source_size"), F.struct(F.col("source_size") / F.col("_w"), F.col("_source").isNull(), F.col("_source"), F.col("_level")))).over(all_rows))
    level = F.col("_open._level")
    full = F.lit(most) * F.col("source_size")
    return s.select("_source", "source_size", F.when(level.isNull(), full).otherwise(F.least(full, level * F.col("_w"))).alias("target"))


def solve_rates(hist: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """_source, size and rate: the bounded entropy projection, by bracketed Newton steps on the dual."""
    mean = hist.groupBy("_source").agg((F.sum(F.col("size") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    state = targets.join(mean, targets["_source"].eqNullSafe(mean["_source"])).select(
        targets["_source"], "target", "source_size", "_mean", F.lit(0.0).alias("_m"), F.lit(None).cast("double").alias("_lo"), F.lit(None).cast("double").alias("_hi"), ((F.col("target") >= F.lit(most) * F.col("source_size") * (1 - 1e-12)) | (F.col("source_size") == 0)).alias("_done")
    )
    state = stage(state, "mix-state")
    # one row for each source
    files = 1 + state.count() // 100_000
    for _ in range(MAX_STEPS):
        open_state = state.where(~F.col("_done"))
        h = hist.join(open_state, hist["_source"].eqNullSafe(open_state["_source"])).select(hist["_source"], "size", "_n", "_m", "_mean")
        x = F.col("size") / F.col("_mean")
        rate = F.least(F.lit(most), F.exp(F.least(F.col("_m") * x, F.lit(50.0))))
        slope = F.when(rate < most, rate * x * F.col("size")).otherwise(F.lit(0.0))
        # fixed-point sums do not depend on the order of addition
        got = F.sum(F.round(rate * F.col("size") * F.col("_n") * 65536).cast("long")) / 65536
        slopes = F.sum(F.round(slope * F.col("_n") * 256).cast("long")) / 256
        sums = h.groupBy("_source").agg(got.alias("_got"), slopes.alias("_slope")).withColumnRenamed("_source", "_s")
        gap = F.col("_got") - F.col("target")
        lo = F.when(gap <= 0, F.col("_m")).otherwise(F.col("_lo"))
        hi = F.when(gap >= 0, F.col("_m")).otherwise(F.col("_hi"))
        moved = state.join(sums, state["_source"].eqNullSafe(sums["_s"]), "left").drop("_s")
        moved = moved.withColumns({"_lo": F.when(F.col("_got").isNull(), F.col("_lo")).otherwise(lo), "_hi": F.when(F.col("_got").isNull(), F.col("_hi")).otherwise(hi)})
        newton = F.when(F.col("_slope") > 0, F.col("_m") - gap / F.col("_slope"))
        # outside the bracket, or without a slope: halve the bracket, or double the reach where one side is open
        halved = F.when(F.col("_lo").isNull(), F.col("_hi") * 2 - 1).when(F.col("_hi").isNull(), F.col("_lo") * 2 + 1).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        inside = newton.isNotNull() & (F.col("_lo").isNull() | (newton > F.col("_lo"))) & (F.col("_hi").isNull() | (newton < F.col("_hi")))
        step = F.when(inside & F.col("_lo").isNull(), F.greatest(newton, halved)).when(inside & F.col("_hi").isNull(), F.least(newton, halved)).when(inside, newton).otherwise(halved)
        near = F.abs(gap) <= F.greatest(F.col("target") * TOLERANCE, F.lit(0.01))
        stuck = F.col("_hi") - F.col("_lo") <= F.abs(F.col("_m")) * 1e-15
        moved = moved.select("_source", "target", "source_size", "_mean", F.when(F.col("_got").isNull() | near, F.col("_m")).otherwise(step).alias("_m"), "_lo", "_hi", (F.col("_done") | F.coalesce(near, F.lit(False)) | F.coalesce(stuck, F.lit(False))).alias("_done"))
        before, state = state, stage(moved.coalesce(files), "mix-state")
        discard(before)
        if state.where(~F.col("_done")).isEmpty():
            break
    else:
        raise RuntimeError(f"the rates of a source did not settle in {MAX_STEPS} steps")
    both = hist.join(state.withColumnRenamed("_source", "_s"), hist["_source"].eqNullSafe(F.col("_s"))).drop("_s")
    full = F.col("target") >= F.lit(most) * F.col("source_size") * (1 - 1e-12)
    x = F.col("size") / F.col("_mean")
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(full, F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.least(F.col("_m") * x, F.lit(50.0)))))
    return both.select("_source", "size", "_n", "target", "source_size", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per input row: `doc` (the row as a struct), size, source_size, target, rate, copies, taken."""
    prepare(docs.sparkSession)
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    sized = docs.select(*carried(docs), F.col(source).alias("_source"), F.size(words(F.col(text))).cast("long").alias("size"), key.alias("_key"))
    sized = sized.withColumn("_b", F.substring("_key", 1, 2))
    narrow = stage(sized.select("_source", "size", "_b", "_key"), "mix-rows")
    by_bucket = stage(narrow.groupBy("_source", "size", "_b").agg(F.count(F.lit(1)).alias("_c")), "mix-counts")
    hist = stage(by_bucket.groupBy("_source", "size").agg(F.sum("_c").alias("_n")), "mix-histogram")
    rates = solve_rates(hist, source_targets(hist, weights, share, most), most)
    # running sum of the fractions over a source's sizes
    part = F.col("rate") - F.floor("rate")
    before = F.sum(part * F.col("_n")).over(W.partitionBy("_source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1))
    rates = rates.withColumn("_part", part).withColumn("_start", F.coalesce(before, F.lit(0.0)) + 0.5)
    first = F.coalesce(F.sum("_c").over(W.partitionBy("_source", "size").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = by_bucket.select(F.col("_source").alias("_s"), F.col("size").alias("_z"), F.col("_b").alias("_q"), first.alias("_first"))
    same = rates["_source"].eqNullSafe(ranks["_s"]) & (rates["size"] == ranks["_z"])
    plan = ranks.join(rates, same).select("_s", "_z", "_q", "_first", "target", "source_size", "rate", "_part", "_start")
    own = sized.withColumn("_i", F.row_number().over(W.partitionBy("_source", "size", "_b").orderBy("_key")) - 1)
    out = own.join(plan, own["_source"].eqNullSafe(plan["_s"]) & (own["size"] == plan["_z"]) & (own["_b"] == plan["_q"]))
    at = F.col("_start") + F.col("_part") * (F.col("_first") + F.col("_i"))
    extra = F.floor(at + F.col("_part")) - F.floor(at)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(F.lit(most), F.floor("rate") + extra)).cast("int")
    return out.withColumn("copies", copies).select(restored(docs), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))
