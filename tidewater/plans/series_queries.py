"""Queries over frame series, islands, intervals and timestamps. Frames are a user's events in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.times import micros, seconds
from tidewater.operators import series as S
from tidewater.plans.base import Tables, query
from tidewater.streaming import sessions
from tidewater.streaming.machines import run_batch

FRAMES = "f AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1000000.0::DOUBLE AS t, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"


def frames(t: Tables) -> DataFrame:
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return t.events.select("user_id", "event_id", "event_type", "value", seconds("ts").alias("t"), micros("ts").alias("us"), pos.cast("long").alias("pos"))


@query(
    f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM f), m AS (SELECT user_id, pos, value, event_id FROM n UNION ALL SELECT user_id, -1 - pos, value, NULL FROM n WHERE pos < 5 UNION ALL SELECT user_id, 2 * n - 1 - pos, value, NULL FROM n WHERE pos >= n - 5),
    w AS (SELECT event_id, avg(value) OVER k AS m, stddev_pop(value) OVER k AS s FROM m WINDOW k AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))
    SELECT event_id, round(m, 6) AS mean, round(s / (m + 1e-6), 6) AS cv FROM w WHERE event_id IS NOT NULL"""
)
def win_moving_cv(t: Tables) -> DataFrame:
    """Coefficient of variation in a centred window, edges mirrored."""
    f = frames(t).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("user_id"))).select("user_id", "pos", "value", "event_id", "n")
    none = F.lit(None).cast("long").alias("event_id")
    head = f.where("pos < 5").select("user_id", (-1 - F.col("pos")).alias("pos"), "value", none)
    tail = f.where("pos >= n - 5").select("user_id", (2 * F.col("n") - 1 - F.col("pos")).alias("pos"), "value", none)
    w = W.partitionBy("user_id").orderBy("pos").rowsBetween(-5, 4)
    m = f.drop("n").unionByName(head).unionByName(tail).select("event_id", F.avg("value").over(w).alias("m"), F.stddev_pop("value").over(w).alias("s"))
    return m.where("event_id IS NOT NULL").select("event_id", F.round("m", 6).alias("mean"), F.round(F.col("s") / (F.col("m") + 1e-6), 6).alias("cv"))


ISLANDS = """r AS (SELECT *, sum(CASE WHEN v AND NOT coalesce(pv, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY pos) AS pv FROM (SELECT *, {0} AS v FROM f))),
    i AS (SELECT user_id, run, min(pos) AS first, max(pos) + 1 AS last, count(*) AS length, max(value) AS peak FROM r WHERE v GROUP BY user_id, run)"""


@query(f"WITH {FRAMES}, {ISLANDS.format('value < 30')} SELECT user_id, first, last, length FROM i WHERE length >= 3")
def win_pauses(t: Tables) -> DataFrame:
    """Runs of at least three quiet frames."""
    return S.islands(frames(t), ["user_id"], "pos", F.col("value") < 30, []).where("length >= 3")


@query(
    f"""WITH {FRAMES}, {ISLANDS.format('value > 35')}, k AS (SELECT * FROM i WHERE length >= 2), g AS (SELECT *, sum(CASE WHEN first - pl < 3 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY first) AS g FROM (SELECT *, lag(last) OVER (PARTITION BY user_id ORDER BY first) AS pl FROM k))
    SELECT user_id, min(first) AS first, max(last) AS last, count(*) AS parts FROM g GROUP BY user_id, g"""
)
def win_merged_islands(t: Tables) -> DataFrame:
    """Voiced runs, merged over short breaths."""
    runs = S.islands(frames(t), ["user_id"], "pos", F.col("value") > 35, []).where("length >= 2")
    return S.merge_near(runs.select("user_id", "first", "last"), ["user_id"], "first", "last", 3)


@query(
    f"""WITH {FRAMES.replace("f AS (", "f0 AS (")}, q AS (SELECT user_id, greatest(3.5 * quantile_cont(value, 0.1), 40) AS th FROM f0 GROUP BY user_id), f AS (SELECT f0.*, th FROM f0 JOIN q USING (user_id)), {ISLANDS.format('value > th')}
    SELECT user_id, first, last, round(peak, 4) AS peak FROM i WHERE length >= 2"""
)
def win_bursts(t: Tables) -> DataFrame:
    """Runs above a threshold that follows the noise floor, with their peaks."""
    f = frames(t)
    q = f.groupBy("user_id").agg(F.greatest(3.5 * F.percentile("value", 0.1), F.lit(40.0)).alias("th"))
    out = S.islands(f.join(q, "user_id"), ["user_id"], "pos", F.col("value") > F.col("th"), [F.round(F.max("value"), 4).alias("peak")])
    return out.where("length >= 2").drop("length")


@query(
    f"""WITH RECURSIVE {FRAMES}, s AS (SELECT user_id, us FROM f WHERE event_type = 'signup'), r AS (SELECT user_id, min(us) AS us FROM s GROUP BY user_id UNION ALL SELECT r.user_id, (SELECT min(s.us) FROM s WHERE s.user_id = r.user_id AND s.us > r.us + 86400000000) FROM r WHERE r.us IS NOT NULL)
    SELECT user_id, count(us) AS n_kept, max(us) AS last_us FROM r GROUP BY user_id"""
)
def win_min_spacing(t: Tables) -> DataFrame:
    """Marks over a day after the last one kept."""
    marks = t.events.where("event_type = 'signup'").select("user_id", micros("ts").alias("us")).withColumn("at", F.col("us"))
    kept = run_batch(marks, "user_id", ["us"], sessions.keeping(86_400_000_000))
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_kept"), F.max("mark").alias("last_us"))


@query(
    f"""WITH {FRAMES}, q AS (SELECT user_id, quantile_cont(value, 0.1) AS lo FROM f GROUP BY user_id), m AS (SELECT f.*, lo, min(value) OVER (PARTITION BY f.user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS least FROM f JOIN q USING (user_id))
    SELECT event_id, round(value, 3) AS value FROM m WHERE value <= lo AND value = least"""
)
def win_local_minima(t: Tables) -> DataFrame:
    """Frames below the tenth percentile that none of their four neighbours undercuts."""
    f = frames(t)
    q = f.groupBy("user_id").agg(F.percentile("value", 0.1).alias("lo"))
    w = W.partitionBy("user_id").orderBy("pos").rowsBetween(-2, 2)
    rows = f.join(q, "user_id").withColumn("least", F.min("value").over(w))
    return rows.where((F.col("value") <= F.col("lo")) & (F.col("value") == F.col("least"))).select("event_id", F.round("value", 3).alias("value"))


@query(f"WITH {FRAMES}, d AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY pos) AS d FROM f) SELECT user_id, count(d) AS n, quantile_cont(d, 0.5) AS median_gap FROM d WHERE d IS NOT NULL GROUP BY user_id")
def win_periods(t: Tables) -> DataFrame:
    """Steps between marks and their median."""
    d = frames(t).select("user_id", (F.col("us") - F.lag("us").over(W.partitionBy("user_id").orderBy("pos"))).alias("d")).where("d IS NOT NULL")
    return d.groupBy("user_id").agg(F.count("d").alias("n"), F.percentile("d", 0.5).alias("median_gap"))


@query(
    f"""WITH {FRAMES}, c AS (SELECT user_id, pos, value - avg(value) OVER (PARTITION BY user_id) AS x FROM f), l AS (SELECT a.user_id, a.pos - b.pos AS lag, sum(a.x * b.x) AS ac FROM c a JOIN c b ON a.user_id = b.user_id AND a.pos - b.pos BETWEEN 3 AND 15 GROUP BY ALL)
    SELECT user_id, lag, round(ac / (SELECT sum(x * x) FROM c WHERE c.user_id = l.user_id), 6) AS strength FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(ac, 4) DESC, lag) = 1"""
)
def win_autocorrelation(t: Tables) -> DataFrame:
    """The strongest lag of 3 to 15 frames: lagged values sit beside each row, so one pass gives all sums."""
    c = frames(t).select("user_id", "pos", (F.col("value") - F.avg("value").over(W.partitionBy("user_id"))).alias("x"))
    w = W.partitionBy("user_id").orderBy("pos")
    rows = c.select("user_id", "x", *[F.lag("x", k).over(w).alias(f"x{k}") for k in range(3, 16)])
    sums = rows.groupBy("user_id").agg(F.sum(F.col("x") * F.col("x")).alias("e"), *[F.sum(F.col("x") * F.col(f"x{k}")).alias(f"s{k}") for k in range(3, 16)])
    best = F.array_max(F.array(*[F.struct(F.round(f"s{k}", 4).alias("r"), F.lit(-k).cast("long").alias("k"), F.col(f"s{k}").alias("s")) for k in range(3, 16)]))
    return sums.select("user_id", (-best["k"]).alias("lag"), F.round(best["s"] / F.col("e"), 6).alias("strength"))


@query(f"WITH {FRAMES} SELECT user_id, round(regr_slope(us / 1000000.0, pos) , 3) AS period, count(*) AS n FROM f GROUP BY user_id")
def win_linear_fit(t: Tables) -> DataFrame:
    """Period as the slope of marks over their number."""
    return frames(t).groupBy("user_id").agg(F.round(F.regr_slope(F.col("us") / 1000000.0, F.col("pos")), 3).alias("period"), F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, string_agg(role, ' ') OVER (PARTITION BY conv_id ORDER BY turn) AS words, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS n_chars FROM conversations", longs=("n_chars",))
def win_prefix_snapshots(t: Tables) -> DataFrame:
    """All words so far, at each moment."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), " ").alias("words"), F.sum(F.char_length("text").cast("long")).over(w).alias("n_chars"))


@query(
    f"""WITH {FRAMES}, u AS (SELECT user_id, event_id, pos, CASE WHEN event_type IN ('click', 'view') THEN us END AS k FROM f),
    b AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos) AS lo, first_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi, count(k) OVER (PARTITION BY user_id ORDER BY pos) AS g FROM u),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY pos) - CASE WHEN g = 0 THEN 1 ELSE 2 END AS i, count(*) OVER (PARTITION BY user_id, g) - CASE WHEN g = 0 THEN 0 ELSE 1 END AS n FROM b)
    SELECT event_id, CASE WHEN k IS NOT NULL THEN k ELSE CAST(round(coalesce(lo, hi, 0) + (coalesce(hi, lo + 300000, 300000) - coalesce(lo, hi, 0)) * (i::DOUBLE / n)) AS BIGINT) END AS us FROM c"""
)
def win_untimed_interpolation(t: Tables) -> DataFrame:
    """Untimed words spread evenly between their timed neighbours."""
    w = W.partitionBy("user_id").orderBy("pos")
    k = F.when(F.col("event_type").isin("click", "view"), F.col("us"))
    u = frames(t).select("user_id", "event_id", "pos", k.alias("k"))
    b = u.select("*", F.last("k", ignorenulls=True).over(w).alias("lo"), F.first("k", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("hi"), F.count("k").over(w).alias("g"))
    own = W.partitionBy("user_id", "g")
    edge = (F.col("g") > 0).cast("int")
    c = b.select("*", (F.row_number().over(own.orderBy("pos")) - 1 - edge).alias("i"), (F.count(F.lit(1)).over(own) - edge).alias("n"))
    lo, hi = F.coalesce("lo", "hi", F.lit(0)), F.coalesce("hi", F.col("lo") + 300000, F.lit(300000))
    between = F.round(lo + (hi - lo) * (F.col("i").cast("double") / F.col("n"))).cast("long")
    return c.select("event_id", F.coalesce("k", between).alias("us"))


@query(
    f"WITH {FRAMES}, l AS (SELECT user_id, list(value ORDER BY pos) AS v FROM f GROUP BY user_id) SELECT user_id, round(list_reduce(v, lambda a, x: a * 0.99 + x * 0.01), 6) AS floor FROM l"
)
def win_noise_floor(t: Tables) -> DataFrame:
    """Exponential mean over a series, begun at its first value."""
    v = frames(t).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value")))["value"].alias("v"))
    return v.select("user_id", F.round(F.aggregate("v", F.element_at("v", 1) * 0 + F.lit(None).cast("double"), lambda a, x: F.coalesce(a * 0.99 + x * 0.01, x)), 6).alias("floor"))


@query(
    f"""WITH {FRAMES} SELECT event_id, round(coalesce(lag(value, 2) OVER w, first_value(value) OVER w), 4) AS b2, round(coalesce(lag(value, 1) OVER w, first_value(value) OVER w), 4) AS b1, round(coalesce(lead(value, 1) OVER w, last_value(value) OVER a), 4) AS a1 FROM f
    WINDOW w AS (PARTITION BY user_id ORDER BY pos), a AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) QUALIFY pos % 3 = 0"""
)
def win_splice_and_subsample(t: Tables) -> DataFrame:
    """Every third frame beside its neighbours, edges repeated."""
    w = W.partitionBy("user_id").orderBy("pos")
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lag = lambda k: F.round(F.coalesce(F.lag("value", k).over(w), F.first("value").over(w)), 4)
    rows = frames(t).select("event_id", "pos", lag(2).alias("b2"), lag(1).alias("b1"), F.round(F.coalesce(F.lead("value").over(w), F.last("value").over(every)), 4).alias("a1"))
    return rows.where("pos % 3 = 0").drop("pos")


@query(
    f"""WITH {FRAMES}, w AS (SELECT user_id, pos // 4 AS k, sqrt(avg(value * value)) AS rms FROM f GROUP BY ALL), d AS (SELECT user_id, CASE WHEN rms > 0 THEN greatest(20 * log10(rms), -100) ELSE -100 END AS db FROM w)
    SELECT user_id, round(quantile_cont(db, 0.05), 6) AS floor_db, round(max(db), 6) AS peak_db FROM d GROUP BY user_id"""
)
def win_noise_floor_db(t: Tables) -> DataFrame:
    """Root mean squares of blocks in decibels, their low quantile and peak."""
    blocks = frames(t).groupBy("user_id", F.floor(F.col("pos") / 4).alias("k")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    db = F.when(F.col("rms") > 0, F.greatest(20 * F.log10("rms"), F.lit(-100.0))).otherwise(-100.0)
    return blocks.select("user_id", db.alias("db")).groupBy("user_id").agg(F.round(F.percentile("db", 0.05), 6).alias("floor_db"), F.round(F.max("db"), 6).alias("peak_db"))


@query(f"WITH {FRAMES}, m AS (SELECT event_id, pos, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS s FROM f) SELECT event_id, s > 4 // 2 AS active FROM m WHERE pos % 2 = 0")
def agg_frame_majority(t: Tables) -> DataFrame:
    """Whether a label holds in most frames around every second frame."""
    w = W.partitionBy("user_id").orderBy("pos").rowsBetween(-4, 4)
    rows = frames(t).select("event_id", "pos", F.sum((F.col("event_type") == "click").cast("int")).over(w).alias("s"))
    return rows.where("pos % 2 = 0").select("event_id", (F.col("s") > 2).alias("active"))


@query("SELECT l_orderkey, l_linenumber, k, s + k * 10 AS begin, least(s + (k + 1) * 10, e) AS stop FROM (SELECT l_orderkey, l_linenumber, l_linenumber * 100 AS s, l_linenumber * 100 + CAST(l_quantity AS INTEGER) AS e, unnest(range(0, (CAST(l_quantity AS INTEGER) + 9) // 10)) AS k FROM lineitem)")
def seg_split_long(t: Tables) -> DataFrame:
    """Segments cut where they pass the limit."""
    q = F.col("l_quantity").cast("int")
    rows = t.lineitem.where(q > 0).select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 100).alias("s"), q.alias("q"), F.explode(F.sequence(F.lit(0), F.floor((q - 1) / 10).cast("int"))).alias("k"))
    return rows.select("l_orderkey", "l_linenumber", F.col("k").cast("long").alias("k"), (F.col("s") + F.col("k") * 10).cast("long").alias("begin"), F.least(F.col("s") + (F.col("k") + 1) * 10, F.col("s") + F.col("q")).cast("long").alias("stop"))


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, n, unnest(range(0, n, 5)) AS st FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS n FROM lineitem))
    SELECT l_orderkey, l_linenumber, greatest(0, least(st + 10, n) - 10) AS begin, least(st + 10, n) AS stop, greatest(0, 10 - n) AS padding FROM c WHERE st = 0 OR least(st + 10, n) > least(st + 5, n)"""
)
def seg_sliding_chunks(t: Tables) -> DataFrame:
    """Overlapping chunks, the last aligned to the end."""
    n = F.col("l_quantity").cast("int")
    rows = t.lineitem.where(n > 0).select("l_orderkey", "l_linenumber", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(5))).alias("st"))
    end, before = F.least(F.col("st") + 10, F.col("n")), F.least(F.col("st") + 5, F.col("n"))
    rows = rows.where((F.col("st") == 0) | (end > before))
    return rows.select("l_orderkey", "l_linenumber", F.greatest(F.lit(0), end - 10).alias("begin"), end.alias("stop"), F.greatest(F.lit(0), 10 - F.col("n")).alias("padding"))


@query("WITH m AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL), r AS (SELECT user_id, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY first) - 1 AS label FROM m) SELECT event_id, label FROM events JOIN r USING (user_id, event_type)")
def seg_renumber_labels(t: Tables) -> DataFrame:
    """Labels numbered by first appearance."""
    m = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    r = m.select("user_id", "event_type", (F.dense_rank().over(W.partitionBy("user_id").orderBy("first")) - 1).cast("long").alias("label"))
    return t.events.select("event_id", "user_id", "event_type").join(r, ["user_id", "event_type"]).select("event_id", "label")


@query(
    f"""WITH {FRAMES}, g AS (SELECT *, sum(CASE WHEN event_type = pe AND us - pu <= 7200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS g FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS pe, lag(us) OVER (PARTITION BY user_id ORDER BY pos) AS pu FROM f))
    SELECT user_id, min(event_type) AS speaker, min(us) AS begin, max(us) AS stop, count(*) AS n FROM g GROUP BY user_id, g"""
)
def seg_merge_runs(t: Tables) -> DataFrame:
    """Touching runs of one speaker."""
    w = W.partitionBy("user_id").orderBy("pos")
    same = (F.col("event_type") == F.lag("event_type").over(w)) & (F.col("us") - F.lag("us").over(w) <= 7200000000)
    rows = frames(t).withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int"))
    rows = rows.withColumn("g", F.sum("new").over(w))
    return rows.groupBy("user_id", "g").agg(F.min("event_type").alias("speaker"), F.min("us").alias("begin"), F.max("us").alias("stop"), F.count(F.lit(1)).alias("n")).drop("g")


@query(
    f"""WITH {FRAMES}, d AS (SELECT user_id, us, pos, us - lag(us) OVER (PARTITION BY user_id ORDER BY pos) AS d FROM f), th AS (SELECT unnest([259200, 172800, 86400, 43200, 21600]) AS th),
    g AS (SELECT th, user_id, sum(CASE WHEN d > th::BIGINT * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY th, user_id ORDER BY pos) AS g FROM d, th), c AS (SELECT th, user_id, g, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT th, user_id, count(*) AS n_sent FROM c WHERE n >= 3 GROUP BY ALL HAVING count(*) >= 2)
    SELECT user_id, max(th) AS threshold, arg_max(n_sent, th) AS n_sentences FROM s GROUP BY user_id"""
)
def seg_adaptive_pause(t: Tables) -> DataFrame:
    """The loosest pause threshold that gives two sentences of three words."""
    w = W.partitionBy("user_id").orderBy("pos")
    d = frames(t).select("user_id", "pos", (F.col("us") - F.lag("us").over(w)).alias("d"))
    d = d.withColumn("th", F.explode(F.array(*[F.lit(x) for x in (259200, 172800, 86400, 43200, 21600)])))
    g = d.withColumn("g", F.sum(F.coalesce((F.col("d") > F.col("th").cast("long") * 1000000).cast("int"), F.lit(0))).over(W.partitionBy("th", "user_id").orderBy("pos")))
    s = g.groupBy("th", "user_id", "g").count().where("count >= 3").groupBy("th", "user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return s.groupBy("user_id").agg(F.max("th").alias("threshold"), F.max_by("n", "th").alias("n_sentences"))


@query(f"WITH {FRAMES}, u AS (SELECT user_id, min(us) AS a, max(us) AS b FROM f GROUP BY user_id) SELECT user_id, k, a + k * 604800000000 AS begin, least(a + (k + 1) * 604800000000, b) AS stop FROM (SELECT user_id, a, b, unnest(range(0, (b - a) // 604800000000 + 1)) AS k FROM u)")
def seg_periodic_cut(t: Tables) -> DataFrame:
    """Instances of a fixed period."""
    week = 604800000000
    u = frames(t).groupBy("user_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    rows = u.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / week))).alias("k"))
    return rows.select("user_id", "k", (F.col("a") + F.col("k") * week).alias("begin"), F.least(F.col("a") + (F.col("k") + 1) * week, F.col("b")).alias("stop"))


@query(
    f"""WITH {FRAMES}, s AS (SELECT user_id, event_id AS id, us AS begin, us + CAST(floor(value * 600) AS BIGINT) * 1000000 AS stop FROM f WHERE event_type = 'view'), v AS (SELECT user_id, event_id AS span, us AS sb, us + CAST(floor(value * 900) AS BIGINT) * 1000000 AS se FROM f WHERE event_type = 'click'),
    o AS (SELECT id, span, least(stop, se) - greatest(begin, sb) AS overlap FROM s JOIN v USING (user_id) WHERE least(stop, se) > greatest(begin, sb))
    SELECT id, span, overlap FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, span) = 1"""
)
def jn_interval_overlap(t: Tables) -> DataFrame:
    """The speaker interval that a sentence overlaps most."""
    f = frames(t)
    end = lambda k: F.col("us") + F.floor(F.col("value") * k) * 1000000
    q = f.where("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), F.col("us").alias("begin"), end(600).alias("end"))
    s = f.where("event_type = 'click'").select("user_id", F.col("event_id").alias("span"), F.col("us").alias("span_begin"), end(900).alias("span_end"))
    return S.best_overlap(q, s, 21600 * 1000000, ["user_id"])


@query(
    """WITH s AS (SELECT conv_id, turn, turn * 10 AS a, turn * 10 + length(text) // 50 AS b FROM conversations) SELECT conv_id, frame, count(*) AS n_active FROM (SELECT conv_id, unnest(range(a, b)) AS frame FROM s) GROUP BY conv_id, frame"""
)
def jn_rasterise(t: Tables) -> DataFrame:
    """Segments put onto frames, with how many are active in each."""
    b = F.floor(F.char_length("text") / 50).cast("int")
    rows = t.conversations.where(b > 0).select("conv_id", F.explode(F.sequence(F.col("turn") * 10, F.col("turn") * 10 + b - 1)).alias("frame"))
    return rows.groupBy("conv_id", "frame").agg(F.count(F.lit(1)).alias("n_active"))


@query("SELECT doc_id, k AS begin, substr(text, k + 1, 400) AS part FROM (SELECT doc_id, text, unnest(range(0, length(text) - 400 + 1, 160)) AS k FROM documents WHERE length(text) >= 400)")
def sup_sliding_windows(t: Tables) -> DataFrame:
    """Whole windows only, no padding."""
    d = t.documents.where(F.char_length("text") >= 400)
    rows = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.char_length("text") - 400, F.lit(160))).alias("k"))
    return rows.select("doc_id", F.col("k").cast("long").alias("begin"), F.substring("text", F.col("k") + 1, F.lit(400)).alias("part"))


@query("SELECT conv_id, turn, list_transform([0, 10, 25], lambda x: x + turn * 1000) AS starts FROM conversations")
def tim_shift(t: Tables) -> DataFrame:
    """Timestamps moved by their segment's offset."""
    base = F.array(F.lit(0), F.lit(10), F.lit(25))
    return t.conversations.select("conv_id", "turn", F.transform(base, lambda x: (x + F.col("turn") * 1000).cast("long")).alias("starts"))


@query(
    f"""WITH {FRAMES}, g AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM f)
    SELECT user_id, s AS sentence, min(us) AS begin, max(us) AS stop, count(*) AS n_words, bool_or(event_type = 'purchase') AS closed FROM g GROUP BY user_id, s""",
    longs=("sentence",),
)
def tim_sentences(t: Tables) -> DataFrame:
    """Words up to and with a closing mark form a sentence."""
    w = W.partitionBy("user_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    close = F.col("event_type") == "purchase"
    rows = frames(t).withColumn("sentence", F.coalesce(F.sum(close.cast("int")).over(w), F.lit(0)))
    return rows.groupBy("user_id", "sentence").agg(F.min("us").alias("begin"), F.max("us").alias("stop"), F.count(F.lit(1)).alias("n_words"), F.bool_or(close).alias("closed"))


@query(
    """WITH s AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(n) OVER (PARTITION BY doc_id) AS total, i FROM (SELECT doc_id, length(unnest(string_split(text, chr(10)))) AS n, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))
    SELECT doc_id, i, (upto - n) * 60000 // greatest(total, 1) AS begin, upto * 60000 // greatest(total, 1) AS stop FROM s""",
    longs=("begin", "stop"),
)
def str_proportional_times(t: Tables) -> DataFrame:
    """A minute shared among the lines of a text by their length."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", F.char_length("line").cast("long").alias("n"))
    w = W.partitionBy("doc_id")
    rows = rows.withColumn("upto", F.sum("n").over(w.orderBy("i"))).withColumn("total", F.greatest(F.sum("n").over(w), F.lit(1).cast("long")))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.expr("(upto - n) * 60000 div total").alias("begin"), F.expr("upto * 60000 div total").alias("stop"))


@query()
def seg_merge_speech(t: Tables) -> DataFrame:
    """Speech segments merged up to 15 s, cut at any start or end."""
    item = F.struct((F.col("turn") * 4000).cast("long").alias("begin"), (F.col("turn") * 4000 + F.char_length("text") * 3).cast("long").alias("end"))
    g = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("b"))
    return g.select("conv_id", S.merge_segments(F.col("b"), 15000, 0).alias("merged"))


_FIRED = """f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value / 200 AS a FROM events),
    r AS (SELECT DISTINCT user_id, -1::BIGINT AS pos, 0.0::DOUBLE AS rest, 0.0::DOUBLE AS level, FALSE AS fired FROM f UNION ALL
    SELECT user_id, pos, CASE WHEN l >= 1.0 THEN l - 1.0 ELSE l END, l, l >= 1.0 FROM (SELECT f.user_id, f.pos, r.rest + f.a AS l FROM r JOIN f ON f.user_id = r.user_id AND f.pos = r.pos + 1))"""


def _weights(t: Tables) -> DataFrame:
    return t.events.select("user_id", micros("ts").alias("us"), "event_id", (F.col("value") / 200).alias("weight"))


@query(f"WITH RECURSIVE {_FIRED} SELECT user_id, pos AS frame, round(level, 9) AS level, fired FROM r WHERE pos >= 0")
def mth_integrate_and_fire(t: Tables) -> DataFrame:
    """Running sums of a series of weights that lose 1 each time they reach it."""
    return run_batch(_weights(t), "user_id", ["us", "event_id"], sessions.firing(1.0)).withColumn("level", F.round("level", 9))


@query(f"WITH RECURSIVE {_FIRED} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS nth, pos AS frame FROM r WHERE fired")
def mth_fire_times(t: Tables) -> DataFrame:
    """Frames at which the integral of a series of weights fires."""
    fired = run_batch(_weights(t), "user_id", ["us", "event_id"], sessions.firing(1.0)).where("fired")
    return fired.select("user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("frame")) - 1).cast("long").alias("nth"), "frame")


@query(
    f"""WITH RECURSIVE {_FIRED}, n AS (SELECT user_id, count(*) AS n FROM f GROUP BY user_id), x AS (SELECT user_id, pos - 1.5 AS b, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS m, lead(pos - 1.5) OVER w AS e FROM r WHERE fired WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
    i AS (SELECT *, n - max(b) OVER (PARTITION BY user_id) > 5 AS long, (n + max(b) OVER (PARTITION BY user_id)) / 2 AS mid FROM x JOIN n USING (user_id)),
    l AS (SELECT user_id, NULL AS token, 0.0 AS begin, CASE WHEN m > 1 THEN b WHEN long THEN mid ELSE n END AS stop FROM i WHERE k = 1 AND b > 5 UNION ALL
    SELECT user_id, k - 1, b, CASE WHEN e - b > 12 THEN b + 12 WHEN k < m - 1 THEN e WHEN long THEN mid ELSE n END FROM i WHERE e IS NOT NULL UNION ALL
    SELECT user_id, NULL, b + 12, CASE WHEN k < m - 1 THEN e WHEN long THEN mid ELSE n END FROM i WHERE e - b > 12 UNION ALL
    SELECT user_id, NULL, mid, n FROM i WHERE k = 1 AND long UNION ALL SELECT user_id, NULL, 0.0, n FROM n WHERE user_id NOT IN (SELECT user_id FROM x))
    SELECT user_id, CAST(token AS BIGINT) AS token, CAST(begin AS DOUBLE) AS begin, CAST(stop AS DOUBLE) AS stop FROM l"""
)
def mth_token_times(t: Tables) -> DataFrame:
    """Tokens between fires, with silences before, between and after them; a token lasts twelve frames at most."""
    return run_batch(_weights(t), "user_id", ["us", "event_id"], sessions.timing(1.0))
