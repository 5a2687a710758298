"""Queries with joins, aggregates, rankings, votes and detection metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions.times import seconds
from tidewater.operators import ranking as R
from tidewater.plans.base import Tables, query
from tidewater.plans.text_queries import TOKENS

PAIRS = "SELECT conv_id, turn, role, text AS ref, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM conversations"


def turn_pairs(t: Tables) -> DataFrame:
    """Each turn as a reference, the next as its hypothesis."""
    w = W.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", "role", F.col("text").alias("ref"), F.lead("text").over(w).alias("hyp"))


@query(f"WITH p AS ({PAIRS}) SELECT role, count(*) AS n_turns, CAST(sum(len({TOKENS.format('ref')})) AS BIGINT) AS n_tokens, count(*) FILTER (WHERE hyp IS NULL) AS missing_hyp FROM p GROUP BY role")
def token_count_by_role(t: Tables) -> DataFrame:
    return turn_pairs(t).groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.size(T.tokens(F.col("ref")))).cast("long").alias("n_tokens"), F.count_if(F.col("hyp").isNull()).alias("missing_hyp"))


@query(
    """WITH p AS (SELECT d.doc_id, d.lang, l.quality AS target, CASE WHEN d.n_chars > 800 THEN 1 ELSE 0 END AS pred, l.toxic FROM documents d JOIN labels l USING (doc_id))
    SELECT lang, count(*) FILTER (WHERE toxic <> 1) AS n_scored, round(avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END) FILTER (WHERE toxic <> 1), 9) AS accuracy FROM p GROUP BY lang"""
)
def agg_masked_accuracy(t: Tables) -> DataFrame:
    """Share of equal labels, where an ignored label takes no part."""
    p = t.documents.select("doc_id", "lang", (F.col("n_chars") > 800).cast("int").alias("pred")).join(t.labels, "doc_id")
    scored = F.col("toxic") != 1
    hit = F.when(scored, (F.col("pred") == F.col("quality")).cast("double"))
    return p.groupBy("lang").agg(F.count_if(scored).alias("n_scored"), F.round(F.avg(hit), 9).alias("accuracy"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error, count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id")
def agg_source_counts(t: Tables) -> DataFrame:
    n = lambda x: F.count_if(F.col("event_type") == x).alias(x)
    return t.events.groupBy("user_id").agg(n("click"), n("view"), n("error"), F.count_distinct("event_type").alias("n_types"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def agg_latency_stats(t: Tables) -> DataFrame:
    """Percentiles by linear interpolation."""
    p = lambda q: F.round(F.percentile("value", q), 6)
    return t.events.groupBy("event_type").agg(p(0.5).alias("median"), p(0.95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, max(value) FILTER (WHERE i = ceil(n * 0.5)) AS p50, max(value) FILTER (WHERE i = ceil(n * 0.95)) AS p95 FROM r GROUP BY user_id"""
)
def agg_nearest_rank(t: Tables) -> DataFrame:
    """Nearest-rank percentiles."""
    p = lambda q, n: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias(n)
    return t.events.groupBy("user_id").agg(p(0.5, "p50"), p(0.95, "p95"))


@query(
    """WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)
    SELECT d, round(-avg(CAST(x AS DOUBLE)), 9) AS neg_mean, round(1 / stddev_pop(CAST(x AS DOUBLE)), 6) AS inv_std FROM x GROUP BY d"""
)
def agg_cmvn(t: Tables) -> DataFrame:
    """Mean and variance normalisation by dimension."""
    x = t.embeddings.select(F.posexplode("embedding").alias("d", "x")).select((F.col("d") + 1).cast("long").alias("d"), F.col("x").cast("double").alias("x"))
    return x.groupBy("d").agg(F.round(-F.avg("x"), 9).alias("neg_mean"), F.round(1 / F.stddev_pop("x"), 6).alias("inv_std"))


@query("WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) SELECT label, d, round(avg(CAST(x AS DOUBLE)), 9) AS centre FROM x GROUP BY label, d")
def agg_speaker_centroid(t: Tables) -> DataFrame:
    x = t.embeddings.select("label", F.posexplode("embedding").alias("d", "x"))
    return x.groupBy("label", (F.col("d") + 1).cast("long").alias("d")).agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("centre"))


@query(
    """WITH k AS (SELECT DISTINCT lang, source, unnest(%s) AS token FROM documents), s AS (SELECT lang, token, count(*) AS n_sources FROM k GROUP BY lang, token)
    SELECT lang, count(*) AS n_tokens, count(*) FILTER (WHERE n_sources >= 2) AS supported, round(count(*) FILTER (WHERE n_sources >= 2) / count(*), 9) AS coverage FROM s GROUP BY lang"""
    % TOKENS.format("text")
)
def agg_majority_coverage(t: Tables) -> DataFrame:
    """Tokens that two or more sources attest."""
    k = t.documents.select("lang", "source", F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    s = k.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("n") >= 2).alias("supported"), F.round(F.avg((F.col("n") >= 2).cast("double")), 9).alias("coverage"))


@query("SELECT user_id, round(sum(value * CAST(json_extract(props, '$.k') AS BIGINT)) / nullif(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 0), 6) AS weighted FROM events GROUP BY user_id")
def agg_weighted_mean(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("user_id").agg(F.round(F.sum(F.col("value") * k) / F.nullif(F.sum(k), F.lit(0)), 6).alias("weighted"))


@query("SELECT least(CAST(floor((epoch_us(ts) // 1000000 % 3600) / 600) AS BIGINT), 5) AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def agg_phase_histogram(t: Tables) -> DataFrame:
    """Means by phase within a period of an hour, in six bins."""
    phase = F.floor(seconds("ts")) % 3600
    return t.events.groupBy(F.least(F.floor(phase / 600), F.lit(5)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    """WITH k AS (SELECT DISTINCT event_type AS keyword FROM events), u AS (SELECT doc_id, n_chars / 100.0 AS dur, lower(text) AS text, CASE doc_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'click' END AS kw, (doc_id % 100) / 100.0 AS confi FROM documents)
    SELECT keyword, round(sum(dur) FILTER (WHERE contains(text, left(keyword, 2))), 4) AS keyword_duration, round(sum(dur) FILTER (WHERE NOT contains(text, left(keyword, 2))), 4) AS filler_duration,
    count(*) FILTER (WHERE contains(text, left(keyword, 2)) AND kw = keyword AND confi >= 0.5) AS hits, count(*) FILTER (WHERE NOT contains(text, left(keyword, 2)) AND kw = keyword AND confi >= 0.5) AS false_alarms FROM k, u GROUP BY keyword"""
)
def agg_keyword_tables(t: Tables) -> DataFrame:
    """Durations and detections of each keyword, over utterances that hold it and those that do not."""
    names = F.array(*[F.lit(x) for x in ("error", "view", "purchase", "signup", "click")])
    u = t.documents.select((F.col("n_chars") / 100).alias("dur"), F.lower("text").alias("text"), F.get(names, F.col("doc_id") % 5).alias("kw"), ((F.col("doc_id") % 100) / 100).alias("confi"), F.explode(names).alias("keyword"))
    holds, hit = F.contains("text", F.left("keyword", F.lit(2))), (F.col("kw") == F.col("keyword")) & (F.col("confi") >= 0.5)
    total = lambda c: F.round(F.sum(F.when(c, F.col("dur"))), 4)
    return u.groupBy("keyword").agg(total(holds).alias("keyword_duration"), total(~holds).alias("filler_duration"), F.count_if(holds & hit).alias("hits"), F.count_if(~holds & hit).alias("false_alarms"))


@query(
    """WITH f AS (SELECT event_id % 200 AS frame, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS r1, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS r2, max(CASE WHEN value > 120 THEN 1 ELSE 0 END) AS s1, max(CASE WHEN value < 0.5 THEN 1 ELSE 0 END) AS s2 FROM events GROUP BY 1)
    SELECT sum(r1 + r2) AS speaker_scored, sum(greatest(r1 + r2 - s1 - s2, 0)) AS miss, sum(greatest(s1 + s2 - r1 - r2, 0)) AS false_alarm, sum(least(r1 + r2, s1 + s2) - (r1 * s1 + r2 * s2)) AS confusion,
    sum(CASE WHEN r1 + r2 > 0 AND s1 + s2 = 0 THEN 1 ELSE 0 END) AS speech_miss FROM f""",
    longs=("confusion", "false_alarm", "miss", "speaker_scored", "speech_miss"),
)
def agg_diarization_error(t: Tables) -> DataFrame:
    """Miss, false alarm and confusion over frames of two speakers."""
    top = lambda c, n: F.max(c.cast("int")).alias(n)
    f = t.events.groupBy((F.col("event_id") % 200).alias("frame")).agg(top(F.col("event_type") == "click", "r1"), top(F.col("event_type") == "view", "r2"), top(F.col("value") > 120, "s1"), top(F.col("value") < 0.5, "s2"))
    ref, sys_ = F.col("r1") + F.col("r2"), F.col("s1") + F.col("s2")
    return f.agg(
        F.sum(ref).alias("speaker_scored"),
        F.sum(F.greatest(ref - sys_, F.lit(0))).alias("miss"),
        F.sum(F.greatest(sys_ - ref, F.lit(0))).alias("false_alarm"),
        F.sum(F.least(ref, sys_) - (F.col("r1") * F.col("s1") + F.col("r2") * F.col("s2"))).alias("confusion"),
        F.sum(((ref > 0) & (sys_ == 0)).cast("int")).alias("speech_miss"),
    )


@query("SELECT lang, source, count(*) AS n, greatest(count(*), 20) AS floored FROM documents GROUP BY lang, source")
def agg_label_histogram(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("floored", F.greatest("n", F.lit(20).cast("long")))


@query("SELECT source, round(sum(n_chars) / 3600.0, 6) AS hours, sum(n_chars) AS total, count(*) AS n FROM documents GROUP BY source", longs=("total",))
def agg_totals(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.round(F.sum("n_chars") / 3600.0, 6).alias("hours"), F.sum("n_chars").alias("total"), F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) SELECT label, d, round(avg(CAST(x AS DOUBLE)), 9) AS weight FROM p GROUP BY label, d")
def agg_checkpoint_average(t: Tables) -> DataFrame:
    """Parameters averaged over each run's checkpoints."""
    rows = t.embeddings.select("label", F.posexplode("embedding").alias("d", "x"))
    return rows.groupBy("label", (F.col("d") + 1).cast("long").alias("d")).agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("weight"))


@query("SELECT conv_id, string_agg(replace(text, chr(10), ' '), ' ' ORDER BY turn) AS merged, count(*) AS n FROM conversations GROUP BY conv_id")
def agg_merge_results(t: Tables) -> DataFrame:
    """Partial texts of a session joined in order."""
    parts = F.sort_array(F.collect_list(F.struct("turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("x"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(parts["x"], " ").alias("merged"), F.count(F.lit(1)).alias("n"))


@query("SELECT h.doc_id, r.quality, CASE WHEN r.doc_id IS NULL THEN 'unmatched' ELSE 'matched' END AS state FROM documents h LEFT JOIN labels r USING (doc_id)")
def jn_hypothesis_reference(t: Tables) -> DataFrame:
    """Hypotheses decide the rows; misses are told apart."""
    r = t.labels.select("doc_id", "quality", F.lit(True).alias("there"))
    return t.documents.join(r, "doc_id", "left").select("doc_id", "quality", F.when(F.col("there"), "matched").otherwise("unmatched").alias("state"))


@query("SELECT o.o_orderkey, c.c_name, n.n_name, sum(l.l_quantity) AS qty FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL")
def jn_multiway(t: Tables) -> DataFrame:
    """Segments with speakers and recordings, as orders with customers and nations."""
    o = t.orders.select("o_orderkey", "o_custkey")
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey").join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    qty = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty"))
    return o.join(c, "o_custkey").join(qty, "o_orderkey").select("o_orderkey", "c_name", "n_name", "qty")


@query(
    """WITH s AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'signup'), q AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
    SELECT q.event_id, s.event_id AS snapshot, s.value FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.ts >= s.ts"""
)
def jn_as_of(t: Tables) -> DataFrame:
    """The latest snapshot at or before each moment: one sort by user and time, no range join."""
    snap = F.when(F.col("event_type") == "signup", F.struct("event_id", "value"))
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "signup", 0).otherwise(1)).rowsBetween(W.unboundedPreceding, 0)
    rows = t.events.where("event_type IN ('signup', 'purchase')").withColumn("s", F.last(snap, ignorenulls=True).over(w))
    return rows.where("event_type = 'purchase'").select("event_id", F.col("s.event_id").alias("snapshot"), F.col("s.value").alias("value"))


@query("SELECT q.event_id, (SELECT count(*) FROM events r WHERE r.user_id = q.user_id AND r.ts <= q.ts AND r.event_type = 'click') AS n_ref FROM events q WHERE q.event_type = 'view'")
def jn_count_until(t: Tables) -> DataFrame:
    """How many reference marks lie at or before each moment."""
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
    rows = t.events.where("event_type IN ('click', 'view')").withColumn("n_ref", F.count_if(F.col("event_type") == "click").over(w))
    return rows.where("event_type = 'view'").select("event_id", "n_ref")


@query(
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events), c AS (SELECT user_id, min(s) AS t0 FROM e GROUP BY user_id)
    SELECT event_id, least((s - t0) // 86400, 29) AS cycle FROM e JOIN c USING (user_id)"""
)
def jn_cycle_bucket(t: Tables) -> DataFrame:
    """Words put into the cycle whose edges they lie between."""
    s = F.floor(seconds("ts"))
    t0 = F.min(s).over(W.partitionBy("user_id"))
    return t.events.select("event_id", F.least(F.floor((s - t0) / 86400), F.lit(29)).alias("cycle"))


@query(
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 % 3600 AS phase FROM events)
    SELECT a.event_id, count(*) AS n_near FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs((a.phase - b.phase + 1800 + 3600) % 3600 - 1800) < 30 GROUP BY a.event_id"""
)
def jn_phase_neighbours(t: Tables) -> DataFrame:
    """Events of the same user at a like phase of the hour: an equi-join on cells of the circle, then the exact test."""
    e = t.events.select("event_id", "user_id", (F.floor(seconds("ts")) % 3600).alias("phase")).withColumn("cell", F.floor(F.col("phase") / 30))
    near = e.select("user_id", F.col("event_id").alias("other"), F.col("phase").alias("p"), F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.pmod(F.col("cell") + k, F.lit(120)))).alias("cell"))
    d = F.abs(F.pmod(F.col("phase") - F.col("p") + 1800, F.lit(3600)) - 1800)
    return e.join(near, ["user_id", "cell"]).where((F.col("event_id") != F.col("other")) & (d < 30)).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_near"))


@query("SELECT b.item_id, a.source, count(*) AS n, sum(a.n_chars) AS total FROM documents a JOIN benchmark b ON a.doc_id % 40 = b.item_id GROUP BY b.item_id, a.source HAVING count(*) > 1", longs=("total",))
def jn_mapped_channel(t: Tables) -> DataFrame:
    """Rows joined through a mapping of channels."""
    a = t.documents.select((F.col("doc_id") % 40).alias("item_id"), "source", "n_chars")
    return a.join(t.benchmark.select("item_id"), "item_id").groupBy("item_id", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total")).where("n > 1")


@query("WITH a AS (SELECT lang, source, round(avg(n_chars), 6) AS m FROM documents GROUP BY lang, source) SELECT x.lang, x.source AS a, y.source AS b, round(x.m - y.m, 4) AS diff FROM a x JOIN a y ON x.lang = y.lang AND x.source > y.source")
def jn_all_pairs_of_systems(t: Tables) -> DataFrame:
    """Every two systems of a language compared; there are few systems, whatever the rows."""
    a = t.documents.groupBy("lang", "source").agg(F.round(F.avg("n_chars"), 6).alias("m"))
    b = a.select("lang", F.col("source").alias("b"), F.col("m").alias("mb"))
    return a.join(b, "lang").where(F.col("source") > F.col("b")).select("lang", F.col("source").alias("a"), "b", F.round(F.col("m") - F.col("mb"), 4).alias("diff"))


@query(
    """WITH r AS (SELECT lang, source, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS i FROM documents)
    SELECT lang, source, max(doc_id) FILTER (WHERE i = 1) AS winner, max(n_chars) FILTER (WHERE i = 1) AS best, max(n_chars) FILTER (WHERE i = 2) AS second, max(n_chars) FILTER (WHERE i = 2) - max(n_chars) FILTER (WHERE i = 1) AS margin FROM r GROUP BY lang, source"""
)
def srt_winner_and_margin(t: Tables) -> DataFrame:
    return R.winners(t.documents, ["lang", "source"], [F.col("n_chars"), F.col("doc_id")], "doc_id", "n_chars")


@query(
    """WITH d AS (SELECT source AS contest, doc_id, n_chars AS nll, n_chars % 5 AS n_tok FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY nll, doc_id) AS i, row_number() OVER (PARTITION BY contest, n_tok ORDER BY nll, doc_id) AS j FROM d),
    w AS (SELECT contest, max(doc_id) FILTER (WHERE i = 1) AS winner, max(nll) FILTER (WHERE i = 1) AS best, max(n_tok) FILTER (WHERE i = 1) AS tok, max(n_tok) FILTER (WHERE i = 2) AS tok2 FROM r GROUP BY contest)
    SELECT w.contest, w.winner, r.nll - w.best AS fair_margin, coalesce(w.tok <> w.tok2, FALSE) AS length_confounded, coalesce(r.nll - w.best > 1.4, FALSE) AS decidable FROM w LEFT JOIN r ON r.contest = w.contest AND r.n_tok = w.tok AND r.j = 2"""
)
def srt_length_fair_contest(t: Tables) -> DataFrame:
    """Margins count only between hypotheses of equal length; a runner-up of other length is flagged."""
    d = t.documents.select(F.col("source").alias("contest"), "doc_id", F.col("n_chars").alias("nll"), (F.col("n_chars") % 5).alias("n_tok"))
    by = lambda *k: F.row_number().over(W.partitionBy(*k).orderBy("nll", "doc_id"))
    r = d.withColumn("i", by("contest")).withColumn("j", by("contest", "n_tok"))
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    w = r.groupBy("contest").agg(pick("doc_id", 1).alias("winner"), pick("nll", 1).alias("best"), pick("n_tok", 1).alias("n_tok"), pick("n_tok", 2).alias("tok2"))
    second = r.where("j = 2").select("contest", "n_tok", "nll")
    margin = F.col("nll") - F.col("best")
    return w.join(second, ["contest", "n_tok"], "left").select("contest", "winner", margin.alias("fair_margin"), F.coalesce(F.col("n_tok") != F.col("tok2"), F.lit(False)).alias("length_confounded"), F.coalesce(margin > 1.4, F.lit(False)).alias("decidable"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def srt_n_best(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).cast("long").alias("r")).where("r <= 3")


@query(
    """WITH s AS (SELECT source AS system, avg(CASE WHEN n_chars % 2 = 0 THEN 1.0 ELSE 0.0 END) AS num, avg(CASE WHEN n_chars % 3 = 0 THEN 1.0 ELSE 0.0 END) AS term, avg(n_chars % 100) / 100 AS chrf FROM documents GROUP BY source)
    SELECT system, round(2 * num + term + chrf, 9) AS total FROM s ORDER BY (num = 1 AND term = 1 AND system LIKE 'src1%') DESC, round(2 * num + term + chrf, 9) DESC, system LIMIT 1"""
)
def srt_system_election(t: Tables) -> DataFrame:
    """A perfect preferred system, else the greatest combined score."""
    part = lambda k: F.avg((F.col("n_chars") % k == 0).cast("double"))
    s = t.documents.groupBy(F.col("source").alias("system")).agg(part(2).alias("num"), part(3).alias("term"), (F.avg(F.col("n_chars") % 100) / 100).alias("chrf"))
    total = F.round(2 * F.col("num") + F.col("term") + F.col("chrf"), 9)
    perfect = (F.col("num") == 1) & (F.col("term") == 1) & F.col("system").startswith("src1")
    return s.orderBy(F.desc(perfect), F.desc(total), "system").limit(1).select("system", total.alias("total"))


@query("SELECT source, lang, coalesce(max(l.quality), 9) AS key, row_number() OVER (PARTITION BY lang ORDER BY coalesce(max(l.quality), 9), count(*) DESC, source) AS place FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source, lang")
def srt_leaderboard(t: Tables) -> DataFrame:
    """Places by a key where a missing one sorts last."""
    g = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left").groupBy("source", "lang").agg(F.coalesce(F.max("quality"), F.lit(9)).alias("key"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("key", F.desc("n"), "source"))
    return g.select("source", "lang", "key", place.cast("long").alias("place"))


@query(
    """WITH a AS (SELECT conv_id, turn, t, row_number() OVER (PARTITION BY conv_id, turn, t ORDER BY i) AS k, i FROM (SELECT conv_id, turn, unnest(%s) AS t, generate_subscripts(%s, 1) AS i FROM (SELECT conv_id, turn, text FROM conversations WHERE turn > 0))),
    b AS (SELECT conv_id, turn, t, row_number() OVER (PARTITION BY conv_id, turn, t ORDER BY i) AS k FROM (SELECT conv_id, turn + 1 AS turn, unnest(%s) AS t, generate_subscripts(%s, 1) AS i FROM conversations))
    SELECT a.conv_id, a.turn, count(*) AS n_left, string_agg(a.t, ' ' ORDER BY a.i) AS tokens FROM a ANTI JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.t = b.t AND a.k = b.k GROUP BY a.conv_id, a.turn"""
    % ((TOKENS.format("text"),) * 4)
)
def set_multiset_difference(t: Tables) -> DataFrame:
    """Tokens of a turn that the turn before does not cover, each as often as it is left over, in order."""
    toks = t.conversations.select("conv_id", "turn", F.posexplode(T.tokens(F.col("text"))).alias("i", "t"))
    toks = toks.withColumn("k", F.row_number().over(W.partitionBy("conv_id", "turn", "t").orderBy("i")))
    before = toks.select("conv_id", (F.col("turn") + 1).alias("turn"), "t", "k")
    left = toks.where("turn > 0").join(before, ["conv_id", "turn", "t", "k"], "left_anti")
    return left.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_left"), F.array_join(F.sort_array(F.collect_list(F.struct("i", "t")))["t"], " ").alias("tokens"))


@query(
    """WITH v AS (SELECT source, lang, CASE WHEN n_chars % 2 = 0 THEN 'x' ELSE 'y' END AS winner FROM documents), w AS (SELECT source, lang, mode_w FROM (SELECT source, lang, winner AS mode_w, row_number() OVER (PARTITION BY source, lang ORDER BY count(*) DESC, winner) AS r FROM v GROUP BY source, lang, winner) WHERE r = 1)
    SELECT source, CASE WHEN count(DISTINCT mode_w) = 1 THEN min(mode_w) ELSE 'CONFLICT' END AS verdict, count(*) AS witnesses FROM w GROUP BY source"""
)
def set_witness_agreement(t: Tables) -> DataFrame:
    """Each witness's majority; they must agree."""
    v = t.documents.select("source", "lang", F.when(F.col("n_chars") % 2 == 0, "x").otherwise("y").alias("winner")).groupBy("source", "lang", "winner").count()
    w = v.withColumn("r", F.row_number().over(W.partitionBy("source", "lang").orderBy(F.desc("count"), "winner"))).where("r = 1")
    return w.groupBy("source").agg(F.when(F.count_distinct("winner") == 1, F.min("winner")).otherwise("CONFLICT").alias("verdict"), F.count(F.lit(1)).alias("witnesses"))


SCORES = "SELECT CAST(round(n_chars / 50.0) AS BIGINT) AS score, l.quality AS target FROM documents d JOIN labels l USING (doc_id)"


def _scores(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.round(F.col("n_chars") / 50.0).cast("long").alias("score"))
    return d.join(t.labels.select("doc_id", F.col("quality").alias("target")), "doc_id")


def _curve(t: Tables) -> DataFrame:
    """Cumulative counts over the distinct scores, by buckets of scores, and the totals."""
    c = R.binned_counts(_scores(t), F.col("score"), F.col("target") == 1)
    return R.running_totals(c, "score", F.floor(F.col("score") / 256), {"pos": ("fn", "p"), "neg": ("tn", "n")})


@query(
    f"""WITH c AS (SELECT score, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target = 0) AS neg FROM ({SCORES}) GROUP BY score),
    k AS (SELECT score, sum(pos) OVER (ORDER BY score) - pos AS miss, sum(neg) OVER (ORDER BY score) - neg AS rej, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c)
    SELECT score AS threshold, round((miss / p + 1 - rej / n) / 2, 9) AS eer FROM k ORDER BY abs(miss / p - (1 - rej / n)), score DESC LIMIT 1"""
)
def met_equal_error_rate(t: Tables) -> DataFrame:
    """Mean of both error rates where they lie closest."""
    c = _curve(t).select("score", ((F.col("fn") - F.col("pos")) / F.col("p")).alias("fnr"), (1 - (F.col("tn") - F.col("neg")) / F.col("n")).alias("fpr"))
    return c.orderBy(F.abs(F.col("fnr") - F.col("fpr")), F.desc("score")).limit(1).select(F.col("score").alias("threshold"), F.round((F.col("fnr") + F.col("fpr")) / 2, 9).alias("eer"))


@query(
    f"""WITH c AS (SELECT score, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target = 0) AS neg FROM ({SCORES}) GROUP BY score),
    k AS (SELECT score, sum(pos) OVER (ORDER BY score) AS miss, sum(neg) OVER (ORDER BY score) AS rej, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c)
    SELECT score AS threshold, round((1.0 * miss / p * 0.05 + 1.0 * (1 - rej / n) * 0.95) / 0.05, 9) AS min_dcf FROM k ORDER BY round(miss / p * 0.05 + (1 - rej / n) * 0.95, 12), score LIMIT 1"""
)
def met_min_detection_cost(t: Tables) -> DataFrame:
    """The least weighted cost over thresholds, normalised."""
    cost = F.col("fn") / F.col("p") * 0.05 + (1 - F.col("tn") / F.col("n")) * 0.95
    return _curve(t).withColumn("cost", cost).orderBy(F.round("cost", 12), "score").limit(1).select(F.col("score").alias("threshold"), F.round(F.col("cost") / 0.05, 9).alias("min_dcf"))


@query(
    f"""WITH s AS (SELECT least(score, 100) / 100.0 AS confi, target FROM ({SCORES})), th AS (SELECT k, k / 20.0 AS th FROM range(0, 21) t(k))
    SELECT th AS threshold, round(count(*) FILTER (WHERE target = 1 AND confi >= th) / greatest(count(*) FILTER (WHERE target = 1), 1), 9) AS detect_rate, round(greatest(count(*) FILTER (WHERE target = 0 AND confi >= th), 1e-6) / 2.5, 9) AS alarms_per_hour FROM s, th GROUP BY th"""
)
def met_det_curve(t: Tables) -> DataFrame:
    """Detection rate and alarms per hour at 21 thresholds: scores are counted by step first, then summed."""
    s = _scores(t).select(F.least(F.floor(F.least("score", F.lit(100).cast("long")) / 5), F.lit(20)).alias("step"), "target")
    c = s.groupBy("step").agg(F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg"))
    grid = t.spark.range(21).select(F.col("id").alias("step"))
    c = grid.join(c, "step", "left").na.fill(0)
    down, every = W.partitionBy(F.lit(0)).orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(F.lit(0))
    hit, alarms = F.sum("pos").over(down), F.sum("neg").over(down)
    return c.select((F.col("step") / 20).alias("threshold"), F.round(hit / F.greatest(F.sum("pos").over(every), F.lit(1).cast("long")), 9).alias("detect_rate"), F.round(F.greatest(alarms.cast("double"), F.lit(1e-6)) / 2.5, 9).alias("alarms_per_hour"))


@query("SELECT source, round(sum(n_chars) / 1000.0 / greatest(count(*), 1), 6) AS rtf, CASE WHEN sum(n_chars) / 1000.0 / count(*) < 1.5 THEN 'fast' ELSE 'slow' END AS grade FROM documents GROUP BY source")
def met_real_time_factor(t: Tables) -> DataFrame:
    g = t.documents.groupBy("source").agg((F.sum("n_chars") / 1000.0).alias("wall"), F.count(F.lit(1)).alias("dur"))
    rtf = F.col("wall") / F.greatest("dur", F.lit(1).cast("long"))
    return g.select("source", F.round(rtf, 6).alias("rtf"), F.when(rtf < 1.5, "fast").otherwise("slow").alias("grade"))


@query(
    """WITH l AS (SELECT source, doc_id, n_chars, coalesce(lead(n_chars) OVER w, first_value(n_chars) OVER w) AS wrong FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT source, round(avg(wrong - n_chars), 6) AS delta, count(*) FILTER (WHERE wrong > n_chars) AS wins, count(*) AS n FROM l GROUP BY source"""
)
def met_position_test(t: Tables) -> DataFrame:
    """Each line at its own anchor against the next line's, in a circle."""
    w = W.partitionBy("source").orderBy("doc_id")
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = t.documents.select("source", "n_chars", F.coalesce(F.lead("n_chars").over(w), F.first("n_chars").over(every)).alias("wrong"))
    return rows.groupBy("source").agg(F.round(F.avg(F.col("wrong") - F.col("n_chars")), 6).alias("delta"), F.count_if(F.col("wrong") > F.col("n_chars")).alias("wins"), F.count(F.lit(1)).alias("n"))


@query("WITH b AS (SELECT lang, avg(n_chars) AS base FROM documents GROUP BY lang) SELECT doc_id, round(base - n_chars, 6) AS delta FROM documents JOIN b USING (lang)")
def met_delta_to_baseline(t: Tables) -> DataFrame:
    b = t.documents.groupBy("lang").agg(F.avg("n_chars").alias("base"))
    return t.documents.join(b, "lang").select("doc_id", F.round(F.col("base") - F.col("n_chars"), 6).alias("delta"))


@query("SELECT lang, every FROM (SELECT lang, bool_and(m > 1.02) AS every FROM (SELECT lang, source, avg(n_chars) / 1000.0 AS m FROM documents GROUP BY lang, source) GROUP BY lang)")
def flt_adoption_rule(t: Tables) -> DataFrame:
    """Adopted only if every group improves by more than 2%."""
    g = t.documents.groupBy("lang", "source").agg((F.avg("n_chars") / 1000.0).alias("m"))
    return g.groupBy("lang").agg(F.every(F.col("m") > 1.02).alias("every"))
