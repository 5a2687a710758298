"""Queries over spoken and written numbers and over audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import numbers as N
from tidewater.functions import terms as K
from tidewater.functions import text as T
from tidewater.plans.base import Tables, query


def _lines(t: Tables) -> DataFrame:
    """Each event's value read out in English, and written in Chinese (every seventh wrongly)."""
    said = F.upper(T.spoken_digits(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(" decimal "))))
    wrong = F.col("event_id") % 7 == 0
    written = F.concat(F.lit("风"), F.when(wrong, F.lit("零下")).otherwise(F.lit("")), F.col("value").cast("string"), F.lit("度"))
    return t.events.select("event_id", "event_type", F.concat(F.lit("WIND "), said, F.lit(" AT")).alias("en"), written.alias("zh"))


@query("SELECT event_id, replace(CAST(value AS VARCHAR), '.', '') AS en_payload, CASE WHEN event_id % 7 = 0 THEN '-' ELSE '' END || replace(CAST(value AS VARCHAR), '.', '') AS zh_payload, event_id % 7 <> 0 AS faithful FROM events")
def num_payloads(t: Tables) -> DataFrame:
    """Numbers of both sides as comparable strings."""
    p = _lines(t).select("event_id", N.english_payload("en").alias("a"), N.chinese_payload("zh").alias("b"))
    return p.select("event_id", F.array_join("a", ",").alias("en_payload"), F.array_join("b", ",").alias("zh_payload"), (F.col("a") == F.col("b")).alias("faithful"))


@query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN event_id % 7 <> 0 THEN 1.0 ELSE 0.0 END), 9) AS fidelity FROM events GROUP BY event_type")
def num_fidelity(t: Tables) -> DataFrame:
    """Share of lines whose number sequences agree."""
    p = _lines(t).select("event_type", (N.english_payload("en") == N.chinese_payload("zh")).cast("double").alias("ok"))
    return p.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ok"), 9).alias("fidelity"))


def pattern_lines(t: Tables) -> DataFrame:
    """A broadcast line of one of nine kinds, or of none, from each event."""
    n = lambda c: F.upper(T.spoken_digits(c.cast("string")))
    two = lambda c: n(F.lpad((c % 100).cast("string"), 2, "0"))
    e, u = F.col("event_id"), F.col("user_id")
    letter = F.element_at(F.array(*[F.lit(x) for x in ("FOXTROT", "ALFA", "GOLF", "ECHO")]), (e % 4 + 1).cast("int"))
    kinds = [
        F.concat_ws(" ", F.lit("saint johns INFORMATION"), letter, F.lit("WEATHER AT"), two(e), two(u), F.lit("ZULU")),
        F.concat_ws(" ", F.lit("WIND  TWO"), two(e), F.lit("AT"), two(u)),
        F.concat_ws(" ", F.lit("VISIBILITY"), two(u), F.when(e % 3 == 0, two(e)).otherwise(n(e % 10)), F.lit("THOUSAND FEET")),
        F.concat_ws(" ", F.lit("TEMPERATURE"), two(e), F.lit("DEW POINT MINUS"), n(u % 10)),
        F.concat_ws(" ", F.lit("ALTIMETER TWO NINE"), F.when(e % 4 == 0, n(u % 10)).otherwise(two(u))),
        F.concat_ws(" ", F.lit("APPROACH RNAV ZULU RUNWAY"), F.when(e % 4 == 1, n(u % 10)).otherwise(two(e))),
        F.concat_ws(" ", F.lit("INFORM GANDER CENTER ON FREQUENCY ONE"), two(e), F.lit("DECIMAL"), two(u), F.when(u % 2 == 0, "AS REQUESTED").otherwise("WHEN REQUESTED")),
        F.concat_ws(" ", F.lit("APPROACH ON INITIAL CONTACT LANDING AND DEPARTING RUNWAY"), two(u)),
        F.concat_ws(" ", F.lit("INFORM ATC THAT YOU HAVE INFORMATION"), letter),
        F.concat_ws(" ", F.lit("GOOD DAY"), two(e)),
    ]
    line = F.element_at(F.array(*kinds), (e % 10 + 1).cast("int"))
    return t.events.select("event_id", "user_id", line.alias("en"))


@query()
def num_template_rendering(t: Tables) -> DataFrame:
    """The first of nine patterns that a line fits gives its rendering; none gives null."""
    return pattern_lines(t).select("event_id", "en", K.rendered(F.col("en")).alias("rendered"))


def _audited(t: Tables) -> DataFrame:
    """Lines with renderings, a third of which lost a word, and their audited terms."""
    zh = K.rendered(F.col("en"))
    lossy = F.when(F.col("event_id") % 3 == 0, F.regexp_replace(zh, "风|跑道|频率|气象|海压|零下|信息", "")).otherwise(zh)
    rows = pattern_lines(t).select("event_id", "user_id", "en", lossy.alias("zh"))
    return rows.withColumn("terms", K.audited(F.col("en"), F.coalesce("zh", F.lit(""))))


@query()
def num_term_audit(t: Tables) -> DataFrame:
    """How many of 22 terms lines have and renderings keep, by user; null where no term applies."""
    n = lambda x: F.sum(F.size(x))
    g = _audited(t).groupBy("user_id").agg(n("terms").alias("total"), n(F.filter("terms", lambda x: x["kept"])).alias("hits"))
    return g.withColumn("hit_rate", F.round(F.col("hits") / F.nullif(F.col("total"), F.lit(0)), 9))


@query()
def num_term_suggestions(t: Tables) -> DataFrame:
    """The usual rendering of each term that a line's rendering misses; the rendering itself is left as it is."""
    missed = _audited(t).select("event_id", "zh", F.explode(F.filter("terms", lambda x: ~x["kept"])).alias("x"))
    return missed.select("event_id", F.col("x.said").alias("term"), F.col("x.wanted").alias("suggestion"), F.col("zh").alias("current"))


@query(
    """WITH p AS (SELECT doc_id, n_chars % 3 AS o1, n_chars % 2 AS o2, (n_chars // 3) % 3 AS n1, (n_chars // 2) % 2 AS n2 FROM documents)
    SELECT doc_id, n1 <= o1 AND n2 <= o2 AND (n1 < o1 OR n2 < o2) AS accepted FROM p"""
)
def num_strict_improvement(t: Tables) -> DataFrame:
    """A retry is taken only if it is better in one count and worse in none."""
    c = lambda d, k: F.floor(F.col("n_chars") / d) % k
    return t.documents.select("doc_id", N.accept_if_better((c(1, 3), c(1, 2)), (c(3, 3), c(2, 2))).alias("accepted"))


@query("SELECT user_id, round_, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS accepted FROM (SELECT user_id, event_type, event_id % 3 AS round_ FROM events) GROUP BY ALL")
def agg_retry_stats(t: Tables) -> DataFrame:
    """Attempts and acceptances by round."""
    return t.events.groupBy("user_id", (F.col("event_id") % 3).alias("round_")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("accepted"))
