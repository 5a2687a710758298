"""Streaming queries, drained over the files at hand, and the batch forms of their operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions.times import micros
from tidewater.plans.base import Tables, query
from tidewater.streaming import runs, sessions
from tidewater.streaming.machines import Machine, run_batch, run_stream

RULE = sessions.Rule(silence=3, shortest=2, longest=8)


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.timestamp_micros(micros("ts")))


@query("SELECT epoch_us(ts) // 86400000000 AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stm_tumbling(t: Tables) -> DataFrame:
    """Counts and sums by day as a stream."""
    s = _stamped(runs.stream_table(t.spark, t.sf_dir, "events")).withWatermark("at", "1 day")
    g = s.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return runs.run_to_table(g, "tumbling", "complete").select(F.floor(F.unix_seconds("w.start") / 86400).alias("day"), "event_type", "n", "total")


@query(
    """WITH w AS (SELECT value, unnest([epoch_us(ts) // 10800000000 * 3, epoch_us(ts) // 10800000000 * 3 - 3]) AS h FROM events) SELECT h AS start_hour, count(*) AS n, round(max(value), 4) AS top FROM w GROUP BY h"""
)
def stm_sliding(t: Tables) -> DataFrame:
    """Windows of six hours that slide by three."""
    s = _stamped(runs.stream_table(t.spark, t.sf_dir, "events")).withWatermark("at", "1 day")
    g = s.groupBy(F.window("at", "6 hours", "3 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("top"))
    return runs.run_to_table(g, "sliding", "complete").select(F.floor(F.unix_seconds("w.start") / 3600).alias("start_hour"), "n", "top")


@query(
    """WITH d AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events),
    g AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS g FROM d) SELECT user_id, min(us) AS begin, max(us) + 21600000000 AS stop, count(*) AS n FROM g GROUP BY user_id, g"""
)
def stm_sessions(t: Tables) -> DataFrame:
    """Sessions that a pause of six hours ends, as a stream."""
    s = _stamped(runs.stream_table(t.spark, t.sf_dir, "events")).withWatermark("at", "30 days")
    g = s.groupBy(F.session_window("at", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    out = runs.run_to_table(g, "sessions", "complete")
    return out.select("user_id", F.unix_micros("w.start").alias("begin"), F.unix_micros("w.end").alias("stop"), "n")


@query("SELECT event_type, user_id FROM events GROUP BY event_type, user_id")
def stm_deduplicate(t: Tables) -> DataFrame:
    """First occurrences within the watermark."""
    s = _stamped(runs.stream_table(t.spark, t.sf_dir, "events")).withWatermark("at", "60 days")
    return runs.run_to_table(s.dropDuplicatesWithinWatermark(["event_type", "user_id"]).select("event_type", "user_id"), "dedup")


#: A session ends after a day of quiet.
QUIET = 86_400_000_000


def _voiced(events: DataFrame) -> DataFrame:
    """Events (with their time us) as frames of their users' sessions, in the order of time and id."""
    return events.select("user_id", "us", "event_id", (F.col("value") > 30).alias("voiced"), F.least(F.col("value") / 100, F.lit(1.0)).alias("chance"), (F.col("event_type") == "purchase").alias("command"))


#: The frames in SQL: u is a user's session, w4 and w6 count the voiced ones of its last four and six.
_FRAMES = """g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN value > 30 THEN 1 ELSE 0 END AS v, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 86400000000 THEN 0 ELSE 1 END AS new FROM events)),
    f AS (SELECT user_id, user_id * 100000 + s AS u, row_number() OVER w - 1 AS pos, v, value, least(value / 100, 1.0) AS p, event_type = 'purchase' AS c, event_type,
    sum(v) OVER (PARTITION BY user_id, s ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS w4, sum(v) OVER (PARTITION BY user_id, s ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS w6
    FROM g WINDOW w AS (PARTITION BY user_id, s ORDER BY ts, event_id)), n AS (SELECT u, count(*) AS n FROM f GROUP BY u)"""


def _walked(state: dict[str, tuple[str, str, str]], made: dict[str, str], out: str, rest: str = "") -> str:
    """SQL of a machine: state, by name, with type, start and next value; what a frame makes, from the state before it
    (s_*); the rows given; the rows of sessions that end (`r` is then the state after their last frame)."""
    start = ", ".join(f"CAST({first} AS {kind}) AS s_{c}" for c, (kind, first, _) in state.items())
    new = ", ".join(f"CAST({then} AS {kind}) AS s_{c}" for c, (kind, _, then) in state.items())
    columns = ", ".join(f"s_{c}" for c in state)
    made_now = ", ".join(f"{x} AS {c}" for c, x in made.items())
    before = ", ".join(f"s_{c} AS b_{c}" for c in state)
    kept = ", ".join(f"b_{c}" for c in state)
    none = ", ".join(f"CAST(NULL AS BIGINT) AS b_{c}" for c in state)
    ends = f" UNION ALL {rest}" if rest else ""
    return f"""WITH RECURSIVE {_FRAMES}, r AS (SELECT DISTINCT u, user_id, -1::BIGINT AS pos, {start}, {none}, {', '.join(f"CAST(NULL AS VARCHAR) AS {c}" for c in made)} FROM f UNION ALL
    SELECT u, user_id, pos, {new}, {kept}, {', '.join(f"CAST({c} AS VARCHAR) AS {c}" for c in made)} FROM (SELECT *, {before} FROM (SELECT *, {made_now} FROM (SELECT f.*, {columns} FROM r JOIN f ON f.u = r.u AND f.pos = r.pos + 1))))
    {out}{ends}"""


_ENDPOINTS = _walked(
    {"start": ("BIGINT", "-1", "CASE WHEN s_start >= 0 AND reason IS NULL THEN s_start WHEN v = 1 THEN pos ELSE -1 END"), "quiet": ("BIGINT", "0", "CASE WHEN s_start >= 0 AND reason IS NULL AND v = 0 THEN s_quiet + 1 ELSE 0 END")},
    {"reason": "CASE WHEN s_start < 0 THEN NULL WHEN v = 1 THEN CASE WHEN pos - s_start - s_quiet >= 8 THEN 'max_utt' END WHEN s_quiet + 1 >= 3 AND pos - s_start - s_quiet >= 2 THEN 'endpoint' WHEN pos - s_start - s_quiet >= 8 THEN 'max_utt_after_silence' WHEN s_quiet + 1 >= 3 THEN 'noise_gate' END", "q": "CASE WHEN v = 1 THEN 0 ELSE s_quiet + 1 END"},
    "SELECT user_id, CASE WHEN reason = 'noise_gate' THEN 'drop_short' ELSE 'finalize' END AS kind, b_start AS start, pos - CAST(q AS BIGINT) AS stop, reason FROM r WHERE reason IS NOT NULL",
)
_GATES = _walked({"open": ("BIGINT", "0", "CASE change WHEN 'open' THEN 1 WHEN 'close' THEN 0 ELSE s_open END")}, {"change": "CASE WHEN s_open = 0 AND w6 >= 5 THEN 'open' WHEN s_open = 1 AND w6 <= 2 THEN 'close' END"}, "SELECT user_id, pos AS frame, change FROM r WHERE change IS NOT NULL")
_DETECTED = _walked(
    {
        "start": ("BIGINT", "-1", "CASE reason WHEN 'silence' THEN -1 WHEN 'longest' THEN pos + 1 ELSE CASE WHEN s_start < 0 AND w4 >= 3 THEN greatest(s_ended, pos - 4, 0) ELSE s_start END END"),
        "ended": ("BIGINT", "0", "CASE reason WHEN 'silence' THEN greatest(s_start + 1, least(pos - 2 + w4, pos + 1)) WHEN 'longest' THEN pos + 1 ELSE s_ended END"),
    },
    {"reason": "CASE WHEN s_start >= 0 AND w4 <= 1 THEN 'silence' WHEN s_start >= 0 AND pos + 1 - s_start >= 12 THEN 'longest' END"},
    "SELECT user_id, b_start AS start, s_ended AS stop, reason FROM r WHERE reason IS NOT NULL",
    "SELECT user_id, s_start, n, 'end' FROM r JOIN n USING (u) WHERE pos = n - 1 AND s_start BETWEEN 0 AND n - 1",
)
_SPANS = _walked(
    {
        "begin": ("BIGINT", "-1", "CASE WHEN p >= 0.5 AND s_begin < 0 THEN pos WHEN cut IS NOT NULL THEN -1 ELSE s_begin END"),
        "low": ("BIGINT", "-1", "CASE WHEN p >= 0.5 OR cut IS NOT NULL THEN -1 WHEN p < 0.35 AND s_begin >= 0 AND s_low < 0 THEN pos ELSE s_low END"),
    },
    {"cut": "CASE WHEN p < 0.35 AND s_begin >= 0 AND s_low >= 0 AND pos - s_low >= 2 THEN s_low END"},
    "SELECT user_id, greatest(0, b_begin - 1) AS begin, CAST(cut AS BIGINT) + 1 AS stop FROM r WHERE cut IS NOT NULL",
    "SELECT user_id, greatest(0, s_begin - 1), n FROM r JOIN n USING (u) WHERE pos = n - 1 AND s_begin >= 0",
)
_CHUNKS = _walked(
    {
        "sent": ("BIGINT", "0", "CASE WHEN final IS NOT NULL THEN pos + 1 WHEN s_on = 0 AND v = 1 THEN greatest(s_sent, pos - 5) ELSE s_sent END"),
        "on": ("BIGINT", "0", "CASE WHEN final = 1 THEN 0 WHEN v = 1 THEN 1 ELSE s_on END"),
        "low": ("BIGINT", "0", "CASE WHEN s_on = 0 OR v = 1 OR final = 1 THEN 0 ELSE s_low + 1 END"),
    },
    {"final": "CASE WHEN s_on = 0 THEN NULL WHEN v = 0 AND s_low + 1 >= 3 THEN 1 WHEN pos + 1 - s_sent >= 5 THEN 0 END"},
    "SELECT user_id, b_sent AS begin, pos + 1 AS stop, final = '1' AS final FROM r WHERE final IS NOT NULL",
    "SELECT user_id, s_sent, n, TRUE FROM r JOIN n USING (u) WHERE pos = n - 1 AND s_on = 1 AND s_sent < n",
)
_COMMANDED = _walked(
    {"begin": ("BIGINT", "0", "CASE WHEN reason IS NULL THEN s_begin ELSE pos + 1 END")},
    {"reason": "CASE WHEN c THEN 'command' WHEN pos + 1 - s_begin >= 40 THEN 'longest' END"},
    "SELECT user_id, b_begin AS begin, pos + 1 AS stop, reason FROM r WHERE reason IS NOT NULL",
    "SELECT user_id, s_begin, n, 'end' FROM r JOIN n USING (u) WHERE pos = n - 1 AND s_begin < n",
)

ORDER = ["us", "event_id"]


def _in_batch(t: Tables, machine: Machine, flush: bool = True) -> DataFrame:
    return run_batch(_voiced(t.events.withColumn("us", micros("ts"))), "user_id", ORDER, machine, flush, QUIET)


def _in_stream(t: Tables, machine: Machine, name: str) -> DataFrame:
    source = runs.session_stream(t.spark, t.sf_dir, "events", micros("ts"), _voiced)
    return runs.run_sessions(source, "user_id", ORDER, machine, QUIET, name).table


@query(_ENDPOINTS)
def stm_endpointing(t: Tables) -> DataFrame:
    """Utterances that quiet or length ends, by a stateful stream."""
    return _in_stream(t, sessions.endpointing(RULE), "endpoints")


@query(_ENDPOINTS)
def stm_endpointing_batch(t: Tables) -> DataFrame:
    """The same in one batch."""
    return _in_batch(t, sessions.endpointing(RULE))


GATE = sessions.Gate(6, 5, 2)


@query(_GATES)
def stm_hysteresis(t: Tables) -> DataFrame:
    """Gates that a share of voiced frames opens and a smaller one closes."""
    return _in_batch(t, sessions.gating(GATE))


@query(_GATES)
def stm_hysteresis_stream(t: Tables) -> DataFrame:
    """The same by a stateful stream."""
    return _in_stream(t, sessions.gating(GATE), "gates")


DETECTOR = sessions.Detector(width=4, to_speech=3, to_silence=1, back=1, ahead=1, longest=12)


@query(_DETECTED)
def stm_detector(t: Tables) -> DataFrame:
    """Segments of speech with what lies before and after them, cut at the longest length."""
    return _in_batch(t, sessions.detecting(DETECTOR))


@query(_DETECTED)
def stm_detector_stream(t: Tables) -> DataFrame:
    """The same by a stateful stream."""
    return _in_stream(t, sessions.detecting(DETECTOR), "detected")


THRESHOLD = sessions.Threshold(0.5, 0.35, 2, 1)


@query(_SPANS)
def stm_threshold_gate(t: Tables) -> DataFrame:
    """Spans of speech by two thresholds and a pause."""
    return _in_batch(t, sessions.thresholding(THRESHOLD))


@query(_SPANS)
def stm_threshold_gate_stream(t: Tables) -> DataFrame:
    """The same by a stateful stream."""
    return _in_stream(t, sessions.thresholding(THRESHOLD), "spans")


@query(_CHUNKS)
def stm_voice_controller(t: Tables) -> DataFrame:
    """Chunks that a controller hands on while there is speech, from five frames before it."""
    return _in_batch(t, sessions.controlling(lookback=5, quiet=3))


@query(_COMMANDED)
def stm_client_endpoints(t: Tables) -> DataFrame:
    """Utterances that the client's commands end, by a stateful stream."""
    return _in_stream(t, sessions.commanded(longest=40), "commanded")


@query(
    f"""WITH {_FRAMES}, c AS (SELECT u, user_id, pos + 1 AS stop, coalesce(lag(pos + 1) OVER (PARTITION BY u ORDER BY pos), 0) AS begin FROM f WHERE c),
    l AS (SELECT u, user_id, max(pos) + 1 AS n, coalesce(max(CASE WHEN c THEN pos + 1 END), 0) AS begin FROM f GROUP BY u, user_id)
    SELECT user_id, begin, stop, 'command' AS reason FROM c UNION ALL SELECT user_id, begin, n, 'end' FROM l WHERE begin < n"""
)
def stm_client_endpoints_batch(t: Tables) -> DataFrame:
    """Utterances that the client's commands or the session's end close."""
    return _in_batch(t, sessions.commanded(longest=1 << 40))


_MS = "CAST(floor(value * 5) AS BIGINT)"
_DECODES = _walked(
    {"total": ("BIGINT", "0", f"s_total + {_MS}"), "last": ("BIGINT", "0", f"CASE WHEN due IS NOT NULL THEN s_total + {_MS} ELSE s_last END")},
    {"due": f"CASE WHEN CASE WHEN s_last > 0 THEN s_total + {_MS} - s_last >= 960 ELSE s_total + {_MS} >= 480 END THEN s_total + {_MS} END"},
    "SELECT user_id, CAST(due AS BIGINT) AS \"at\", CAST(due AS BIGINT) - b_last AS new FROM r WHERE due IS NOT NULL",
)


def _chunks(events: DataFrame) -> DataFrame:
    return events.select("user_id", "us", "event_id", F.floor(F.col("value") * 5).cast("long").alias("ms"))


@query(_DECODES)
def stm_decode_cadence(t: Tables) -> DataFrame:
    """Decodes of a session whose audio comes in chunks: the first after 480 ms, then one for each 960 ms that have come."""
    return run_batch(_chunks(t.events.withColumn("us", micros("ts"))), "user_id", ORDER, sessions.decoding(480, 960), quiet=QUIET)


@query(_DECODES)
def stm_decode_cadence_stream(t: Tables) -> DataFrame:
    """The same by a stateful stream."""
    source = runs.session_stream(t.spark, t.sf_dir, "events", micros("ts"), _chunks)
    return runs.run_sessions(source, "user_id", ORDER, sessions.decoding(480, 960), QUIET, "decodes").table


def _partials(t: Tables) -> DataFrame:
    """Growing partial texts of each turn: eight words more each time, the last word still cut short."""
    w = t.conversations.select("conv_id", "turn", F.split(T.squeeze(F.col("text")), " ").alias("w"))
    ends = F.sequence(F.lit(8), F.greatest(F.size("w") + 7, F.lit(8)), F.lit(8))
    p = w.select("conv_id", "turn", "w", F.posexplode(ends).alias("n", "end"))
    cut = F.transform(F.slice("w", F.lit(1), F.col("end")), lambda x, i: F.when((i == F.col("end") - 1) & (F.col("end") < F.size("w")), F.left(x, F.lit(1))).otherwise(x))
    return p.select((F.col("conv_id") * 1000 + F.col("turn")).alias("talk"), "n", cut.alias("words"))


@query()
def stm_stable_words(t: Tables) -> DataFrame:
    """Words of growing partial texts, at the partial that makes them final: two in a row agree up to there."""
    return run_batch(_partials(t), "talk", ["n"], sessions.committing(2))


@query()
def stm_confirmed_prefix(t: Tables) -> DataFrame:
    """What two hypotheses in a row agree on is confirmed; a buffer over 24 words drops its oldest confirmed ones."""
    return run_batch(_partials(t), "talk", ["n"], sessions.confirming(24))


@query()
def stm_two_tracks(t: Tables) -> DataFrame:
    """Growing partial texts as a final track, which only grows, and drafts that the next one replaces."""
    return run_batch(_partials(t), "talk", ["n"], sessions.two_tracks(2))


@query()
def stm_evicting_window(t: Tables) -> DataFrame:
    """A decode window of 120 tokens over the turns of each conversation, and the tokens that it gave up."""
    rows = t.conversations.select("conv_id", "turn", F.size(T.tokens(F.col("text"))).cast("long").alias("tokens"))
    return run_batch(rows, "conv_id", ["turn"], sessions.evicting(120))


@query()
def stm_online_speakers(t: Tables) -> DataFrame:
    """Speakers told apart as vectors come."""
    e = t.embeddings.select(F.floor(F.col("vec_id") / 125).alias("session"), F.col("vec_id").alias("name"), F.col("embedding").alias("vector"))
    rows = run_batch(e.withColumn("at", F.col("name")), "session", ["at"], sessions.tracking(least=0.2))
    return rows.select("session", F.col("name").alias("vec_id"), "speaker")


@query()
def stm_online_speakers_stream(t: Tables) -> DataFrame:
    """The same by a stateful stream; vectors come a second apart, the first after a second."""
    second = (F.col("vec_id") + 1) * 1_000_000
    shape = lambda e: e.select(F.floor(F.col("vec_id") / 125).alias("session"), "us", F.col("vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("vector"))
    source = runs.session_stream(t.spark, t.sf_dir, "embeddings", second, shape)
    out = runs.run_sessions(source, "session", ["us"], sessions.tracking(least=0.2), QUIET, "speakers").table
    return out.select("session", F.col("name").alias("vec_id"), "speaker")


@query(
    r"""WITH w AS (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS a, string_split(trim(regexp_replace(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '\s+', ' ', 'g')), ' ') AS b FROM conversations),
    e AS (SELECT conv_id, turn, list_transform(list_zip(a, list_concat(a[1:turn + 2], b)), lambda z: coalesce(z[1] = z[2], FALSE)) AS same FROM w WHERE b IS NOT NULL)
    SELECT conv_id, turn, coalesce(nullif(list_position(same, FALSE), 0) - 1, len(same)) AS n_common FROM e"""
)
def stm_common_prefix(t: Tables) -> DataFrame:
    """How many leading words two successive partial texts share: what may be committed.

    The later partial keeps the first words of a turn and goes on with the next turn's.
    """
    w = W.partitionBy("conv_id").orderBy("turn")
    words = lambda c: F.split(T.squeeze(c), " ")
    p = t.conversations.select("conv_id", "turn", words(F.col("text")).alias("a"), words(F.lead("text").over(w)).alias("next")).where("next IS NOT NULL")
    p = p.select("conv_id", "turn", "a", F.concat(F.slice("a", F.lit(1), (F.col("turn") + 2).cast("int")), "next").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return p.select("conv_id", "turn", F.when(at > 0, at - 1).otherwise(F.size(same)).cast("long").alias("n_common"))


@query(
    """WITH d AS (SELECT user_id, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n, CASE WHEN n > 60 THEN 'final' ELSE 'draft' END AS track FROM d"""
)
def stm_draft_and_final(t: Tables) -> DataFrame:
    """Counts in update mode become final once a session has enough events."""
    s = runs.stream_table(t.spark, t.sf_dir, "events")
    g = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.run_to_table(g, "tracks", "complete").select("user_id", "n", F.when(F.col("n") > 60, "final").otherwise("draft").alias("track"))


@query(
    """WITH q AS (SELECT user_id, event_id, epoch_us(ts) AS came, CAST(floor(value * 120000000) AS BIGINT) AS cost, sum(CAST(floor(value * 120000000) AS BIGINT)) OVER w AS upto FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT *, CAST(upto + max(came - (upto - cost)) OVER (PARTITION BY user_id ORDER BY came, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done FROM q) SELECT user_id, event_id, done AS emitted, done - came AS delay, done - cost - came AS waited FROM e"""
)
def stm_emission_clock(t: Tables) -> DataFrame:
    """When each event is emitted by one worker a user, who takes them in turn and works as long as their value says.

    An event is done its cost after it came or the one before was done, whichever is later: the costs so far, and the latest
    lead that any event so far had on the costs before it.
    """
    w = W.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(W.unboundedPreceding, 0)
    q = t.events.select("user_id", "event_id", micros("ts").alias("at"), F.floor(F.col("value") * 120_000_000).cast("long").alias("cost"))
    q = q.withColumn("upto", F.sum("cost").over(w))
    done = q.withColumn("done", F.col("upto") + F.max(F.col("at") - (F.col("upto") - F.col("cost"))).over(w))
    return done.select("user_id", "event_id", F.col("done").alias("emitted"), (F.col("done") - F.col("at")).alias("delay"), (F.col("done") - F.col("cost") - F.col("at")).alias("waited"))


SCHEDULE = sessions.Schedule(margin=900, follow=8, limits=(5, 10, 20), quiet=(4, 3, 2), last=1)
_LEVEL = "CAST(floor(value * 100) AS BIGINT)"
_ASKED = "CASE WHEN s_age + 1 <= 5 THEN 4 WHEN s_age + 1 <= 10 THEN 3 WHEN s_age + 1 <= 20 THEN 2 ELSE 1 END"
_LOUD = f"{_LEVEL} > s_floor + 900"
_SCHEDULED = _walked(
    {
        "start": ("BIGINT", "-1", f"CASE WHEN asked IS NOT NULL THEN -1 WHEN s_start < 0 AND {_LOUD} THEN pos ELSE s_start END"),
        "low": ("BIGINT", "0", f"CASE WHEN asked IS NOT NULL OR s_start < 0 OR {_LOUD} THEN 0 ELSE s_low + 1 END"),
        "age": ("BIGINT", "0", "CASE WHEN asked IS NOT NULL THEN 0 ELSE s_age + 1 END"),
        "floor": ("BIGINT", str(1 << 40), f"CASE WHEN {_LOUD} THEN s_floor WHEN {_LEVEL} < s_floor THEN {_LEVEL} ELSE s_floor + ({_LEVEL} - s_floor) // 8 END"),
    },
    {"asked": f"CASE WHEN s_start >= 0 AND NOT {_LOUD} AND s_low + 1 >= {_ASKED} THEN {_ASKED} END"},
    "SELECT user_id, b_start AS start, pos + 1 - (b_low + 1) AS stop, CAST(asked AS BIGINT) AS asked FROM r WHERE asked IS NOT NULL",
    "SELECT user_id, s_start, n - s_low, 0 FROM r JOIN n USING (u) WHERE pos = n - 1 AND s_start >= 0",
)


def _levels(events: DataFrame) -> DataFrame:
    return events.select("user_id", "us", "event_id", F.floor(F.col("value") * 100).cast("long").alias("level"))


@query(_SCHEDULED)
def stm_silence_schedule(t: Tables) -> DataFrame:
    """Segments over an adaptive noise floor; the quiet that ends one shrinks with the frames since the last cut."""
    return run_batch(_levels(t.events.withColumn("us", micros("ts"))), "user_id", ORDER, sessions.scheduled(SCHEDULE), quiet=QUIET)


@query(_SCHEDULED)
def stm_silence_schedule_stream(t: Tables) -> DataFrame:
    """The same by a stateful stream."""
    source = runs.session_stream(t.spark, t.sf_dir, "events", micros("ts"), _levels)
    return runs.run_sessions(source, "user_id", ORDER, sessions.scheduled(SCHEDULE), QUIET, "scheduled").table


def _commands(events: DataFrame) -> DataFrame:
    """Events as frames and commands: sign-ups start, errors stop, purchases commit, the strongest views and clicks set the language and the hot words."""
    strong = F.col("value") > 60
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "stop").when(F.col("event_type") == "purchase", "commit").when((F.col("event_type") == "view") & strong, "language").when((F.col("event_type") == "click") & strong, "hotwords").otherwise("frame")
    argument = F.when(strong & (F.col("event_type") == "view"), F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit(None)), (F.col("event_id") % 3 + 1).cast("int"))).when(strong & (F.col("event_type") == "click"), F.concat(F.lit("word"), (F.col("event_id") % 10).cast("string")))
    return events.select("user_id", "us", "event_id", kind.alias("kind"), argument.alias("argument"))


_CONTROL = """WITH RECURSIVE x AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 86400000000 THEN 0 ELSE 1 END AS new,
    CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'error' THEN 'stop' WHEN event_type = 'purchase' THEN 'commit' WHEN event_type = 'view' AND value > 60 THEN 'language' WHEN event_type = 'click' AND value > 60 THEN 'hotwords' ELSE 'frame' END AS kind FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM x),
    f AS (SELECT user_id, user_id * 100000 + s AS u, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS pos, kind, CASE kind WHEN 'language' THEN CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END WHEN 'hotwords' THEN 'word' || CAST(event_id % 10 AS VARCHAR) END AS arg FROM g),
    r AS (SELECT DISTINCT u, user_id, 0::BIGINT AS pos, FALSE AS listens, 0::BIGINT AS begin, 0::BIGINT AS frames, NULL::VARCHAR AS language, NULL::VARCHAR AS hotwords, NULL::VARCHAR AS kind, FALSE AS listened, 0::BIGINT AS b0, 0::BIGINT AS f0 FROM f UNION ALL
    SELECT f.u, f.user_id, f.pos, CASE f.kind WHEN 'start' THEN TRUE WHEN 'stop' THEN FALSE ELSE listens END,
    CASE WHEN f.kind = 'start' THEN 0 WHEN f.kind IN ('commit', 'stop') THEN frames ELSE begin END, CASE WHEN f.kind = 'start' THEN 0 WHEN f.kind = 'frame' AND listens THEN frames + 1 ELSE frames END,
    CASE WHEN f.kind = 'language' THEN arg ELSE language END, CASE WHEN f.kind = 'hotwords' THEN arg ELSE hotwords END, f.kind, listens, begin, frames FROM r JOIN f ON f.u = r.u AND f.pos = r.pos + 1)
    SELECT user_id, CASE kind WHEN 'start' THEN 'started' WHEN 'language' THEN 'language_set' WHEN 'hotwords' THEN 'hotwords_set' WHEN 'stop' THEN 'stopped' ELSE CASE WHEN listened THEN 'final' ELSE 'error' END END AS event, CASE WHEN kind = 'commit' THEN b0 ELSE begin END AS begin, frames AS stop, language, hotwords FROM r WHERE kind <> 'frame'
    UNION ALL SELECT user_id, 'final', b0, f0, language, hotwords FROM r WHERE kind = 'stop' AND listened AND f0 > b0"""


@query(_CONTROL)
def stm_session_commands(t: Tables) -> DataFrame:
    """What sessions answer to their clients' commands, and the frames that they hand on."""
    return run_batch(_commands(t.events.withColumn("us", micros("ts"))), "user_id", ORDER, sessions.controlled(), quiet=QUIET)


@query(_CONTROL)
def stm_session_commands_stream(t: Tables) -> DataFrame:
    """The same by a stateful stream."""
    source = runs.session_stream(t.spark, t.sf_dir, "events", micros("ts"), _commands)
    return runs.run_sessions(source, "user_id", ORDER, sessions.controlled(), QUIET, "commands").table
