"""Queries over utterances: experiments, batches with restored order, sentences, long words, repeats, decode rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import slots, udfs
from tidewater.functions import text as T
from tidewater.operators import clusters as C
from tidewater.operators import manifest as M
from tidewater.operators import series as S
from tidewater.plans.base import Tables, query
from tidewater.plans.text_queries import TOKENS
from tidewater.sources import readers
from tidewater.sources.scratch import new_path


@query("SELECT 'u' || CAST(doc_id AS VARCHAR) AS key, length(text) AS target_len, n_chars // 2 <> length(text) AS changed FROM documents")
def src_refresh_lengths(t: Tables) -> DataFrame:
    """A manifest whose lengths have gone stale, with lengths measured anew."""
    path = new_path(t.spark, "stale")
    rows = t.documents.select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("target"), F.floor(F.col("n_chars") / 2).alias("target_len"))
    rows.write.json(path)
    m = readers.manifest(t.spark, path).withColumn("old", F.col("target_len"))
    new = readers.refresh_lengths(m, {"target_len": F.char_length("target")})
    return new.select("key", F.col("target_len").cast("long").alias("target_len"), (F.col("old") != F.col("target_len")).alias("changed"))


@query("SELECT 'r' || CAST(conv_id AS VARCHAR) AS run, count(*) AS n_words, count(*) FILTER (WHERE turn % 2 = 0) AS n_snapshots, sum(length(text)) AS final_chars, conv_id % 7 AS seed FROM conversations GROUP BY conv_id", longs=("final_chars",))
def src_experiments(t: Tables) -> DataFrame:
    """Folders of experiments (final text, timed words, snapshots, settings) written and read by run."""
    path = new_path(t.spark, "experiments")
    run = F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("run")
    rows = t.conversations.select(run, "conv_id", "turn", "text")
    rows.groupBy("run").agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", "text")))["text"], "").alias("text")).write.json(f"{path}/final")
    rows.select("run", F.col("turn").cast("double").alias("at"), "text").write.json(f"{path}/events")
    rows.where("turn % 2 = 0").select("run", F.col("turn").cast("double").alias("at"), "text").write.json(f"{path}/snapshots")
    rows.select("run", (F.col("conv_id") % 7).alias("seed")).distinct().write.json(f"{path}/meta")
    e = readers.experiments(t.spark, path)
    n = lambda name, c: e[name].groupBy("run").agg(F.count(F.lit(1)).alias(c))
    out = e["final"].join(n("events", "n_words"), "run").join(n("snapshots", "n_snapshots"), "run", "left").join(e["meta"], "run")
    return out.select("run", "n_words", F.coalesce("n_snapshots", F.lit(0).cast("long")).alias("n_snapshots"), F.char_length("text").cast("long").alias("final_chars"), "seed")


@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS n FROM documents WHERE len({TOKENS.format('text')}) >= 12")
def flt_minimum_words(t: Tables) -> DataFrame:
    """Candidates of at least twelve words."""
    return t.documents.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n")).where("n >= 12")


@query(
    """SELECT event_id, value > 72 AS repetitive, CASE WHEN (event_id % 10) / 10.0 > 0.6 THEN FALSE WHEN value / 30 > 2.4 THEN TRUE WHEN -(event_id % 23) / 10.0 < -1.0 THEN TRUE ELSE FALSE END AS again FROM events"""
)
def flt_decode_rule(t: Tables) -> DataFrame:
    """Whether a decode is to be done again: repetitive or unlikely text, but never silence."""
    ratio, log_prob, no_speech = F.col("value") / 30, -(F.col("event_id") % 23) / 10.0, (F.col("event_id") % 10) / 10.0
    return t.events.select("event_id", (F.col("value") > 72).alias("repetitive"), T.decode_again(ratio, log_prob, no_speech).alias("again"))


def _sorted_batches(t: Tables) -> DataFrame:
    rows = t.documents.select(F.floor(F.col("doc_id") / 64).alias("buffer"), "n_chars", "doc_id").withColumn("by", F.col("n_chars"))
    return M.batches_by_tokens(rows, "buffer", ["by", "doc_id"], "n_chars", 20000, max_rows=6).drop("by")


_BATCHES = """o AS (SELECT doc_id, n_chars AS n, doc_id // 64 AS buffer, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY n_chars, doc_id) AS i FROM documents),
    r AS (SELECT buffer, i, doc_id, n, CASE WHEN n <= 20000 THEN 0 ELSE 1 END AS batch, 1 AS rows, n AS longest FROM o WHERE i = 1 UNION ALL
    SELECT o.buffer, o.i, o.doc_id, o.n, CASE WHEN greatest(r.longest, o.n) * (r.rows + 1) <= 20000 AND r.rows < 6 THEN r.batch ELSE r.batch + 1 END,
    CASE WHEN greatest(r.longest, o.n) * (r.rows + 1) <= 20000 AND r.rows < 6 THEN r.rows + 1 ELSE 1 END, CASE WHEN greatest(r.longest, o.n) * (r.rows + 1) <= 20000 AND r.rows < 6 THEN greatest(r.longest, o.n) ELSE o.n END
    FROM r JOIN o ON o.buffer = r.buffer AND o.i = r.i + 1)"""


@query(f"WITH RECURSIVE {_BATCHES} SELECT buffer, doc_id, row_number() OVER (PARTITION BY buffer ORDER BY doc_id) - 1 AS place, batch, max(n) OVER (PARTITION BY buffer, batch) - n AS padding FROM r")
def bat_restored_order(t: Tables) -> DataFrame:
    """Segments sorted by length, batched, and put back into their own order with what their batch gave (its padding)."""
    b = _sorted_batches(t)
    done = b.withColumn("padding", F.max("n_chars").over(W.partitionBy("buffer", "batch")) - F.col("n_chars"))
    place = F.row_number().over(W.partitionBy("buffer").orderBy("doc_id")) - 1
    return done.select("buffer", "doc_id", place.cast("long").alias("place"), "batch", "padding")


@query(
    f"""WITH RECURSIVE {_BATCHES}, l AS (SELECT buffer, max(batch) AS batch FROM r GROUP BY buffer), c AS (SELECT r.buffer, r.batch, count(*) AS rows, max(n) AS longest FROM r JOIN l USING (buffer, batch) GROUP BY ALL),
    x AS (SELECT r.buffer, r.doc_id, c.batch, c.rows, row_number() OVER (PARTITION BY r.buffer ORDER BY md5('3:' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM r JOIN c ON c.buffer = r.buffer AND r.batch < c.batch AND r.n <= c.longest)
    SELECT buffer, batch, doc_id, FALSE AS added FROM r UNION ALL SELECT buffer, batch, doc_id, TRUE FROM x WHERE k <= 6 - rows"""
)
def bat_random_top_up(t: Tables) -> DataFrame:
    """The last batch of a buffer filled up with rows of its others, drawn by a seeded hash, none longer than its longest."""
    b = _sorted_batches(t)
    last = b.groupBy("buffer").agg(F.max("batch").alias("last"))
    c = b.join(last, "buffer").where("batch = last").groupBy("buffer", "last").agg(F.count(F.lit(1)).alias("rows"), F.max("n_chars").alias("longest"))
    rest = b.join(c, "buffer").where("batch < last AND n_chars <= longest")
    k = F.row_number().over(W.partitionBy("buffer").orderBy(F.md5(F.concat(F.lit("3:"), F.col("doc_id").cast("string"))), "doc_id"))
    more = rest.withColumn("k", k).where(F.col("k") <= 6 - F.col("rows")).select("buffer", F.col("last").alias("batch"), "doc_id", F.lit(True).alias("added"))
    return b.select("buffer", "batch", "doc_id", F.lit(False).alias("added")).unionByName(more)


@query(
    f"""WITH w AS (SELECT conv_id, turn, {TOKENS.format('text')} AS w, md5('9:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)) AS h FROM conversations),
    s AS (SELECT *, CAST('0x' || h[1:6] AS BIGINT) % 10 AS dice, CAST('0x' || h[7:12] AS BIGINT) % greatest(len(w), 1) AS start, 1 + CAST('0x' || h[13:18] AS BIGINT) % 4 AS n FROM w)
    SELECT conv_id, turn, CAST(start AS BIGINT) AS start, list_aggregate(w[start + 1 : start + n], 'string_agg', ' ') AS hotword FROM s WHERE dice < 7 AND len(w) > 0"""
)
def bat_hotword_spans(t: Tables) -> DataFrame:
    """Hot words for biasing: of seven turns in ten, a span of one to four words, drawn by a seeded hash."""
    h = F.md5(F.concat_ws(":", F.lit("9"), F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    part = lambda k: F.conv(F.substring("h", k, F.lit(6)), 16, 10).cast("long")
    s = t.conversations.select("conv_id", "turn", T.tokens(F.col("text")).alias("w"), h.alias("h")).where((F.size("w") > 0) & (part(1) % 10 < 7))
    s = s.select("conv_id", "turn", "w", (part(7) % F.size("w")).alias("start"), (1 + part(13) % 4).cast("int").alias("n"))
    return s.select("conv_id", "turn", "start", F.array_join(F.slice("w", (F.col("start") + 1).cast("int"), F.col("n")), " ").alias("hotword"))


@query(
    f"""WITH k AS (SELECT DISTINCT unnest({TOKENS.format('text')}) AS w FROM benchmark), d AS (SELECT w, CASE WHEN length(w) > 3 THEN left(w, 3) || '@@ ' || substr(w, 4) ELSE w END AS piece FROM k),
    t AS (SELECT conv_id, turn, unnest({TOKENS.format('text')}) AS w, generate_subscripts({TOKENS.format('text')}, 1) AS i FROM conversations)
    SELECT conv_id, turn, string_agg(coalesce(piece, '<unk>'), ' ' ORDER BY i) AS pieces, count(*) FILTER (WHERE piece IS NULL) AS n_unknown FROM t LEFT JOIN d USING (w) GROUP BY conv_id, turn"""
)
def str_segment_dictionary(t: Tables) -> DataFrame:
    """Words cut by a dictionary of segments; what it lacks is <unk>."""
    d = t.benchmark.select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct()
    d = d.select("w", F.when(F.char_length("w") > 3, F.concat(F.left("w", F.lit(3)), F.lit("@@ "), F.substring("w", 4, F.char_length("w")))).otherwise(F.col("w")).alias("piece"))
    rows = t.conversations.select("conv_id", "turn", F.posexplode(T.tokens(F.col("text"))).alias("i", "w")).join(d, "w", "left")
    pieces = F.sort_array(F.collect_list(F.struct("i", F.coalesce("piece", F.lit("<unk>")).alias("p"))))["p"]
    return rows.groupBy("conv_id", "turn").agg(F.array_join(pieces, " ").alias("pieces"), F.count_if(F.col("piece").isNull()).alias("n_unknown"))


@query(
    r"""SELECT conv_id, turn, turn * 4000 + CASE WHEN turn % 2 = 0 THEN 120 ELSE 0 END AS begin, turn * 4000 + CASE WHEN turn % 2 = 0 THEN 120 + length(text) * 5 ELSE 3500 END AS stop, trim(regexp_replace(s, '<\|[^|]*\|>', '', 'g')) AS sentence
    FROM (SELECT *, CASE WHEN turn = 3 THEN '<|nospeech|> ' ELSE '<|' || role || '|>' || text END AS s FROM conversations) WHERE trim(regexp_replace(s, '<\|[^|]*\|>', '', 'g')) <> ''"""
)
def tim_speech_sentences(t: Tables) -> DataFrame:
    """A sentence for each speech segment: its words' times where they are known, else the segment's; empty ones go."""
    said = F.when(F.col("turn") == 3, F.lit("<|nospeech|> ")).otherwise(F.concat(F.lit("<|"), "role", F.lit("|>"), "text"))
    known = F.when(F.col("turn") % 2 == 0, F.array(F.struct((F.col("turn") * 4000 + 120).alias("a"), (F.col("turn") * 4000 + 500).alias("b")), F.struct((F.col("turn") * 4000 + 600).alias("a"), (F.col("turn") * 4000 + 120 + F.char_length("text") * 5).alias("b"))))
    turn = F.struct("turn", said.alias("text"), known.alias("times"))
    segment = F.struct("turn", (F.col("turn") * 4000).alias("a"), (F.col("turn") * 4000 + 3500).alias("b"))
    g = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("texts"), F.sort_array(F.collect_list(segment)).alias("segments"))
    rows = g.select("conv_id", F.explode(F.arrays_zip("texts", "segments")).alias("z"))
    words = F.col("z.texts.times")
    rows = rows.select("conv_id", F.col("z.texts.turn").alias("turn"), F.coalesce(words[0]["a"], F.col("z.segments.a")).alias("begin"), F.coalesce(F.element_at(words, -1)["b"], F.col("z.segments.b")).alias("stop"), T.strip_tags(F.col("z.texts.text")).alias("sentence"))
    return rows.where("sentence <> ''")


@query(
    """WITH m AS (SELECT user_id, least(round(median(value), 6), 60) * 2 AS most FROM events WHERE value > 0 GROUP BY user_id), w AS (SELECT e.*, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events e)
    SELECT event_id, round(CASE WHEN value > most AND event_type = 'error' THEN 0 WHEN value > most AND before = 'error' THEN value - most ELSE 0 END, 6) AS begin, round(CASE WHEN value > most AND event_type = 'error' THEN most ELSE value END, 6) AS stop FROM w JOIN m USING (user_id)"""
)
def tim_long_words(t: Tables) -> DataFrame:
    """Words over twice the median length are cut at sentence ends: a last word keeps its begin, a first word its end."""
    w = t.events.withColumn("before", F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    m = t.events.where("value > 0").groupBy("user_id").agg((F.least(F.round(F.percentile("value", 0.5), 6), F.lit(60.0)) * 2).alias("most"))
    long, ends, starts = F.col("value") > F.col("most"), F.col("event_type") == "error", F.col("before") == "error"
    rows = w.join(m, "user_id")
    begin = F.when(long & ends, 0.0).when(long & starts, F.col("value") - F.col("most")).otherwise(0.0)
    return rows.select("event_id", F.round(begin, 6).alias("begin"), F.round(F.when(long & ends, F.col("most")).otherwise(F.col("value")), 6).alias("stop"))


@query("SELECT DISTINCT source, lang FROM documents EXCEPT SELECT source, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 1")
def sup_skip_finished(t: Tables) -> DataFrame:
    """Runs of a sweep that have no finished result yet."""
    keys = ["source", "lang"]
    done = t.documents.join(t.labels.where("quality = 1 AND toxic = 1").select("doc_id"), "doc_id").select(keys).distinct()
    return t.documents.select(keys).distinct().join(done, keys, "left_anti")


@query()
def sup_segment_labels(t: Tables) -> DataFrame:
    """Speaker labels SPK0, SPK1, ... of the segments of each session, by clusters of their vectors; empty segments go."""
    e = t.embeddings.where(F.size("embedding") > 0).select(F.floor(F.col("vec_id") / 125).alias("session"), "vec_id", "embedding")
    return C.cluster_sessions(e, "session", "vec_id", "embedding").select("session", "vec_id", F.concat(F.lit("SPK"), F.col("speaker").cast("string")).alias("label"))


@query()
def str_repeated_grams(t: Tables) -> DataFrame:
    """Texts cut after the first of three or more repeats of a word or of one to eleven characters."""
    stuck = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" lalalala and so on"))).when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit(" stop, stop, stop it"))).otherwise(F.col("text"))
    cut = udfs.cut_repeats(stuck)
    return t.documents.select("doc_id", cut.alias("cut"), (cut != stuck).alias("repeats"))


_SENTENCES = "conv_id, turn, turn * 1000 AS a, turn * 1000 + 900 AS b FROM conversations"


@query(
    f"""WITH v AS (SELECT conv_id, list({{'spk': turn % 3, 'mx': 0::BIGINT, 'a': turn * 700, 'b': turn * 700 + 600}} ORDER BY turn) AS l FROM conversations GROUP BY conv_id), s AS (SELECT {_SENTENCES}),
    f AS (SELECT s.conv_id, turn, list_reduce(list_prepend({{'spk': 0::BIGINT, 'mx': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT}}, l), lambda p, x: {{'spk': CASE WHEN greatest(least(s.b, x.b) - greatest(s.a, x.a), 0) > p.mx THEN x.spk ELSE p.spk END,
    'mx': greatest(p.mx, greatest(least(s.b, x.b) - greatest(s.a, x.a), 0)) + CASE WHEN greatest(least(s.b, x.b) - greatest(s.a, x.a), 0) > 0 AND (greatest(least(s.b, x.b) - greatest(s.a, x.a), 0) > p.mx OR x.spk = p.spk) THEN greatest(least(s.b, x.b) - greatest(s.a, x.a), 0) ELSE 0 END, 'a': 0::BIGINT, 'b': 0::BIGINT}}) AS r FROM s JOIN v USING (conv_id))
    SELECT conv_id, turn, r.spk AS speaker FROM f"""
)
def jn_speaker_of_sentence(t: Tables) -> DataFrame:
    """The speaker of each sentence by a walk over the speaker turns, where what the chosen one has overlapped counts on.

    Turns that do not overlap change nothing, so a sentence meets only those that lie in its cells of time.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 1000), F.floor((F.col(b) - 1) / 1000))).alias("cell")
    v = t.conversations.select("conv_id", F.col("turn").alias("nth"), (F.col("turn") % 3).alias("spk"), (F.col("turn") * 700).alias("a"), (F.col("turn") * 700 + 600).alias("b"))
    s = t.conversations.select("conv_id", "turn", (F.col("turn") * 1000).alias("begin"), (F.col("turn") * 1000 + 900).alias("stop"))
    both = s.select("conv_id", "turn", "begin", "stop", cells("begin", "stop")).join(v.select("conv_id", "nth", "spk", "a", "b", cells("a", "b")), ["conv_id", "cell"], "left")
    met = F.when(F.col("nth").isNotNull() & (F.least("stop", "b") > F.greatest("begin", "a")), F.struct("nth", "spk", "a", "b"))
    g = both.groupBy("conv_id", "turn", "begin", "stop").agg(F.array_sort(F.collect_set(met)).alias("l"))
    return g.select("conv_id", "turn", S.walked_speaker(F.col("begin"), F.col("stop"), F.col("l")).cast("long").alias("speaker"))


def broadcast_lines(t: Tables) -> DataFrame:
    """event_id and a broadcast line made from the event."""
    n = lambda c: F.upper(T.spoken_digits(c.cast("string")))
    full = F.concat_ws(
        " ",
        F.lit("INFORMATION"), F.element_at(F.array(*[F.lit(w) for w in slots.ALPHABET]), (F.col("event_id") % 27 + 1).cast("int")),
        F.lit("WEATHER AT"), n(F.lpad(((F.col("event_id") % 26) * 100).cast("string"), 4, "0")), F.lit("ZULU WIND"), n(F.lpad((F.col("user_id") * 3 % 400).cast("string"), 3, "0")), F.lit("AT"), n(F.col("user_id") % 10),
        F.lit("VISIBILITY"), n(F.col("event_id") % 120), F.when(F.col("event_id") % 3 == 0, "THOUSAND"), F.lit("TEMPERATURE"), n(F.col("event_id") % 70), F.lit("DEW POINT"), n(F.col("user_id") % 90),
        F.lit("ALTIMETER"), n(F.col("event_id") % 900 + 2600), F.lit("RUNWAY"), n(F.col("user_id") % 40 + 1), F.lit("FREQUENCY ONE TWO ONE DECIMAL"), n(F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")), F.lit("FLIGHT LEVEL"), n(F.col("event_id") % 700 + 1),
    )
    line = F.when(F.col("event_type") == "error", F.lit("GOOD DAY")).otherwise(full)
    return t.events.select("event_id", line.alias("line"))


@query()
def num_all_slots(t: Tables) -> DataFrame:
    """Verdicts of every slot of broadcast lines made from events; lines without a slot are UNPARSED."""
    verdicts = slots.check_slots(F.col("line"))
    rows = broadcast_lines(t).select("event_id", *[c.alias(s) for s, c in verdicts.items()])
    return rows.select("event_id", F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in verdicts]), F.array(*verdicts))).alias("slot", "verdict")).where("verdict IS NOT NULL")
