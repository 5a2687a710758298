"""Queries over sub-words, spans, hot words, contests, cycles and online decisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import plugins, udfs
from tidewater.functions import text as T
from tidewater.operators import manifest as M
from tidewater.operators import series as S
from tidewater.plans.base import Tables, query
from tidewater.plans.series_queries import frames
from tidewater.plans.text_queries import TOKENS
from tidewater.sources.scratch import new_path


@query(
    """WITH RECURSIVE s AS (SELECT doc_id, n_chars + CAST(floor(1.2 * (n_chars // 6)) AS BIGINT) AS n, doc_id // 64 AS buffer FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY buffer ORDER BY n, doc_id) AS i FROM s),
    r AS (SELECT buffer, i, doc_id, n, CASE WHEN n <= 20000 THEN 0 ELSE 1 END AS batch, 1 AS rows, n AS longest FROM o WHERE i = 1 UNION ALL
    SELECT o.buffer, o.i, o.doc_id, o.n, CASE WHEN greatest(r.longest, o.n) * (r.rows + 1) <= 20000 AND r.rows < 6 THEN r.batch ELSE r.batch + 1 END,
    CASE WHEN greatest(r.longest, o.n) * (r.rows + 1) <= 20000 AND r.rows < 6 THEN r.rows + 1 ELSE 1 END, CASE WHEN greatest(r.longest, o.n) * (r.rows + 1) <= 20000 AND r.rows < 6 THEN greatest(r.longest, o.n) ELSE o.n END
    FROM r JOIN o ON o.buffer = r.buffer AND o.i = r.i + 1) SELECT buffer, doc_id, n, batch FROM r"""
)
def bat_sorted_tokens(t: Tables) -> DataFrame:
    """Batches of rows sorted by source and weighted target tokens, capped in size and count."""
    n = F.col("n_chars") + F.floor(F.lit(1.2) * F.floor(F.col("n_chars") / 6))
    rows = t.documents.select(F.floor(F.col("doc_id") / 64).alias("buffer"), n.alias("n"), "doc_id").withColumn("by", F.col("n"))
    return M.batches_by_tokens(rows, "buffer", ["by", "doc_id"], "n", 20000, max_rows=6).drop("by")


@query(
    f"""SELECT doc_id, i - 1 AS pos, w AS word, 10 * (sum((length(w) + 2) // 3) OVER (PARTITION BY doc_id ORDER BY i) - (length(w) + 2) // 3) AS begin, 10 * sum((length(w) + 2) // 3) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS w, generate_subscripts({TOKENS.format('text')}, 1) AS i FROM documents)""",
    longs=("begin", "stop"),
)
def tim_merge_subwords(t: Tables) -> DataFrame:
    """Timed pieces put together again: a piece with the mark begins a word."""
    w = t.documents.select("doc_id", T.tokens(F.col("text")).alias("w"))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(x) - 1) / 3).cast("int")), lambda k: F.concat(F.when(k == 0, "▁").otherwise(""), F.substring(x, k * 3 + 1, F.lit(3))))
    pieces = w.select("doc_id", F.posexplode(F.flatten(F.transform("w", cut))).alias("i", "piece"))
    word = F.sum(F.col("piece").startswith("▁").cast("int")).over(W.partitionBy("doc_id").orderBy("i")) - 1
    rows = pieces.withColumn("pos", word)
    text = F.array_join(F.sort_array(F.collect_list(F.struct("i", "piece")))["piece"], "")
    g = rows.groupBy("doc_id", "pos").agg(F.replace(text, F.lit("▁"), F.lit("")).alias("word"), (F.min("i") * 10).cast("long").alias("begin"), (F.max("i") * 10 + 10).cast("long").alias("stop"))
    return g


@query(
    r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?。！？]+)\s', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents),
    u AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM s) SELECT doc_id, i, length(s) AS n, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(s) - 1 AS begin FROM u""",
    longs=("begin",),
)
def tim_sentence_spans(t: Tables) -> DataFrame:
    """Sentences by where they stand, each mark's white space counted once."""
    l = F.filter(F.split(F.regexp_replace("text", r"([.!?。！？]+)\s", "$1\u0001"), "\u0001"), lambda s: s != "")  # noqa: E741
    rows = t.documents.select("doc_id", F.posexplode(l).alias("i", "s")).select("doc_id", F.col("i").cast("long").alias("i"), F.char_length("s").cast("long").alias("n"))
    return rows.withColumn("begin", F.sum(F.col("n") + 1).over(W.partitionBy("doc_id").orderBy("i")) - F.col("n") - 1)


@query(
    f"""WITH k AS (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS w FROM documents), h AS (SELECT DISTINCT unnest({TOKENS.format('text')}) AS h FROM benchmark)
    SELECT doc_id, h AS hotword, count(*) AS n_like, min(w) AS first_like FROM k JOIN h ON length(w) BETWEEN length(h) - 1 AND length(h) + 1 AND left(w, 1) = left(h, 1) AND levenshtein(w, h) <= 1 GROUP BY doc_id, h"""
)
def jn_hotword_match(t: Tables) -> DataFrame:
    """Words within one edit of a hot word: distinct words meet hot words by first letter and length, then the exact distance decides."""
    k = t.documents.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w"))
    h = t.benchmark.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("hotword")).distinct()
    h = h.select("hotword", F.left("hotword", F.lit(1)).alias("a"), F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: d + F.char_length("hotword"))).alias("n"))
    words = k.select("w").distinct().select("w", F.left("w", F.lit(1)).alias("a"), F.char_length("w").alias("n"))
    like = words.join(h, ["a", "n"]).where(F.levenshtein("w", "hotword", 1) >= 0).select("w", "hotword")
    return k.join(like, "w").groupBy("doc_id", "hotword").agg(F.count(F.lit(1)).alias("n_like"), F.min("w").alias("first_like"))


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'happy' WHEN 'error' THEN 'angry' WHEN 'view' THEN 'neutral' ELSE 'unknown' END AS tag FROM events"""
)
def str_tag_map(t: Tables) -> DataFrame:
    """Tags to labels by a fixed map."""
    m = F.create_map(*[F.lit(x) for x in ("click", "happy", "error", "angry", "view", "neutral")])
    return t.events.select("event_id", F.coalesce(m[F.col("event_type")], F.lit("unknown")).alias("tag"))


@query()
def str_rich_text(t: Tables) -> DataFrame:
    """Tagged transcripts of two languages with signs for their events and emotions."""
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))
    tags = lambda k: F.concat(pick(udfs.EMOTIONS, k), pick(udfs.EVENTS, k + F.col("turn")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    first, second = F.left("text", half), F.substring("text", half + 1, F.char_length("text"))
    n = F.col("conv_id") + F.col("turn")
    said = F.concat(pick(udfs.LANGUAGES, n), tags(n), first, F.lit(" "), pick(udfs.LANGUAGES, n + 1), tags(F.floor(n / 2)), F.lit(" "), second)
    return t.conversations.select("conv_id", "turn", udfs.rich_texts(said).alias("rich"))


@query("SELECT user_id, arg_max(event_type, (n, event_type)) AS dominant, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def str_dominant_tag(t: Tables) -> DataFrame:
    """The tag that occurs most in a session."""
    g = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("user_id").agg(F.max(F.struct("n", "event_type")).alias("b")).select("user_id", F.col("b.event_type").alias("dominant"), F.col("b.n").alias("n"))


@query("SELECT doc_id, replace(replace(text, 'th', 't@@ h'), '@@ ', '') = text AS joined_back, replace(trim(replace('▁' || replace(text, ' ', '▁'), '▁', ' ')), ' i ', ' I ') AS pieces_joined FROM documents")
def str_subword_join(t: Tables) -> DataFrame:
    """Sub-words of both notations joined to words."""
    cut = F.replace("text", F.lit("th"), F.lit("t@@ h"))
    marked = F.concat(F.lit("▁"), F.replace("text", F.lit(" "), F.lit("▁")))
    words = F.replace(F.trim(F.replace(marked, F.lit("▁"), F.lit(" "))), F.lit(" i "), F.lit(" I "))
    return t.documents.select("doc_id", (F.replace(cut, F.lit("@@ "), F.lit("")) == F.col("text")).alias("joined_back"), words.alias("pieces_joined"))


@query("SELECT CASE WHEN turn % 2 = 0 THEN 'draft' ELSE 'final' END AS track, conv_id, turn, length(text) AS n FROM conversations")
def snk_two_tracks(t: Tables) -> DataFrame:
    """Events written by track and read back."""
    path = new_path(t.spark, "tracks")
    track = F.when(F.col("turn") % 2 == 0, "draft").otherwise("final").alias("track")
    t.conversations.select(track, "conv_id", "turn", F.char_length("text").cast("long").alias("n")).write.partitionBy("track").json(path)
    return t.spark.read.schema("conv_id long, turn long, n long, track string").json(path)


@query("SELECT item_id, k, item_id * 10 + k * 400 AS begin FROM benchmark, range(0, 4) t(k)")
def sup_tile_repeats(t: Tables) -> DataFrame:
    """A reference repeated four times, each shifted by a period."""
    return t.benchmark.select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k")).withColumn("begin", F.col("item_id") * 10 + F.col("k") * 400).select("item_id", "k", "begin")


@query(
    """WITH c AS (SELECT doc_id % 50 AS contest, lang AS channel, doc_id, n_chars FROM documents), w AS (SELECT contest, channel, arg_min(doc_id % 3, (n_chars, doc_id)) AS winner FROM c GROUP BY ALL)
    SELECT contest, count(*) AS channels, min(winner) AS low, max(winner) AS high, count(DISTINCT winner) = 1 AS agreed FROM w GROUP BY contest"""
)
def sup_batch_contests(t: Tables) -> DataFrame:
    """Winners of many contests by channel, and whether the channels agree."""
    c = t.documents.select((F.col("doc_id") % 50).alias("contest"), F.col("lang").alias("channel"), "doc_id", "n_chars")
    w = c.groupBy("contest", "channel").agg(F.min_by(F.col("doc_id") % 3, F.struct("n_chars", "doc_id")).alias("winner"))
    return w.groupBy("contest").agg(F.count(F.lit(1)).alias("channels"), F.min("winner").alias("low"), F.max("winner").alias("high"), (F.count_distinct("winner") == 1).alias("agreed"))


@query(
    f"""WITH r AS (SELECT item_id, unnest(list_distinct({TOKENS.format('text')})) AS w FROM benchmark), d AS (SELECT doc_id % 40 AS item_id, doc_id // 40 AS cycle, unnest(list_distinct({TOKENS.format('text')})) AS w FROM documents),
    n AS (SELECT item_id, count(*) AS n FROM r GROUP BY item_id), c AS (SELECT d.item_id, cycle, count(*) AS hit FROM d JOIN r USING (item_id, w) GROUP BY ALL)
    SELECT item_id, max(hit) AS best_hit, arg_max(cycle, (hit, -cycle)) AS best_cycle, round(max(hit) / max(n), 9) AS coverage FROM c JOIN n USING (item_id) GROUP BY item_id"""
)
def sup_cycle_coverage(t: Tables) -> DataFrame:
    """The cycle that covers most of its reference, the first of equals."""
    r = t.benchmark.select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w"))
    d = t.documents.select((F.col("doc_id") % 40).alias("item_id"), F.floor(F.col("doc_id") / 40).alias("cycle"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w"))
    n = r.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    c = d.join(r, ["item_id", "w"]).groupBy("item_id", "cycle").agg(F.count(F.lit(1)).alias("hit")).join(n, "item_id")
    best = F.max(F.struct("hit", (-F.col("cycle")).alias("c")))
    return c.groupBy("item_id").agg(best.alias("b"), F.max("n").alias("n")).select("item_id", F.col("b.hit").alias("best_hit"), (-F.col("b.c")).alias("best_cycle"), F.round(F.col("b.hit") / F.col("n"), 9).alias("coverage"))


@query(
    """WITH s AS (SELECT conv_id, turn, turn * 1000 AS a, turn * 1000 + 900 AS b, length(text) AS n FROM conversations), v AS (SELECT conv_id, turn AS spk, turn * 1300 AS sa, turn * 1300 + 1250 AS sb FROM conversations),
    o AS (SELECT s.conv_id, s.turn, s.n, v.spk, least(b, sb) - greatest(a, sa) AS o FROM s JOIN v ON s.conv_id = v.conv_id AND sa < b AND a < sb)
    SELECT conv_id, turn, spk, o, CAST(floor(n * o / sum(o) OVER (PARTITION BY conv_id, turn)) AS BIGINT) AS share FROM o WHERE o >= 100"""
)
def seg_split_by_speaker(t: Tables) -> DataFrame:
    """Sentences shared among the speakers that they overlap, by overlap. A conversation's turns are few."""
    s = t.conversations.select("conv_id", "turn", (F.col("turn") * 1000).alias("a"), (F.col("turn") * 1000 + 900).alias("b"), F.char_length("text").cast("long").alias("n"))
    v = t.conversations.select("conv_id", F.col("turn").alias("spk"), (F.col("turn") * 1300).alias("sa"), (F.col("turn") * 1300 + 1250).alias("sb"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 1000), F.floor((F.col(b) - 1) / 1000)))
    both = s.withColumn("c", cells("a", "b")).join(v.withColumn("c", cells("sa", "sb")), ["conv_id", "c"]).drop("c").dropDuplicates(["conv_id", "turn", "spk"])
    o = both.withColumn("o", F.least("b", "sb") - F.greatest("a", "sa")).where("o >= 100")
    total = F.sum("o").over(W.partitionBy("conv_id", "turn"))
    return o.select("conv_id", "turn", "spk", "o", F.floor(F.col("n") * F.col("o") / total).alias("share"))


@query(
    f"""SELECT conv_id, turn, n, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS in_buffer, turn - least(turn, 3) AS oldest FROM (SELECT conv_id, turn, len({TOKENS.format('text')}) AS n FROM conversations)""",
    longs=("in_buffer",),
)
def stm_decode_window(t: Tables) -> DataFrame:
    """Tokens in a buffer of the four newest segments."""
    rows = t.conversations.select("conv_id", "turn", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, 0)
    return rows.select("conv_id", "turn", "n", F.sum("n").over(w).alias("in_buffer"), (F.col("turn") - F.least("turn", F.lit(3))).alias("oldest"))


@query("SELECT doc_id, CAST(n_chars * 2 + 1 AS BIGINT) AS answer FROM documents")
def udf_model_boundary(t: Tables) -> DataFrame:
    """A model behind the plug-in boundary: loaded once a worker, fed batches."""

    def load():
        return lambda batch: pd.DataFrame({"doc_id": batch["doc_id"], "answer": batch["n_chars"] * 2 + 1})

    return plugins.infer(t.documents.select("doc_id", "n_chars"), "affine", load, "doc_id long, answer long")
