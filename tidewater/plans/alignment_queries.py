"""Queries that align sequences: error rates, votes, fusion, lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import alignment as A
from tidewater.operators import fuzzy as Z
from tidewater.operators import votes as V
from tidewater.plans.base import Tables, query
from tidewater.plans.relational_queries import turn_pairs


@query()
def corpus_error_rate(t: Tables) -> DataFrame:
    """Error rate of each turn's next turn against it, by role."""
    return A.error_rates(turn_pairs(t).where("hyp IS NOT NULL"), ["role"], T.tokens(F.col("hyp")), T.tokens(F.col("ref")))


@query(
    r"""WITH p AS (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS hyp FROM events)
    SELECT event_type, sum(levenshtein(event_type, hyp)) AS dist, sum(length(event_type)) AS n_ref, round(sum(levenshtein(event_type, hyp)) / sum(length(event_type)), 9) AS cer FROM p WHERE hyp IS NOT NULL GROUP BY event_type""",
    longs=("dist", "n_ref"),
)
def agg_character_error_rate(t: Tables) -> DataFrame:
    """Character error rate, micro-averaged, by the built-in distance."""
    p = t.events.select("event_type", F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts")).alias("hyp")).where("hyp IS NOT NULL")
    g = p.groupBy("event_type").agg(F.sum(F.levenshtein("event_type", "hyp")).alias("dist"), F.sum(F.char_length("event_type")).alias("n_ref"))
    return g.withColumn("cer", F.round(F.try_divide(F.col("dist").cast("double"), F.col("n_ref")), 9))


@query(
    r"""WITH s AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p, ts FROM events), c AS (SELECT user_id, string_agg(left(event_type, 1), '' ORDER BY ts) AS kept FROM s WHERE (p IS NULL OR p <> event_type) AND event_type <> 'error' GROUP BY user_id)
    SELECT user_id, kept, length(kept) AS n FROM c"""
)
def agg_collapse_repeats(t: Tables) -> DataFrame:
    """Symbols of a frame series with repeats collapsed, then blanks dropped."""
    w = W.partitionBy("user_id").orderBy("ts")
    s = t.events.withColumn("p", F.lag("event_type").over(w)).where((F.col("p").isNull() | (F.col("p") != F.col("event_type"))) & (F.col("event_type") != "error"))
    g = s.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("ts", F.left("event_type", F.lit(1)).alias("x"))))["x"], "").alias("kept"))
    return g.withColumn("n", F.char_length("kept").cast("long"))


@query()
def mth_edit_operations(t: Tables) -> DataFrame:
    """Correct, substituted, inserted and deleted tokens of each pair of turns."""
    p = turn_pairs(t).where("hyp IS NOT NULL")
    return p.select("conv_id", "turn", A.edits(T.tokens(F.col("hyp")), T.tokens(F.col("ref"))).alias("e")).select("conv_id", "turn", "e.*")


@query()
def mth_matching_blocks(t: Tables) -> DataFrame:
    """Share of a turn's tokens that align with the next turn."""
    p = turn_pairs(t).where("hyp IS NOT NULL").select("conv_id", "turn", T.tokens(F.col("ref")).alias("a"), T.tokens(F.col("hyp")).alias("b"))
    o = p.select("conv_id", "turn", F.size("a").alias("n"), F.explode(A.opcodes(F.col("a"), F.col("b"))).alias("o"))
    hit = F.when(F.col("o.tag") == "equal", F.col("o.a1") - F.col("o.a0")).otherwise(0)
    return o.groupBy("conv_id", "turn", "n").agg(F.sum(hit).alias("matched"))


@query()
def mth_chr_f(t: Tables) -> DataFrame:
    """Character F-score of neighbouring turns."""
    p = turn_pairs(t).where("hyp IS NOT NULL")
    return p.select("conv_id", "turn", F.round(A.chr_f(F.col("ref"), F.col("hyp")), 9).alias("chrf"))


TURN = ("conv_id", "turn")


def _engines(t: Tables) -> DataFrame:
    """A row a turn: its words, and what three made-up engines make of them, each garbling some."""
    w = t.conversations.select(*TURN, F.split(T.squeeze(F.upper("text")), " ").alias("base"))
    n = F.col("conv_id") + F.col("turn")
    garbled = lambda k: F.transform("base", lambda x, i: F.when((i * 7 + n) % 5 == k, F.lit("NOISE")).when((i + n) % 11 == 3, F.lit("OTHER")).otherwise(x))
    return w.select(*TURN, "base", F.array(*[garbled(k) for k in range(3)]).alias("engines"))


@query()
def set_rover_vote(t: Tables) -> DataFrame:
    """A token gives way only to one that two or more engines agree on; ties go to the first in the alphabet."""
    return _engines(t).select(*TURN, V.rover_vote("base", "engines").alias("v")).select(*TURN, "v.text", "v.wins")


@query()
def set_template_fusion(t: Tables) -> DataFrame:
    """Template tokens attested by an engine stay; unattested ones give way to a token that two families agree on."""
    fused = V.template_fusion(["first", "first", "second"])
    return _engines(t).select(*TURN, fused("base", "engines").alias("v")).select(*TURN, "v.*")


@query()
def set_multi_pass_consensus(t: Tables) -> DataFrame:
    """Tokens of the longest pass that enough other passes repeat or none contradicts."""
    return _engines(t).where(F.size("base") > 0).select(*TURN, V.multi_pass("base", "engines").alias("v")).select(*TURN, "v.text", "v.dropped")


@query()
def str_lexicon_correction(t: Tables) -> DataFrame:
    """Unknown words give way to the most alike words of the whole vocabulary of the benchmark."""
    lexicon = t.benchmark.select(F.explode(F.split(T.squeeze(F.upper("text")), " ")).alias("w")).where("w != ''")
    said = t.documents.select("doc_id", T.squeeze(F.upper("text")).alias("said"))
    return Z.corrected(said, "doc_id", "said", lexicon, "w")


@query()
def met_token_latency(t: Tables) -> DataFrame:
    """Delay of each turn's aligned tokens behind the turn before, by conversation."""
    p = turn_pairs(t).where("hyp IS NOT NULL").select("conv_id", "turn", T.tokens(F.col("ref")).alias("a"), T.tokens(F.col("hyp")).alias("b"))
    o = p.select("conv_id", F.explode(A.opcodes(F.col("a"), F.col("b"))).alias("o")).where("o.tag = 'equal'")
    rows = o.select("conv_id", F.explode(F.sequence(F.lit(0), F.col("o.a1") - F.col("o.a0") - 1)).alias("k"), (F.col("o.b0") - F.col("o.a0")).alias("lag"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("lag", 0.5), 3).alias("median"), F.round(F.percentile("lag", 0.95), 3).alias("p95"))
