"""Queries over inputs of all kinds, slots with details, words with marks and times, and sentences shared among speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions.slot_table import slot_table
from tidewater.operators import clusters as C
from tidewater.operators import words as O
from tidewater.plans.base import Tables, query
from tidewater.plans.utterance_queries import broadcast_lines
from tidewater.sources import inputs
from tidewater.sources.scratch import make_path
from tidewater.sources.writers import json_arrays


@query(
    """WITH d AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS key, coalesce(source, '-') || '/' || coalesce(lang, '-') || ' ' || CAST(doc_id AS VARCHAR) || '.wav' AS source FROM documents)
    SELECT key, source, kind FROM d, (VALUES ('scp'), ('jsonl'), ('json')) k(kind)"""
)
def src_inputs(t: Tables) -> DataFrame:
    """Lists of documents as scp, JSON lines and JSON arrays, read by one format that tells them by their suffix."""
    key, source = F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.concat(F.coalesce("source", F.lit("-")), F.lit("/"), F.coalesce("lang", F.lit("-")), F.lit(" "), F.col("doc_id").cast("string"), F.lit(".wav"))
    rows = t.documents.select(key.alias("key"), source.alias("source"))
    item = F.to_json(F.struct("key", "source"))
    lines = {"scp": rows.select(F.concat_ws(" ", "key", "source").alias("value")), "jsonl": rows.select(item.alias("value"))}
    # an array, and so a file, for each part of the table
    lines["json"] = json_arrays(rows.select(item.alias("i")), "i")
    folder, read = make_path(t.spark, "inputs"), []
    for kind, df in lines.items():
        path = f"{folder}/{kind}"
        # Spark names text files .txt; each kind gets its suffix
        df.write.text(path)
        read += inputs.renamed(t.spark, path, kind)
    inputs.register(t.spark)
    got = t.spark.read.format("utterances").option("paths", "\n".join(read)).option("splitBytes", 1 << 20).load()
    return got.select("key", "source", F.regexp_extract("file", r"\.(\w+)$", 1).alias("kind"))


@query()
def num_slot_details(t: Tables) -> DataFrame:
    """Slots of broadcast lines with verdicts and details, by a table function joined to each line."""
    return broadcast_lines(t).lateralJoin(slot_table()(F.col("line").outer())).select("event_id", "slot", "verdict", "detail")


def _spoken(t: Tables) -> DataFrame:
    """Turns as arrays of (word, begin, stop): words with the space before them, marks by themselves, half a second for some."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), T.squeeze(F.col("text"))), F.lit(r"\s?[^\s.,!?;:()\"]+|\s?[.,!?;:()\"]"), F.lit(0))
    words = F.transform(found, lambda w, i: F.struct(w.alias("word"), F.when((i + F.col("turn")) % 9 == 4, 2.5).otherwise(0.25).alias("n")))
    begun = F.aggregate(words, F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias("l")), lambda s, w: F.struct((s["at"] + w["n"]).alias("at"), F.concat(s["l"], F.array(s["at"])).alias("l")))["l"]
    rows = t.conversations.select("conv_id", "turn", words.alias("w"), begun.alias("b"))
    return rows.select("conv_id", "turn", F.zip_with("w", "b", lambda w, b: F.struct(w["word"].alias("word"), b.alias("begin"), (b + w["n"]).alias("stop"))).alias("words"))


@query()
def tim_marks_merged(t: Tables) -> DataFrame:
    """Timed words of turns, long ones cut at sentence ends and marks attached to their neighbours."""
    rows = _spoken(t).select("conv_id", "turn", F.posexplode(O.words_with_marks("words")).alias("i", "w"))
    return rows.select("conv_id", "turn", "i", "w.word", F.round("w.begin", 6).alias("begin"), F.round("w.stop", 6).alias("stop"))


@query(
    r"""WITH x AS (SELECT conv_id, turn, text, regexp_extract_all(text, '\S+') AS k FROM conversations), p AS (SELECT conv_id, turn, text, unnest(k) AS token, generate_subscripts(k, 1) - 1 AS i, string_split_regex(text, '\S+') AS gap FROM x)
    SELECT conv_id, turn, i, lower(token) AS token, length(gap[1]) + coalesce(sum(length(token) + length(gap[i + 2])) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM p""",
    longs=("begin",),
)
def tim_token_spans(t: Tables) -> DataFrame:
    """Where lower-case tokens stand in the surface text of turns."""
    k = F.transform(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), F.lower)
    rows = t.conversations.select("conv_id", "turn", k.alias("k"), O.token_spans(F.col("text"), k).alias("s"))
    each = rows.select("conv_id", "turn", F.posexplode(F.arrays_zip("k", "s")).alias("i", "x"))
    return each.select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.col("x.k").alias("token"), F.col("x.s.begin").cast("long").alias("begin"))


@query()
def seg_sentence_parts(t: Tables) -> DataFrame:
    """Sentences divided among the speakers whose turns they overlap; parts under 3 s go to a neighbour, text is cut between words.

    Sentences meet the turns that share a cell of time.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 10000), F.floor((F.col(b) - 1) / 10000))).alias("cell")
    s = t.conversations.select("conv_id", "turn", (F.col("turn") * 9000).alias("begin"), (F.col("turn") * 9000 + 8700).alias("stop"), "text")
    v = t.conversations.select("conv_id", (F.col("turn") * 4100 - 700 * (F.col("turn") % 3)).alias("a"), (F.col("turn") * 4100 + 3300).alias("b"), (F.col("turn") % 3).cast("long").alias("spk"))
    both = s.select("conv_id", "turn", "begin", "stop", cells("begin", "stop")).join(v.select("conv_id", "a", "b", "spk", cells("a", "b")), ["conv_id", "cell"])
    met = both.where((F.least("stop", "b") > F.greatest("begin", "a"))).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set(F.struct("a", "b", "spk"))).alias("turns"))
    rows = s.join(met, ["conv_id", "turn"], "left").withColumn("turns", F.coalesce("turns", F.array().cast("array<struct<a:bigint,b:bigint,spk:bigint>>")))
    parts = rows.select("conv_id", "turn", F.posexplode(O.speaker_parts("begin", "stop", "text", "turns")).alias("part", "p"))
    return parts.select("conv_id", "turn", "part", "p.speaker", "p.begin", "p.stop", "p.text")


@query()
def sup_segment_speakers(t: Tables) -> DataFrame:
    """Labels SPK0, SPK1, ... of the segments of sessions: segments are cut into chunks, chunks are clustered by their vectors, and the
    chunks' timeline gives each segment the speaker that it overlaps most; empty segments go.

    Vectors lie 750 ms apart, each for a chunk of 1.5 s; a chunk counts up to the middle of what it shares with the next.
    """
    e = t.embeddings.select(F.floor(F.col("vec_id") / 125).alias("session"), "vec_id", "embedding", "label")
    # a segment for each run of equal labels, cut into its chunks
    w = W.partitionBy("session").orderBy("vec_id")
    runs = e.withColumn("new", F.coalesce((F.col("label") != F.lag("label").over(w)).cast("int"), F.lit(1))).withColumn("segment", F.sum("new").over(w))
    at = (F.col("vec_id") - F.col("session") * 125) * 750
    chunks = runs.where(F.size("embedding") > 0).select("session", "segment", "vec_id", "embedding", at.alias("begin"), (at + 1500).alias("stop"))
    named = C.cluster_sessions(chunks.select("session", "vec_id", "embedding"), "session", "vec_id", "embedding")
    rows = chunks.drop("embedding").join(named, ["session", "vec_id"])
    line = rows.withColumn("next", F.lead("begin").over(W.partitionBy("session").orderBy("vec_id")))
    line = line.select("session", "segment", "speaker", "begin", F.when(F.col("next") < F.col("stop"), F.floor((F.col("next") + F.col("stop")) / 2)).otherwise(F.col("stop")).alias("until"))
    line = line.withColumn("from", F.coalesce(F.greatest("begin", F.lag("until").over(W.partitionBy("session").orderBy("begin"))), "begin"))
    share = line.groupBy("session", "segment", "speaker").agg(F.sum(F.col("until") - F.col("from")).alias("n"))
    best = share.groupBy("session", "segment").agg(F.max(F.struct("n", (-F.col("speaker")).alias("s"))).alias("b"))
    return best.select("session", "segment", F.concat(F.lit("SPK"), (-F.col("b.s")).cast("string")).alias("label"), F.col("b.n").alias("overlap_ms"))
