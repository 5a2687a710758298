"""Queries over readers and writers, rules, candidates and session control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import slots, udfs
from tidewater.functions import text as T
from tidewater.functions.times import micros
from tidewater.operators import alignment as A
from tidewater.operators import keywords as K
from tidewater.operators import manifest as M
from tidewater.operators import sequences as Q
from tidewater.plans.base import Tables, query
from tidewater.plans.relational_queries import turn_pairs
from tidewater.plans.text_queries import NORM, TOKENS
from tidewater.sources import readers, writers
from tidewater.sources.scratch import new_path
from tidewater.streaming import sessions
from tidewater.streaming.machines import run_batch


@query("SELECT 'u' || CAST(doc_id AS VARCHAR) AS key, source, text AS target, '<ASR>' AS prompt, n_chars AS source_len, 0 AS target_len, lang AS text_language FROM documents")
def src_jsonl_manifest(t: Tables) -> DataFrame:
    """A manifest written as JSON lines and read with its schema and defaults."""
    path = new_path(t.spark, "manifest")
    rows = t.documents.select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("key"), "source", F.col("text").alias("target"), F.col("n_chars").alias("source_len"), F.col("lang").alias("text_language"))
    rows.write.json(path)
    return readers.manifest(t.spark, path).select("key", "source", "target", "prompt", "source_len", "target_len", "text_language")


@query(
    """SELECT 'c' || CAST(conv_id AS VARCHAR) AS key, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, count(*) FILTER (WHERE role = 'user') * count(*) FILTER (WHERE role = 'system') AS n_system, sum(length(text)) // 8 AS speech_len, count(*) AS text_len FROM conversations GROUP BY conv_id""",
    longs=("speech_len",),
)
def src_chat_jsonl(t: Tables) -> DataFrame:
    """Chats written as JSON lines and read by role."""
    path = new_path(t.spark, "chats")
    message = F.struct("turn", "role", F.col("text").alias("content"))
    g = t.conversations.groupBy(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("key")).agg(F.sort_array(F.collect_list(message)).alias("m"), F.sum(F.char_length("text")).cast("long").alias("speech_length"), F.count(F.lit(1)).alias("text_length"))
    g.select("key", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), "speech_length", "text_length").write.json(path)
    c = readers.chat_manifest(t.spark, path)
    size = lambda x: F.size(x).cast("long").alias(f"n_{x}")
    return c.select("key", size("user"), size("assistant"), size("system"), "speech_len", "text_len")


@query("SELECT 'seg' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS utt, 'rec' || CAST(l_orderkey % 50 AS VARCHAR) AS rec, CAST(l_linenumber AS DOUBLE) AS st, l_linenumber + l_quantity AS et FROM lineitem")
def src_kaldi_segments(t: Tables) -> DataFrame:
    """Segment lines written as text and read back."""
    path = new_path(t.spark, "segments")
    line = F.concat_ws(" ", F.concat(F.lit("seg"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")), F.concat(F.lit("rec"), (F.col("l_orderkey") % 50).cast("string")), F.col("l_linenumber").cast("double").cast("string"), (F.col("l_linenumber") + F.col("l_quantity")).cast("string"))
    t.lineitem.select(line.alias("value")).write.text(path)
    return readers.kaldi_segments(t.spark, path)


@query(
    """WITH l AS (SELECT event_id, event_id % 5 AS k, event_type AS e FROM events) SELECT CASE WHEN k < 3 THEN e || CAST(event_id AS VARCHAR) END AS wrong, upper(e) AS right, k < 3 AS is_explicit FROM l WHERE k <> 4"""
)
def src_hotword_rules(t: Tables) -> DataFrame:
    """Rule lines in all their forms."""
    k, e = F.col("event_id") % 5, F.col("event_type")
    name = F.concat(e, F.col("event_id").cast("string"))
    line = F.when(k == 0, F.concat(name, F.lit(" => "), F.upper(e))).when(k == 1, F.concat(name, F.lit("->"), F.upper(e))).when(k == 2, F.concat(F.lit("  "), name, F.lit(" → "), F.upper(e))).when(k == 3, F.upper(e)).otherwise(F.concat(F.lit("# "), e))
    return readers.hotword_rules(t.events.select(line.alias("value")))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'wav' WHEN 1 THEN 'flac' WHEN 2 THEN 'ogg' ELSE 'raw' END AS kind FROM events")
def src_container_kind(t: Tables) -> DataFrame:
    """Containers told by their first bytes."""
    k = F.col("event_id") % 4
    head = F.when(k == 0, F.unhex(F.lit("52494646000000005741564520"))).when(k == 1, F.unhex(F.lit("664C614300000000"))).when(k == 2, F.unhex(F.lit("4F67675300000000"))).otherwise(F.encode("event_type", "UTF-8"))
    return t.events.select("event_id", readers.container_kind(head).alias("kind"))


@query()
def snk_verbose_json(t: Tables) -> DataFrame:
    """Turns as segments of a JSON result."""
    rows = t.conversations.select("conv_id", (F.col("turn") * 2.5).alias("begin"), (F.col("turn") * 2.5 + 2).alias("end"), "text")
    return writers.verbose_json(rows, "conv_id", "begin", "end", "text")


@query()
def snk_vtt(t: Tables) -> DataFrame:
    """Turns as VTT cues."""
    rows = t.conversations.select("conv_id", (F.col("turn") * 2500).alias("begin"), (F.col("turn") * 2500 + 2000).alias("end"), "text")
    return writers.cues(rows, "conv_id", "begin", "end", "text", "vtt")


def _timed_words(t: Tables) -> DataFrame:
    """Words of turns, each with the space before it, in times that follow from their lengths; every third turn comes after a pause."""
    w = F.filter(F.split(T.squeeze(F.col("text")), " "), lambda x: x != "")
    rows = t.conversations.select("conv_id", "turn", F.posexplode(w).alias("i", "w"))
    upto = F.sum(F.char_length("w") + 1).over(W.partitionBy("conv_id").orderBy("turn", "i"))
    at = upto * 60 + F.floor(F.col("turn") / 3) * 4000
    return rows.select("conv_id", "turn", "i", F.concat(F.lit(" "), "w").alias("word"), (at - F.char_length("w") * 60).cast("long").alias("begin"), at.cast("long").alias("stop"), (F.col("i") == 0).alias("first"))


@query()
def snk_wrapped_vtt(t: Tables) -> DataFrame:
    """Words as cues of two lines of 42 characters; a pause of three seconds ends a cue."""
    rows = writers.wrapped(_timed_words(t), "conv_id", ["turn", "i"], sessions.Layout(width=42, lines=2))
    return writers.cues(rows, "conv_id", "begin", "stop", "text", "vtt")


@query()
def snk_highlighted_srt(t: Tables) -> DataFrame:
    """The same with the spoken word marked, in SRT."""
    rows = writers.wrapped(_timed_words(t), "conv_id", ["turn", "i"], sessions.Layout(width=42, lines=2, highlight=True))
    return writers.cues(rows, "conv_id", "begin", "stop", "text", "srt")


@query()
def snk_wrapped_txt(t: Tables) -> DataFrame:
    """Segments kept as cues, each on one line."""
    rows = writers.wrapped(_timed_words(t), "conv_id", ["turn", "i"], sessions.Layout())
    return writers.cues(rows, "conv_id", "begin", "stop", "text", "txt")


@query()
def mth_keyword_beam(t: Tables) -> DataFrame:
    """A keyword of two event types in each user's frames of symbol chances, by a beam of prefixes."""
    kinds = ("view", "click", "purchase", "signup")
    own = F.least(F.lit(0.3) + F.col("value") / 200, F.lit(0.97))
    chances = F.array(*[F.when(F.col("event_type") == k, own).otherwise((1 - own) / 3) for k in kinds])
    rows = t.events.select("user_id", micros("ts").alias("us"), "event_id", chances.alias("chances"))
    out = run_batch(rows, "user_id", ["us", "event_id"], K.keyword_search({"bought": (1, 2, 3), "clicked": (1, 1)}))
    return out.withColumn("score", F.round("score", 9))


@query()
def flt_decode_quality(t: Tables) -> DataFrame:
    """Texts whose compression tells of repetition."""
    r = t.documents.select("doc_id", udfs.compression_ratio("text").alias("ratio"))
    return r.select("doc_id", F.round("ratio", 4).alias("ratio"), (F.col("ratio") > 2.4).alias("suspect"))


CORE = ("the", "and", "of", "to", "in", "de", "la", "le", "der", "die", "el", "en")
BLACK = ("idiot", "scum", "trash")
_CORE = f"len(list_filter(w, lambda x: x IN {CORE} OR length(x) = 1)) / greatest(len(w), 1)"
_BLACK = f"len(list_filter(w, lambda x: x IN {BLACK})) > 0"


@query(f"WITH w AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents) SELECT doc_id, round({_CORE}, 9) AS core, {_BLACK} AS black, len(w) > 0 AND NOT {_BLACK} AND {_CORE} >= 0.1 AS plausible FROM w")
def flt_plausibility(t: Tables) -> DataFrame:
    """Enough words of a core vocabulary and none of a black list."""
    w = t.documents.select("doc_id", T.tokens(F.col("text")).alias("w"))
    core = F.size(F.filter("w", lambda x: x.isin(*CORE) | (F.char_length(x) == 1))) / F.greatest(F.size("w"), F.lit(1))
    black = F.arrays_overlap("w", F.array(*[F.lit(x) for x in BLACK]))
    return w.select("doc_id", F.round(core, 9).alias("core"), black.alias("black"), ((F.size("w") > 0) & ~black & (core >= 0.1)).alias("plausible"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, 'ou', '[x]'), '<[^>]*>', '', 'g'), '\[.*?\]', '', 'g'), '[Ｏ\[\]&＆|｜]|/sil|endofbreak|FFFF', '', 'g'), '\s+', ' ', 'g')) AS clean FROM documents"""
)
def str_artefact_clean(t: Tables) -> DataFrame:
    """Without tags, bracketed notes and decoder marks."""
    body = F.replace("text", F.lit("ou"), F.lit("[x]"))
    for pattern in (r"<[^>]*>", r"\[.*?\]", r"[Ｏ\[\]&＆|｜]|/sil|endofbreak|FFFF"):
        body = F.regexp_replace(body, pattern, "")
    return t.documents.select("doc_id", T.squeeze(body).alias("clean"))


@query(r"""SELECT doc_id, replace(replace(replace(text, 'tion', 'TION'), 'and', 'AND'), 'th', 'TH') AS fixed, len(regexp_extract_all(text, 'tion')) AS n_first FROM documents""")
def str_hotword_replace(t: Tables) -> DataFrame:
    """Explicit rules applied one after another, the longest first."""
    rules = sorted({"th": "TH", "and": "AND", "tion": "TION"}.items(), key=lambda r: (-len(r[0]), r[0]))
    body = F.col("text")
    for wrong, right in rules:
        body = F.replace(body, F.lit(wrong), F.lit(right))
    return t.documents.select("doc_id", body.alias("fixed"), F.regexp_count("text", F.lit("tion")).cast("long").alias("n_first"))


@query()
def str_cjk_join(t: Tables) -> DataFrame:
    """Parts joined by a space, but not between two Chinese characters (needs look-ahead)."""
    parts = F.array("text", F.lit("风向"), F.lit("二四零"), F.col("lang"))
    joined = F.array_join(parts, "\u0001")
    return t.documents.select("doc_id", F.replace(F.regexp_replace(joined, "([一-鿿])\u0001(?=[一-鿿])", "$1"), F.lit("\u0001"), F.lit(" ")).alias("joined"))


@query()
def str_overlap_merge(t: Tables) -> DataFrame:
    """Rolling transcripts joined at their overlap."""
    n = F.char_length("text")
    a, b = F.left("text", F.floor(n * 2 / 3).cast("int")), F.substring("text", F.floor(n / 3).cast("int") + 1, n)
    rows = t.documents.select("doc_id", udfs.overlap_join(a, b).alias("merged"), "text")
    return rows.select("doc_id", F.col("merged").isNotNull().alias("found"), (F.col("merged") == F.col("text")).alias("whole"))


@query()
def str_text_parts(t: Tables) -> DataFrame:
    """Texts cut into cues of at most 80 characters, with times shared by length."""
    p = t.documents.select("doc_id", F.posexplode(udfs.text_parts("text")).alias("i", "part"))
    w = W.partitionBy("doc_id")
    n = F.char_length("part")
    return p.select("doc_id", "i", "part", F.round(F.lit(60.0) * F.sum(n).over(w.orderBy("i")) / F.sum(n).over(w), 3).alias("end"))


@query()
def str_basic_normal(t: Tables) -> DataFrame:
    """Texts without marks, symbols and punctuation."""
    return t.documents.select("doc_id", udfs.basic_normal("text").alias("plain"))


@query(rf"SELECT doc_id, n, upper(replace(s, ' ', '')) AS abbreviation FROM (SELECT doc_id, len(l) AS n, l[1] AS s FROM (SELECT doc_id, regexp_extract_all({NORM.format('text')}, '\b[a-z](?: [a-z]\b)+') AS l FROM documents)) WHERE n > 0")
def str_abbreviations(t: Tables) -> DataFrame:
    """Letters that stand alone in a row, as abbreviations."""
    found = F.regexp_extract_all(T.norm_text(F.col("text")), F.lit(r"\b[a-z](?: [a-z]\b)+"), F.lit(0))
    rows = t.documents.select("doc_id", found.alias("l")).where(F.size("l") > 0)
    return rows.select("doc_id", F.size("l").cast("long").alias("n"), F.upper(F.replace(F.get("l", F.lit(0)), F.lit(" "), F.lit(""))).alias("abbreviation"))


@query()
def num_slot_grammar(t: Tables) -> DataFrame:
    """Verdicts of the slots of broadcast lines made from events."""
    n = lambda c: F.upper(T.spoken_digits(c.cast("string")))
    line = F.concat_ws(" ", F.lit("WIND"), n(F.col("user_id") + 150), F.lit("AT"), n(F.col("user_id") % 10), F.lit("RUNWAY"), n(F.col("user_id") % 40 + 1), F.lit("ALTIMETER"), n(F.col("event_id") % 900 + 2600))
    rows = t.events.select("event_id", *[c.alias(s) for s, c in slots.check_slots(line).items() if s in ("wind", "runway", "qnh")])
    return rows.select("event_id", F.expr("stack(3, 'wind', wind, 'runway', runway, 'qnh', qnh) AS (slot, verdict)"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value * 20) AS BIGINT) * 60000000 AS b, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, floor(value * 20) DESC, event_id) AS i FROM events),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, CAST([] AS STRUCT(a BIGINT, b BIGINT, id BIGINT)[]) AS taken FROM e UNION ALL
    SELECT e.user_id, e.i, CASE WHEN len(list_filter(taken, lambda y: e.a < y.b AND y.a < e.b)) = 0 THEN list_append(taken, {'a': e.a, 'b': e.b, 'id': e.event_id}) ELSE taken END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, list_sort(list_transform(taken, lambda x: x.id)) AS kept FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""
)
def srt_non_overlapping(t: Tables) -> DataFrame:
    """Spans taken greedily by score, then length, where no taken one overlaps."""
    length = F.floor(F.col("value") * 20)
    rows = t.events.select("user_id", (-F.col("value")).alias("worse"), (-length).alias("shorter"), "event_id", F.col("event_id").alias("id"), micros("ts").alias("a"), (micros("ts") + length * 60000000).alias("b"))
    taken = run_batch(rows, "user_id", ["worse", "shorter", "event_id"], sessions.taking())
    return taken.groupBy("user_id").agg(F.array_sort(F.collect_list("id")).alias("kept"))


@query()
def set_compatible_cluster(t: Tables) -> DataFrame:
    """The largest set of turns of a conversation that are pairwise alike; a turn stands for one candidate text."""
    d = t.conversations.select("conv_id", "turn", T.tokens(F.col("text")).alias("tokens"), F.char_length("text").cast("double").alias("loss"))
    return Q.cluster_candidates(d, "conv_id", "turn", "tokens", "loss", least=0.02)


@query()
def set_agreement_gate(t: Tables) -> DataFrame:
    """Pairs that agree too little ask a third system."""
    p = turn_pairs(t).where("hyp IS NOT NULL").select("conv_id", "turn", T.tokens(F.col("ref")).alias("a"), T.tokens(F.col("hyp")).alias("b"))
    matched = F.aggregate(A.opcodes(F.col("a"), F.col("b")), F.lit(0), lambda s, o: s + F.when(o["tag"] == "equal", o["a1"] - o["a0"]).otherwise(0))
    share = matched / F.greatest(F.size("a"), F.size("b"), F.lit(1))
    return p.select("conv_id", "turn", F.round(share, 9).alias("agreement")).withColumn("ask_third", F.col("agreement") < 0.85)


@query("SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, 'documents' AS origin, n_chars AS n FROM documents UNION ALL SELECT 'b' || CAST(item_id AS VARCHAR), 'benchmark', length(text) FROM benchmark UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), 'conversations', length(text) FROM conversations")
def set_union_candidates(t: Tables) -> DataFrame:
    """Candidates of all sources in one table."""
    n = F.char_length("text").cast("long").alias("n")
    d = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("documents").alias("origin"), F.col("n_chars").alias("n"))
    b = t.benchmark.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.lit("benchmark").alias("origin"), n)
    c = t.conversations.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"), F.lit("conversations").alias("origin"), n)
    return d.unionByName(b).unionByName(c)


@query(
    """WITH RECURSIVE p AS (SELECT x.vec_id, CAST(x.embedding AS DOUBLE[]) AS a, CAST(y.embedding AS DOUBLE[]) AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1),
    r AS (SELECT vec_id, a, b, 0 AS i, list_prepend(0.0::DOUBLE, list_transform(b, lambda x: 'inf'::DOUBLE)) AS row FROM p UNION ALL
    SELECT vec_id, a, b, i + 1, list_prepend('inf'::DOUBLE, list_transform(s, lambda t, j: t + list_min(list_transform(range(1, j + 1), lambda k: least(row[k], row[k + 1]) - CASE WHEN k = 1 THEN 0 ELSE s[k - 1] END)))) FROM
    (SELECT *, list_transform(b, lambda x, j: list_sum(list_transform(b[1:j], lambda y: abs(a[i + 1] - y)))) AS s FROM r WHERE i < len(a))) SELECT vec_id, round(row[len(row)], 6) AS distance FROM r WHERE i = len(a)"""
)
def mth_time_warping(t: Tables) -> DataFrame:
    """Warping distance of neighbouring vectors."""
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(Q.warp_distance("a", "b"), 6).alias("distance"))


@query()
def mth_forced_alignment(t: Tables) -> DataFrame:
    """Labels put onto the frames of each session."""
    e = t.embeddings.select(F.floor(F.col("vec_id") / 25).alias("session"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return Q.align_sessions(e, "session", "vec_id", "v", [1, 2, 2, 5])


@query(
    """SELECT doc_id, list_transform(regexp_extract_all(s, '<\\|([0-9.]+)\\|>', 1), lambda x: CAST(x AS DOUBLE)) AS times, len(regexp_extract_all(s, '<\\|[0-9.]+\\|>')) AS n FROM (SELECT doc_id, '<|0.50|>' || text || '<|' || CAST(n_chars AS VARCHAR) || '.25|>' AS s FROM documents)"""
)
def sup_timestamp_tokens(t: Tables) -> DataFrame:
    """Times written between bars in a text."""
    s = F.concat(F.lit("<|0.50|>"), "text", F.lit("<|"), F.col("n_chars").cast("string"), F.lit(".25|>"))
    times = F.regexp_extract_all(s, F.lit(r"<\|([0-9.]+)\|>"), F.lit(1))
    return t.documents.select("doc_id", F.transform(times, lambda x: x.cast("double")).alias("times"), F.size(times).cast("long").alias("n"))


@query(
    """WITH c AS (SELECT vec_id, embedding AS e FROM embeddings), p AS (SELECT * FROM (VALUES ('012', 1, 5, 9), ('021', 1, 6, 8), ('102', 2, 4, 9), ('120', 2, 6, 7), ('201', 3, 4, 8), ('210', 3, 5, 7)) p(perm, a, b, c))
    SELECT vec_id, arg_min(perm, (round(CAST(e[a] AS DOUBLE) + CAST(e[b] AS DOUBLE) + CAST(e[c.c] AS DOUBLE), 9), perm)) AS perm FROM c JOIN (SELECT perm, a, b, c AS c FROM p) AS c ON TRUE GROUP BY vec_id""".replace("FROM c JOIN (SELECT perm, a, b, c AS c FROM p) AS c ON TRUE", "FROM c AS v, (SELECT perm, a, b, c FROM p) AS c")
)
def sup_best_permutation(t: Tables) -> DataFrame:
    """The assignment of three speakers with the least cost; costs are a three by three table of each row."""
    perms = {"012": (0, 4, 8), "021": (0, 5, 7), "102": (1, 3, 8), "120": (1, 5, 6), "201": (2, 3, 7), "210": (2, 4, 6)}
    x = lambda k: F.col("embedding")[k].cast("double")
    best = F.array_min(F.array(*[F.struct(F.round(x(a) + x(b) + x(c), 9).alias("cost"), F.lit(p).alias("perm")) for p, (a, b, c) in perms.items()]))
    return t.embeddings.select("vec_id", best["perm"].alias("perm"))


@query("SELECT event_id, k, (c >> k) & 1 = 1 AS active FROM (SELECT event_id, event_id % 8 AS c, unnest([0, 1, 2]) AS k FROM events)")
def sup_codes_to_tracks(t: Tables) -> DataFrame:
    """Set codes opened into speaker tracks."""
    rows = t.events.select("event_id", (F.col("event_id") % 8).alias("c"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    return rows.select("event_id", "k", (F.expr("shiftright(c, k)").bitwiseAND(1) == 1).alias("active"))


@query(
    """WITH a AS (SELECT item_id AS pos, 'k' || CAST(item_id AS VARCHAR) AS key FROM benchmark), b AS (SELECT doc_id AS pos, 'k' || CAST(CASE WHEN doc_id % 7 = 3 THEN -1 ELSE doc_id END AS VARCHAR) AS key, n_chars FROM documents)
    SELECT a.pos, CASE WHEN b.pos IS NULL THEN 'missing' WHEN a.key <> b.key THEN 'id mismatch' ELSE 'ok' END AS state, CASE WHEN a.key = b.key THEN CAST(floor((n_chars - 25) / 10) AS BIGINT) + 1 END AS frames FROM a LEFT JOIN b USING (pos)"""
)
def sup_paired_lines(t: Tables) -> DataFrame:
    """Lines of two lists paired by position, with error records; lines shorter than a frame too, whose count is 0 or less as in the reference."""
    a = t.benchmark.select(F.col("item_id").alias("pos"), F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("key"))
    b = t.documents.select(F.col("doc_id").alias("pos"), F.concat(F.lit("k"), F.when(F.col("doc_id") % 7 == 3, -1).otherwise(F.col("doc_id")).cast("string")).alias("other"), "n_chars")
    rows = a.join(b, "pos", "left")
    state = F.when(F.col("other").isNull(), "missing").when(F.col("key") != F.col("other"), "id mismatch").otherwise("ok")
    return rows.select("pos", state.alias("state"), F.when(F.col("key") == F.col("other"), F.floor((F.col("n_chars") - 25) / 10) + 1).alias("frames"))


@query("SELECT d.doc_id, regexp_replace(d.source, '[0-9]+$', '') AS template, b.item_id FROM documents d JOIN benchmark b ON CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS INTEGER) = b.item_id")
def sup_template_lookup(t: Tables) -> DataFrame:
    """Templates found by channel with the suffix stripped; a channel without one stops the query."""
    d = t.documents.select("doc_id", F.regexp_replace("source", "[0-9]+$", "").alias("template"), F.regexp_extract("source", "([0-9]+)$", 1).cast("long").alias("item_id"))
    rows = d.join(t.benchmark.select("item_id", F.lit(True).alias("there")), "item_id", "left")
    return rows.select("doc_id", "template", F.when(F.col("there"), F.col("item_id")).otherwise(F.raise_error(F.lit("no template for a channel"))).alias("item_id"))


@query("SELECT doc_id, word FROM (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY md5('5:' || word || ':' || CAST(doc_id AS VARCHAR))) AS r FROM (SELECT doc_id, unnest(list_distinct(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))) AS word FROM documents)) WHERE r <= 3")
def sup_negative_sampling(t: Tables) -> DataFrame:
    """Three words of each text, drawn without replacement by a seeded hash."""
    w = t.documents.select("doc_id", F.explode(F.array_distinct(F.split(T.squeeze(F.col("text")), " "))).alias("word"))
    key = F.md5(F.concat(F.lit("5:"), "word", F.lit(":"), F.col("doc_id").cast("string")))
    return w.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(key))).where("r <= 3").drop("r")


@query("SELECT user_id, event_id, r FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 16")
def stm_bounded_buffer(t: Tables) -> DataFrame:
    """The newest sixteen entries of each session."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.select("user_id", "event_id", F.row_number().over(w).cast("long").alias("r")).where("r <= 16")


@query()
def met_lag_curve(t: Tables) -> DataFrame:
    """Distance between what was said and what an engine had made of it a turn later, at the end of each turn of a conversation."""
    toks = t.conversations.select("conv_id", F.col("turn"), T.tokens(F.col("text")).alias("w"))
    said = F.transform("w", lambda x, i: F.when((i + F.col("turn")) % 7 == 3, F.lit("noise")).otherwise(x))
    g = toks.select("conv_id", F.struct("turn", "w", said.alias("said")).alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    sizes = F.transform("x", lambda x: F.size(x["w"]))
    e = g.select("conv_id", A.prefix_distances(F.flatten(F.transform("x", lambda x: x["w"])), F.flatten(F.transform("x", lambda x: x["said"])), sizes).alias("d"))
    each = e.select("conv_id", F.inline("d")).where("n_ref > 0")
    return each.groupBy("conv_id").agg(F.round(F.avg(F.col("dist") / F.col("n_ref")), 6).alias("mean_lag"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 % 3600 AS phase FROM events WHERE event_type = 'click'), c AS (SELECT k * 300 AS cut FROM range(0, 12) t(k)),
    v AS (SELECT user_id, cut, count(*) FILTER (WHERE least(abs(phase - cut), 3600 - abs(phase - cut)) < 240) AS votes FROM e, c GROUP BY user_id, cut) SELECT user_id, arg_min(cut, (-votes, cut)) AS cut, max(votes) AS votes FROM v GROUP BY user_id"""
)
def win_phase_vote(t: Tables) -> DataFrame:
    """The cut phase that most pauses support."""
    phase = F.floor(micros("ts") / 1000000) % 3600
    e = t.events.where("event_type = 'click'").select("user_id", phase.alias("phase"), F.explode(F.sequence(F.lit(0), F.lit(3300), F.lit(300))).alias("cut"))
    d = F.abs(F.col("phase") - F.col("cut"))
    v = e.groupBy("user_id", "cut").agg(F.count_if(F.least(d, 3600 - d) < 240).alias("votes"))
    best = F.max(F.struct("votes", (-F.col("cut")).alias("c")))
    return v.groupBy("user_id").agg(best.alias("b")).select("user_id", (-F.col("b.c")).cast("long").alias("cut"), F.col("b.votes").alias("votes"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS score, row_number() OVER (ORDER BY round(avg(value), 6), user_id) AS place FROM events GROUP BY user_id")
def sup_leaderboard_by_mean(t: Tables) -> DataFrame:
    """Places by a mean score; systems are numbered within whole scores, which are put end to end by their counts.

    Means often lie halfway between two millionths, where the order in which doubles are added decides. A system's values are added in
    the order of the table's rows, as by the SQL on one thread, whatever parts Spark reads; partial sums would depend on the parts.
    """
    rows = t.events.select("user_id", "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    up = W.partitionBy("user_id").orderBy("file", "row").rowsBetween(W.unboundedPreceding, 0)
    run = rows.select("user_id", F.count(F.lit(1)).over(up).alias("n"), F.avg("value").over(up).alias("mean"))
    last = run.groupBy("user_id").agg(F.max(F.struct("n", "mean")).alias("x"))
    # the SQL scales before it rounds
    g = last.select("user_id", F.col("x.n").alias("n"), (F.round(F.col("x.mean") * 1e6) / 1e6).alias("score"))
    # as in the SQL, NaN follows numbers, and null follows NaN
    whole = F.coalesce(F.when(~F.isnan("score"), F.floor("score")), F.lit((1 << 63) - 1))
    return M.positions(g, [F.asc_nulls_last("score"), F.asc_nulls_last("user_id")], whole, "place").withColumn("place", F.col("place") + 1)


@query(
    """WITH RECURSIVE m AS (SELECT user_id, epoch_us(ts) AS us FROM events), r AS (SELECT user_id, min(us) AS mark FROM m GROUP BY user_id UNION ALL
    SELECT user_id, mark FROM (SELECT r.user_id, min(m.us) AS mark FROM r JOIN m ON m.user_id = r.user_id AND m.us > r.mark + 21600000000 GROUP BY r.user_id, r.mark)) SELECT user_id, mark FROM r"""
)
def win_kept_marks(t: Tables) -> DataFrame:
    """Marks of each user that lie over six hours after the last kept."""
    rows = t.events.select("user_id", micros("ts").alias("us")).withColumn("at", F.col("us"))
    return run_batch(rows, "user_id", ["us"], sessions.keeping(21_600_000_000)).select("user_id", "mark")
