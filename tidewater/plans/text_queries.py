"""Queries over texts: normalisation, tokens, vocabulary, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.plans.base import Tables, query

NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9''\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TOKENS = "list_filter(string_split(" + NORM + ", ' '), lambda x: x <> '')"


@query(f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def str_norm_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.norm_text(F.col("text")).alias("norm"))


@query(
    f"""WITH a AS (SELECT event_id, {NORM.format("event_type || ' ' || CAST(value AS VARCHAR) || ' ft hpa st' || CAST(user_id AS VARCHAR)")} AS s FROM events),
    b AS (SELECT event_id, replace(regexp_replace(regexp_replace(regexp_replace(s, '([0-9])', '\\1~', 'g'), '~([^0-9])', '\\1', 'g'), '~$', ''), '~', ' ') AS s FROM a),
    c AS (SELECT event_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(s, '0', 'zero'), '1', 'one'), '2', 'two'), '3', 'three'), '4', 'four'), '5', 'five'), '6', 'six'), '7', 'seven'), '8', 'eight'), '9', 'nine') AS s FROM b)
    SELECT event_id, list_aggregate(list_filter(list_transform(string_split(s, ' '), lambda x: CASE x WHEN 'st' THEN 'saint' WHEN 'john''s' THEN 'johns' WHEN 'ft' THEN 'feet' WHEN 'hpa' THEN '' ELSE x END), lambda x: x <> ''), 'string_agg', ' ') AS spoken FROM c"""
)
def str_norm_asr(t: Tables) -> DataFrame:
    said = F.concat("event_type", F.lit(" "), F.col("value").cast("string"), F.lit(" ft hpa st"), F.col("user_id").cast("string"))
    return t.events.select("event_id", T.norm_asr(said).alias("spoken"))


@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, coalesce({TOKENS.format('text')}[1], '') AS first_token FROM documents")
def str_tokens(t: Tables) -> DataFrame:
    toks = T.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.coalesce(F.get(toks, F.lit(0)), F.lit("")).alias("first_token"))


@query(r"""SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(upper(event_type || ' ' || CAST(value AS VARCHAR)), '([0-9])\.([0-9])', '\1 POINT \2', 'g'), '[^A-Z0-9''\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM events""")
def str_norm_upper(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.norm_upper(F.concat("event_type", F.lit(" "), F.col("value").cast("string"))).alias("norm"))


@query(r"SELECT doc_id, trim(regexp_replace('<|' || lang || '|><|' || source || '|> ' || text, '<\|[^|]*\|>', '', 'g')) AS body FROM documents")
def str_strip_tags(t: Tables) -> DataFrame:
    marked = F.concat(F.lit("<|"), "lang", F.lit("|><|"), "source", F.lit("|> "), "text")
    return t.documents.select("doc_id", T.strip_tags(marked).alias("body"))


@query(
    r"""SELECT doc_id, CAST(CASE WHEN contains(trim(text), ' ') THEN len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) ELSE length(trim(text)) END AS BIGINT) AS context_len,
    CASE WHEN regexp_matches(text, '[!-/:-@\[-`{-~，。、；：？！（）【】《》〈〉「」『』〔〕［］｛｝～·…—–]') THEN '<|withitn|>' ELSE '<|woitn|>' END AS itn FROM documents"""
)
def src_lengths_and_flags(t: Tables) -> DataFrame:
    flag = F.when(T.has_punctuation(F.col("text")), "<|withitn|>").otherwise("<|woitn|>")
    return t.documents.select("doc_id", T.context_length(F.col("text")).cast("long").alias("context_len"), flag.alias("itn"))


@query(
    r"""SELECT doc_id, CASE WHEN length(text) = 0 THEN 'zh' WHEN length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g'))
    AND length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) > length(text) * 0.3 THEN 'zh' ELSE 'en' END AS guess FROM documents"""
)
def sup_language_guess(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.guess_language(F.col("text")).alias("guess"))


@query(r"SELECT doc_id, regexp_replace(text, '[!-/:-@\[-`{-~。？！，、；：“”‘’（）《》【】…—～·]', '', 'g') AS bare FROM documents")
def sup_strip_punctuation(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.strip_punctuation(F.col("text")).alias("bare"))


@query(
    r"""WITH s AS (SELECT CAST(event_id AS VARCHAR) AS k, CAST(value AS VARCHAR) AS s FROM events UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), text FROM documents UNION ALL SELECT 'e' || CAST(event_id AS VARCHAR), event_type FROM events)
    SELECT k, CASE WHEN regexp_full_match(s, '[0-9,.!?:;，。！？：；、%''\s]+') THEN 'number' WHEN regexp_full_match(s, '[A-Za-z0-9,.!?:;，。！？：；、%''\s~-]+') THEN 'english'
    WHEN regexp_full_match(s, '[\x{4e00}-\x{9fa5}A-Za-z0-9,.!?:;，。！？：；、%''\s~-]+') THEN 'mixed' ELSE 'other' END AS script FROM s"""
)
def sup_script_predicates(t: Tables) -> DataFrame:
    key = F.col("event_id").cast("string")
    rows = t.events.select(key.alias("k"), F.col("value").cast("string").alias("s"))
    rows = rows.unionByName(t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("k"), F.col("text").alias("s")))
    rows = rows.unionByName(t.events.select(F.concat(F.lit("e"), key).alias("k"), F.col("event_type").alias("s")))
    return rows.select("k", T.script_of(F.col("s")).alias("script"))


@query(
    r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text || CASE WHEN doc_id %% 7 = 0 THEN '. Thank you, thank you. It was a box  dog! Done.' ELSE '' END, '([.!?。！？]+)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents)
    SELECT doc_id, len(l) AS n_sentences, l[1] AS first_sentence, list_aggregate(list_filter(l, lambda x: NOT regexp_matches(lower(x), '%s')), 'string_agg', ' ') AS clean FROM s"""
    % "|".join(T.MADE_UP).replace("'", "''")
)
def flt_drop_sentences(t: Tables) -> DataFrame:
    said = F.concat("text", F.when(F.col("doc_id") % 7 == 0, ". Thank you, thank you. It was a box  dog! Done.").otherwise(""))
    s = T.sentences(said)
    clean = T.drop_sentences(said, "|".join(T.MADE_UP))
    return t.documents.select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.get(s, F.lit(0)).alias("first_sentence"), F.when(clean != "", clean).alias("clean"))


@query(
    """SELECT event_id, lpad(CAST((CAST(round(value * 987.0) AS BIGINT) // 3600000) % 100 AS VARCHAR), 2, '0') || ':' || lpad(CAST((CAST(round(value * 987.0) AS BIGINT) // 60000) % 60 AS VARCHAR), 2, '0') || ':'
    || lpad(CAST((CAST(round(value * 987.0) AS BIGINT) // 1000) % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(CAST(round(value * 987.0) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS stamp FROM events"""
)
def str_srt_time(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.srt_time(F.col("value") * 987.0).alias("stamp"))


@query(
    """SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(%s) AS token FROM documents) GROUP BY token HAVING count(*) > 3 ORDER BY n DESC, token LIMIT 500"""
    % TOKENS.format("text")
)
def agg_vocabulary(t: Tables) -> DataFrame:
    """Words above a cutoff, the most frequent first, capped."""
    rows = t.documents.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    counts = rows.groupBy("doc_id", "token").count().groupBy("token").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_docs"))
    return counts.where("n > 3").orderBy(F.desc("n"), "token").limit(500)


@query(
    """WITH k AS (SELECT doc_id, unnest(%s) AS token FROM documents), v AS (SELECT token FROM k GROUP BY token ORDER BY count(*) DESC, token LIMIT 300)
    SELECT lang, count(*) AS n_tokens, count(*) FILTER (WHERE v.token IS NULL) AS n_oov, round(100.0 * count(*) FILTER (WHERE v.token IS NULL) / count(*), 6) AS oov_rate
    FROM k JOIN documents d USING (doc_id) LEFT JOIN v ON k.token = v.token GROUP BY lang"""
    % TOKENS.format("text")
)
def agg_oov_rate(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("lang", "token").count()
    # the vocabulary is 300 rows
    known = rows.groupBy("token").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "token").limit(300).select("token", F.lit(1).alias("known"))
    out = rows.join(F.broadcast(known), "token", "left").groupBy("lang").agg(F.sum("count").alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("count"))), F.lit(0)).alias("n_oov"))
    return out.withColumn("oov_rate", F.round(F.lit(100.0) * F.col("n_oov") / F.col("n_tokens"), 6))


@query(
    """WITH k AS (SELECT doc_id, unnest(list_distinct(%s)) AS token FROM documents), v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 2 AS id FROM k GROUP BY token ORDER BY count(*) DESC, token LIMIT 1000)
    SELECT doc_id, CAST(sum(coalesce(id, 1)) AS BIGINT) AS id_sum, count(*) FILTER (WHERE id IS NULL) AS n_unk FROM k LEFT JOIN v USING (token) GROUP BY doc_id"""
    % TOKENS.format("text")
)
def str_token_ids(t: Tables) -> DataFrame:
    """Tokens to ids by a bounded vocabulary; 1 is the unknown token."""
    k = t.documents.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    top = k.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(1000)
    # the vocabulary is 1,000 rows
    v = top.withColumn("id", F.row_number().over(W.orderBy(F.desc("n"), "token")) + 2).select("token", "id")
    return k.join(F.broadcast(v), "token", "left").groupBy("doc_id").agg(F.sum(F.coalesce("id", F.lit(1))).cast("long").alias("id_sum"), F.count_if(F.col("id").isNull()).alias("n_unk"))


@query(
    """WITH x AS (SELECT d.doc_id, b.item_id, list_distinct(%s) AS a, list_distinct(%s) AS b FROM documents d JOIN benchmark b ON d.doc_id %% 40 = b.item_id)
    SELECT doc_id, item_id, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 9) AS jaccard FROM x"""
    % (TOKENS.format("d.text"), TOKENS.format("b.text"))
)
def set_jaccard(t: Tables) -> DataFrame:
    """Token-set overlap of each document with its reference text."""
    b = t.benchmark.select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("b"))
    d = t.documents.select("doc_id", (F.col("doc_id") % 40).alias("item_id"), F.array_distinct(T.tokens(F.col("text"))).alias("a"))
    score = F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.size(F.array_union("a", "b")))
    return d.join(b, "item_id").select("doc_id", "item_id", F.round(score, 9).alias("jaccard"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(lower(text), '\b(?:the|and|of)\b')) - len(regexp_extract_all(lower(text), '\b(?:idiot|trash|scum)\b')) AS term_score FROM documents"""
)
def str_term_score(t: Tables) -> DataFrame:
    """Wanted terms less unwanted ones."""
    low = F.lower("text")
    return t.documents.select("doc_id", (F.regexp_count(low, F.lit(r"\b(?:the|and|of)\b")) - F.regexp_count(low, F.lit(r"\b(?:idiot|trash|scum)\b"))).cast("long").alias("term_score"))


@query(
    r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents)
    SELECT doc_id, CAST(k AS INTEGER) AS instance, list_aggregate(w[k * 75 + 1 : k * 75 + 75], 'string_agg', ' ') AS words FROM (SELECT doc_id, w, unnest(range(0, len(w) // 75)) AS k FROM w)"""
)
def str_fixed_instances(t: Tables) -> DataFrame:
    """Whole runs of 75 words."""
    w = t.documents.select("doc_id", F.split(T.squeeze(F.col("text")), " ").alias("w")).where(F.size("w") >= 75)
    rows = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor(F.size("w") / 75).cast("int") - 1)).alias("instance"))
    return rows.select("doc_id", "instance", F.array_join(F.slice("w", F.col("instance") * 75 + 1, F.lit(75)), " ").alias("words"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9'']+|[^\sA-Za-z0-9'']')) AS n_units FROM documents")
def str_mixed_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.words_cjk(F.col("text"))).cast("long").alias("n_units"))


@query(
    r"""WITH r AS (SELECT conv_id, turn, regexp_replace(role, 'er$', '') AS stem, string_split(text, '') AS c FROM conversations)
    SELECT conv_id, turn, stem, len(list_filter(c, lambda x: x <> ' ')) AS n_chars, list_aggregate(list_transform(string_split(stem, 's'), lambda x: x || '_'), 'string_agg', '') AS pieces FROM r"""
)
def str_char_tokens(t: Tables) -> DataFrame:
    """Character tokens without blanks, and pieces of a split label."""
    stem = F.regexp_replace("role", "er$", "")
    chars = F.filter(F.split("text", ""), lambda c: (c != " ") & (c != ""))
    return t.conversations.select("conv_id", "turn", stem.alias("stem"), F.size(chars).cast("long").alias("n_chars"), F.array_join(F.transform(F.split(stem, "s"), lambda x: F.concat(x, F.lit("_"))), "").alias("pieces"))


@query(
    r"""SELECT event_id, replace(CAST(value AS VARCHAR), '.', '') AS canon, CASE WHEN value >= 118 AND value <= 136.975 AND CAST(round(value * 1000) AS BIGINT) % 25 = 0 THEN 'ok' WHEN value >= 118 AND value <= 136.975 THEN 'off_grid' ELSE 'out_of_band' END AS band FROM events"""
)
def num_canonical_and_grid(t: Tables) -> DataFrame:
    """Canonical number, and whether a frequency lies in the band and on its 25 kHz grid."""
    v = F.col("value")
    inside = (v >= 118) & (v <= 136.975)
    band = F.when(inside & (F.round(v * 1000).cast("long") % 25 == 0), "ok").when(inside, "off_grid").otherwise("out_of_band")
    return t.events.select("event_id", T.canonical_number(v.cast("string")).alias("canon"), band.alias("band"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
    SELECT doc_id, min(pos) AS first_match, arg_min(regexp_extract(line, '^(\S+) (\S+)', 2), pos) AS second_word, count(*) AS n_lines FROM l WHERE regexp_matches(line, '^\S+ \S+') GROUP BY doc_id"""
)
def num_numbered_lines(t: Tables) -> DataFrame:
    """Lines that fit a pattern; the first wins."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.col("line").rlike(r"^\S+ \S+"))
    return lines.groupBy("doc_id").agg((F.min("p") + 1).cast("long").alias("first_match"), F.min_by(F.regexp_extract("line", r"^(\S+) (\S+)", 2), "p").alias("second_word"), F.count(F.lit(1)).alias("n_lines"))


@query()
def str_repetition_cut(t: Tables) -> DataFrame:
    """Texts cut after the first of three or more repeats of a word (needs a back-reference)."""
    cut = F.regexp_replace("text", r"(?s)\b(\w+)(?:\s+\1\b){2,}.*", "$1")
    return t.documents.select("doc_id", cut.alias("cut"), (cut != F.col("text")).alias("repeats"))


@query()
def str_grammar_completion(t: Tables) -> DataFrame:
    """Fixed broadcast words added where they lack (needs look-around)."""
    shout = F.concat(F.upper("event_type"), F.lit(" FREQUENCY "), T.norm_asr(F.col("user_id").cast("string")), F.lit(" ONE TWO ONE FIVE WEATHER AT ONE THREE ZERO ZERO WIND THAT YOU HAVE INFORMATION A"))
    out = t.events.select("event_id", T.complete_grammar(F.upper(shout)).alias("g"))
    return out.select("event_id", "g.text", "g.fixes")


_SAID = "text || ' arnav wether ' || source || ' visability whether alcimber'"


@query(
    rf"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(upper({NORM.format(_SAID)}), 'ARNAV', 'RNAV'), 'VISABILITY', 'VISIBILITY'), 'WETHER', 'WEATHER'), 'WHETHER', 'WEATHER'), 'ALCIMBER', 'ALTIMETER'), '\s+', ' ', 'g')) AS fixed FROM documents"""
)
def str_phrase_rules(t: Tables) -> DataFrame:
    """Misspelt broadcast words put right, one rule after another."""
    said = F.concat("text", F.lit(" arnav wether "), "source", F.lit(" visability whether alcimber"))
    return t.documents.select("doc_id", T.apply_phrases(T.norm_text(said)).alias("fixed"))


@query(
    """WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS b FROM pages)
    SELECT page_id, trim(regexp_replace(b, '\\s+', ' ', 'g')) AS body FROM h"""
)
def src_page_text(t: Tables) -> DataFrame:
    """Text of a marked-up page."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", " ")
    return t.pages.select("page_id", T.squeeze(bare).alias("body"))
