"""Queries over manifests: reading, filters, batches, prompts, subtitle output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions.times import micros, millis
from tidewater.operators import manifest as M
from tidewater.plans.base import Tables, query

WORDS = r"len(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' '))"


def _n_words(c: str):
    return F.size(F.split(T.squeeze(F.col(c)), " "))


@query(
    f"""SELECT doc_id, n_chars // 2 AS source_len, CAST({WORDS.format('text')} AS BIGINT) AS target_len FROM documents
    WHERE n_chars // 2 BETWEEN 40 AND 2048 AND {WORDS.format('text')} BETWEEN 5 AND 2048 AND n_chars // 2 + {WORDS.format('text')} <= 2200"""
)
def flt_length_range(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.floor(F.col("n_chars") / 2).alias("source_len"), _n_words("text").cast("long").alias("target_len"))
    return M.length_filter(rows, F.col("source_len"), F.col("target_len"), min_source=40, min_target=5)


@query("SELECT conv_id, turn, length(text) // 8 AS speech_len, length(text) AS text_len FROM conversations WHERE length(text) // 8 <= 40 AND length(text) <= 2048")
def flt_chat_length(t: Tables) -> DataFrame:
    """Only the upper limits apply to chats."""
    n = F.char_length("text").cast("long")
    rows = t.conversations.select("conv_id", "turn", F.floor(n / 8).alias("speech_len"), n.alias("text_len"))
    return rows.where((F.col("speech_len") <= 40) & (F.col("text_len") <= 2048))


@query("SELECT conv_id, turn, length(text) AS n FROM conversations WHERE length(text) >= 1 AND length(text) BETWEEN 100 AND 900")
def flt_rich_chat_length(t: Tables) -> DataFrame:
    n = F.char_length("text").cast("long")
    return t.conversations.select("conv_id", "turn", n.alias("n")).where((F.col("n") >= 1) & F.col("n").between(100, 900))


@query("SELECT doc_id, coalesce(source, '') AS source, '<ASR>' AS prompt, coalesce(lang, '') AS text_language, CASE WHEN contains(source, 'src1') AND lang <> 'en' THEN replace(text, ' ', '') ELSE text END AS target FROM documents")
def flt_defaults_and_projection(t: Tables) -> DataFrame:
    target = F.when(F.contains("source", F.lit("src1")) & (F.col("lang") != "en"), F.replace("text", F.lit(" "), F.lit(""))).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.lit("<ASR>").alias("prompt"), F.coalesce("lang", F.lit("")).alias("text_language"), target.alias("target"))


@query("SELECT event_id, value FROM events WHERE NOT (CAST(json_extract(props, '$.k') AS BIGINT) > 55 AND value < 20)")
def flt_two_condition_drop(t: Tables) -> DataFrame:
    """Dropped only where both conditions hold."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.where(~((k > 55) & (F.col("value") < 20))).select("event_id", "value")


@query(
    """WITH s AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn) AS m FROM conversations GROUP BY conv_id)
    SELECT conv_id, len(list_filter(m, lambda x: x.role = 'user')) AS n_user, len(list_filter(m, lambda x: x.role = 'assistant')) AS n_assistant, len(list_filter(m, lambda x: x.role = 'system')) AS n_system,
    list_aggregate(list_transform(m, lambda x: '<|' || x.role || '|>' || x.text), 'string_agg', chr(10)) AS prompt FROM s"""
)
def bat_multi_turn_prompt(t: Tables) -> DataFrame:
    """Turns of a conversation put into one prompt, and messages by role."""
    turns = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    n = lambda role: F.size(F.filter("m", lambda x: x["role"] == role)).cast("long").alias(f"n_{role}")
    prompt = F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>"), x["text"])), "\n")
    return turns.select("conv_id", n("user"), n("assistant"), n("system"), prompt.alias("prompt"))


@query(
    """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS total FROM documents)
    SELECT doc_id, pos, CAST(pos // ((total - 1) // 7 + 1) AS INTEGER) AS slice, CAST(pos % 4 AS INTEGER) AS rank, pos // 32 AS batch FROM p"""
)
def bat_slices_ranks_batches(t: Tables) -> DataFrame:
    """File slices, rank strides and fixed-size batches of a dense position."""
    docs = t.documents.select("doc_id")
    rows = M.positions(docs, ["doc_id"], F.floor(F.col("doc_id") / 4096))
    total = docs.agg(F.count(F.lit(1)).alias("total")).scalar()
    return rows.select("doc_id", "pos", M.file_slice(F.col("pos"), total, 7).alias("slice"), (F.col("pos") % 4).cast("int").alias("rank"), F.floor(F.col("pos") / 32).alias("batch"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 256 ORDER BY md5('3:' || CAST(doc_id AS VARCHAR))) - 1 AS place FROM documents")
def bat_seeded_shuffle(t: Tables) -> DataFrame:
    """A permutation that the epoch seeds, within buffers."""
    w = W.partitionBy(F.floor(F.col("doc_id") / 256)).orderBy(F.md5(F.concat(F.lit("3:"), F.col("doc_id").cast("string"))))
    return t.documents.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query("SELECT doc_id, doc_id // 128 AS buffer, (row_number() OVER (PARTITION BY doc_id // 128 ORDER BY n_chars, doc_id) - 1) // 16 AS batch FROM documents")
def bat_buffer_sorted(t: Tables) -> DataFrame:
    """Batches of rows sorted by length within a buffer."""
    buffer = F.floor(F.col("doc_id") / 128)
    w = W.partitionBy(buffer).orderBy("n_chars", "doc_id")
    return t.documents.select("doc_id", buffer.alias("buffer"), F.floor((F.row_number().over(w) - 1) / 16).alias("batch"))


@query(
    """WITH RECURSIVE s AS (SELECT doc_id, n_chars, doc_id // 64 AS buffer, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) AS i FROM documents WHERE n_chars <= 6000),
    r AS (SELECT buffer, i, doc_id, n_chars, 0 + CASE WHEN n_chars <= 8000 THEN 0 ELSE 1 END AS batch, 1 AS rows, n_chars AS longest FROM s WHERE i = 1 UNION ALL
    SELECT s.buffer, s.i, s.doc_id, s.n_chars, CASE WHEN greatest(r.longest, s.n_chars) * (r.rows + 1) <= 8000 THEN r.batch ELSE r.batch + 1 END,
    CASE WHEN greatest(r.longest, s.n_chars) * (r.rows + 1) <= 8000 THEN r.rows + 1 ELSE 1 END, CASE WHEN greatest(r.longest, s.n_chars) * (r.rows + 1) <= 8000 THEN greatest(r.longest, s.n_chars) ELSE s.n_chars END
    FROM r JOIN s ON s.buffer = r.buffer AND s.i = r.i + 1)
    SELECT buffer, doc_id, n_chars, batch FROM r"""
)
def bat_dynamic_tokens(t: Tables) -> DataFrame:
    """Batches whose padded size stays below a budget, in buffers of 64 rows."""
    rows = t.documents.select(F.floor(F.col("doc_id") / 64).alias("buffer"), "doc_id", "n_chars").where("n_chars <= 6000")
    return M.batches_by_tokens(rows, "buffer", ["doc_id"], "n_chars", 8000)


@query("WITH b AS (SELECT vec_id // 16 AS batch, embedding FROM embeddings) SELECT batch, count(*) AS n, max(len(embedding)) AS width, sum(70 - len(embedding)) AS padding FROM b GROUP BY batch", longs=("padding",))
def bat_pad_collate(t: Tables) -> DataFrame:
    """Rows padded to a common width."""
    padded = F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), F.lit(70) - F.size("embedding")))
    rows = t.embeddings.select(F.floor(F.col("vec_id") / 16).alias("batch"), F.size("embedding").cast("long").alias("n"), padded.alias("p"))
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("width"), F.sum(F.size("p") - F.col("n")).alias("padding"))


@query(
    """WITH k AS (SELECT 'u' || CAST(doc_id AS VARCHAR) || ' ' || replace(text, chr(10), ' ') AS line FROM documents)
    SELECT split_part(line, ' ', 1) AS key, substr(line, length(split_part(line, ' ', 1)) + 2) AS value FROM k"""
)
def src_key_value_lines(t: Tables) -> DataFrame:
    """Lines of a key and an optional value."""
    lines = t.documents.select(F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("line"))
    parts = F.split("line", " ", 2)
    return lines.select(parts[0].alias("key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("value"))


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def src_join_by_first_list(t: Tables) -> DataFrame:
    """Manifest columns joined on the key; the first list decides the rows."""
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")


@query("SELECT doc_id, string_split(text, ' ')[2:4] AS fields_2_4, string_split(text, ' ')[3:] AS fields_3 FROM documents")
def src_field_slice(t: Tables) -> DataFrame:
    """Fields by position, counted from one."""
    f = F.split("text", " ")
    return t.documents.select("doc_id", F.slice(f, 2, 3).alias("fields_2_4"), F.slice(f, F.lit(3), F.greatest(F.size(f), F.lit(1))).alias("fields_3"))


@query(
    """WITH p AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, user_id AS session, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(value * 100) AS BIGINT) AS end_ms, k FROM p"""
)
def src_word_events(t: Tables) -> DataFrame:
    """Events as timed words; milliseconds are the one unit of time."""
    start = millis("ts")
    return t.events.select("event_id", F.col("user_id").alias("session"), start.alias("start_ms"), (start + F.floor(F.col("value") * 100)).alias("end_ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    """WITH d AS (SELECT lang AS k, doc_id % 97 AS id FROM documents) SELECT id, count(*) AS n, count(DISTINCT k) AS n_lists FROM d GROUP BY id HAVING count(*) > 1"""
)
def snk_duplicate_keys(t: Tables) -> DataFrame:
    """Keys that a writer would warn of."""
    return t.documents.groupBy((F.col("doc_id") % 97).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("n_lists")).where("n > 1")


@query("SELECT doc_id, 'only_documents' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'only_labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def snk_id_mismatch(t: Tables) -> DataFrame:
    """Ids of one list that its sibling lacks, both ways."""
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    return a.join(b, "doc_id", "left_anti").withColumn("side", F.lit("only_documents")).unionByName(b.join(a, "doc_id", "left_anti").withColumn("side", F.lit("only_labels")))


@query(
    r"""WITH c AS (SELECT conv_id, turn, turn * 2500 AS s, turn * 2500 + 2000 AS e, replace(text, chr(10), ' ') AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT conv_id, string_agg(CAST(n AS VARCHAR) || chr(10) || lpad(CAST(s // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(s % 1000 AS VARCHAR), 3, '0')
    || ' --> ' || lpad(CAST(e // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(e // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(e // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(e % 1000 AS VARCHAR), 3, '0') || chr(10) || w || chr(10), chr(10) ORDER BY n) AS srt,
    string_agg(printf('%.3f', s / 1000.0) || chr(9) || printf('%.3f', e / 1000.0) || chr(9) || w, chr(10) ORDER BY n) AS tsv FROM c GROUP BY conv_id"""
)
def snk_subtitles(t: Tables) -> DataFrame:
    """Cues of a session as SRT and as tab-separated seconds."""
    s = F.col("turn") * 2500
    w = F.replace("text", F.lit("\n"), F.lit(" "))
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    cue = F.concat(n.cast("string"), F.lit("\n"), T.srt_time(s), F.lit(" --> "), T.srt_time(s + 2000), F.lit("\n"), w, F.lit("\n"))
    line = F.concat_ws("\t", F.format_string("%.3f", s / 1000), F.format_string("%.3f", (s + 2000) / 1000), w)
    rows = t.conversations.select("conv_id", n.alias("n"), cue.alias("cue"), line.alias("line"))
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "cue", "line"))).alias("c"))
    return got.select("conv_id", F.array_join("c.cue", "\n").alias("srt"), F.array_join("c.line", "\n").alias("tsv"))


@query("SELECT event_id, CASE WHEN value >= 100 THEN 'A' WHEN value >= 50 THEN 'B' WHEN value >= 10 THEN 'C' ELSE 'D' END AS grade FROM events")
def snk_grade_bands(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select("event_id", F.when(v >= 100, "A").when(v >= 50, "B").when(v >= 10, "C").otherwise("D").alias("grade"))


@query("WITH s AS (SELECT DISTINCT source FROM documents) SELECT CAST(max(CAST(regexp_extract(source, 'src([0-9]+)', 1) AS INTEGER)) + 1 AS INTEGER) AS next_version FROM s")
def snk_next_version(t: Tables) -> DataFrame:
    return t.documents.agg((F.max(F.regexp_extract("source", "src([0-9]+)", 1).cast("int")) + 1).alias("next_version"))


@query("SELECT doc_id, k, k * 2000 AS begin, least((k + 1) * 2000, n_chars) AS stop FROM (SELECT doc_id, n_chars, unnest(range(0, (n_chars + 1999) // 2000)) AS k FROM documents)")
def sup_tile_windows(t: Tables) -> DataFrame:
    """Fixed windows that tile a length."""
    rows = t.documents.where("n_chars > 0").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_chars") - 1) / 2000))).alias("k"))
    return rows.select("doc_id", "k", (F.col("k") * 2000).alias("begin"), F.least((F.col("k") + 1) * 2000, F.col("n_chars")).alias("stop"))


@query(
    """SELECT item_id, k, list_aggregate(w[1:k], 'string_agg', ' ') AS prefix FROM (SELECT item_id, w, unnest(range(2, len(w) + 1)) AS k FROM (SELECT item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark))"""
)
def sup_prefix_expansion(t: Tables) -> DataFrame:
    """Growing prefixes of each phrase, of two words to all."""
    w = t.benchmark.select("item_id", F.split(T.squeeze(F.col("text")), " ").alias("w")).where(F.size("w") >= 2)
    rows = w.select("item_id", "w", F.explode(F.sequence(F.lit(2), F.size("w"))).alias("k"))
    return rows.select("item_id", F.col("k").cast("long").alias("k"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("prefix"))


@query("SELECT doc_id, coalesce(nullif(lang, 'en'), CASE WHEN doc_id % 2 = 0 THEN 'auto' ELSE NULL END, 'unknown') AS resolved FROM documents")
def sup_resolve_language(t: Tables) -> DataFrame:
    asked = F.nullif(F.col("lang"), F.lit("en"))
    return t.documents.select("doc_id", F.coalesce(asked, F.when(F.col("doc_id") % 2 == 0, "auto"), F.lit("unknown")).alias("resolved"))


@query("SELECT doc_id, source, 0 AS added FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, source, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def sup_idempotent_append(t: Tables) -> DataFrame:
    """All documents are appended to those that have labels; a row is added only where its id is not there yet."""
    have = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "source", F.lit(0).alias("added"))
    new = t.documents.select("doc_id", "source", F.lit(1).alias("added"))
    return have.unionByName(new.join(have.select("doc_id"), "doc_id", "left_anti"))


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN '[override]' ELSE d.text END AS text, CASE WHEN l.toxic = 1 THEN d.source || ' (flagged)' ELSE d.source END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)")
def sup_keyed_override(t: Tables) -> DataFrame:
    """Text replaced where evidence names its key, with the reason appended."""
    rows = t.documents.join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    hit = F.col("toxic") == 1
    return rows.select("doc_id", F.when(hit, "[override]").otherwise(F.col("text")).alias("text"), F.when(hit, F.concat("source", F.lit(" (flagged)"))).otherwise(F.col("source")).alias("reason"))


@query(
    """WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents)
    SELECT doc_id, coalesce(nullif(list_position(list_transform(w, lambda x: lower(x)), 'the'), 0), len(w)) AS cut_at, list_aggregate(w[1:coalesce(nullif(list_position(list_transform(w, lambda x: lower(x)), 'the'), 0), len(w))], 'string_agg', ' ') AS head FROM w"""
)
def sup_truncate_at_first(t: Tables) -> DataFrame:
    """Words up to the first closing word."""
    w = t.documents.select("doc_id", F.split(T.squeeze(F.col("text")), " ").alias("w"))
    at = F.array_position(F.transform("w", lambda x: F.lower(x)), "the")
    cut = F.when(at > 0, at).otherwise(F.size("w")).cast("int")
    return w.select("doc_id", cut.cast("long").alias("cut_at"), F.array_join(F.slice("w", F.lit(1), cut), " ").alias("head"))


@query(
    """WITH c AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS id FROM range(0, 64) t(k) WHERE bit_count(k) <= 3), s AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, bit_or(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 WHEN 'error' THEN 16 ELSE 32 END) AS k FROM events GROUP BY ALL)
    SELECT user_id, day, CAST(k AS BIGINT) AS k, bit_count(k) AS n, id FROM s LEFT JOIN c USING (k)"""
)
def sup_power_set_codes(t: Tables) -> DataFrame:
    """The set of tracks that are active in each day of a session, as the dense label of sets of at most three of six; larger sets have none."""
    # 64 rows, whatever the data
    codes = t.spark.range(64).select(F.col("id").alias("k")).where(F.bit_count("k") <= 3)
    codes = codes.select("k", (F.row_number().over(W.orderBy("k")) - 1).cast("long").alias("id"))
    bit = F.lit(32)
    for k, name in enumerate(("view", "click", "purchase", "signup", "error")):
        bit = F.when(F.col("event_type") == name, 1 << k).otherwise(bit)
    sets = t.events.groupBy("user_id", F.floor(micros("ts") / 86_400_000_000).alias("day")).agg(F.bit_or(bit.cast("long")).alias("k"))
    return sets.join(F.broadcast(codes), "k", "left").select("user_id", "day", "k", F.bit_count("k").alias("n"), "id")
