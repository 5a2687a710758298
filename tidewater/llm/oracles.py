"""SQL for the queries whose rows it can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"
WORDS = rf"list_filter(regexp_split_to_array({{0}}, '{SPACE}+'), lambda x: x <> '')"

OP2 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, text AS raw, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
v AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p || ' ' || lead(x, 3) OVER p || ' ' || lead(x, 4) OVER p || ' ' || lead(x, 5) OVER p || ' ' || lead(x, 6) OVER p || ' ' || lead(x, 7) OVER p AS g FROM k WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM v WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, range(0, 8) t(o) GROUP BY doc_id),
l AS (SELECT doc_id, source, raw, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT doc_id, source, raw, line, array_to_string({WORDS.format('lower(line)')}, ' ') AS norm, len({WORDS.format('line')}) AS nw FROM l),
q AS (SELECT * FROM n WHERE norm <> ''),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM q GROUP BY doc_id),
h AS (SELECT source, count(DISTINCT raw) AS total FROM d GROUP BY source),
f AS (SELECT q.source, norm FROM q JOIN h ON q.source IS NOT DISTINCT FROM h.source GROUP BY q.source, norm, total HAVING count(DISTINCT raw) > 10 AND count(DISTINCT raw) > total * 0.01),
g AS (SELECT doc_id, sum(nw) AS gone FROM q JOIN f ON q.source IS NOT DISTINCT FROM f.source AND q.norm = f.norm GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_words FROM d LEFT JOIN c USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN g USING (doc_id)),
x AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM b)
SELECT *, NOT base_failed AND n_words - n_removed_words >= n_words * 0.3 AS kept FROM x
"""

OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: CRC-32 by its table of 256 remainders, made from the reversed polynomial.
OP8 = """
WITH RECURSIVE c AS (SELECT b, 0 AS k, b::BIGINT AS v FROM range(0, 256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8),
t AS (SELECT list(v ORDER BY b) AS tab FROM c WHERE k = 8),
d AS (SELECT doc_id, coalesce('s' || source, '') AS source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h, tab FROM documents, t),
e AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d),
m AS (SELECT *, md5('7:' || CAST(doc_id AS VARCHAR) || ':' || CAST(text_crc32 AS VARCHAR)) AS key FROM e),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 1 + 0.5)::DOUBLE / count(*) OVER (PARTITION BY source) AS f FROM m),
p AS (SELECT *, row_number() OVER (ORDER BY f, source, key, doc_id) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 8 // n AS INTEGER) AS shard, CAST(pos - ((pos * 8 // n) * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(c.seen) AS component_id, min(c.seen) = d.doc_id AS kept FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

ORACLE = {"op2_quality_rules": OP2, "op3_kd_tree_search": OP3, "op8_interleaved_shards": OP8, "op9_minhash_near_dedup": OP9}
