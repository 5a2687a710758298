"""Quality rules with cross-document line frequency (DataFrame functions only).

Base rules look at one text. The line rule looks at all: lines are normalised (lower case, runs of ASCII white
space to one space, trimmed) and hashed; for each host the distinct documents holding a line are counted. Copies of
one text are one document here: a line is boilerplate where different texts share it, and a text that was copied a
thousand times would else lose all its lines, its first copy too (near-dedup removes copies, and keeps one). Lines in more than max(min_documents, share of the host's
distinct documents) documents are removed wherever they occur in that host, and a document is rejected when
too little of it is left.

Lines are cut and hashed once, into a narrow table that is counted and joined (host, line and text hash, position,
words). Counting is partial before the shuffle, on (host, line, text); counts of frequent lines come back by an
equi-join on (host, line) whose left side adaptive execution may split, so a line in a third of all
documents is spread. Windows of words are compared inside their row; nothing of a text is shuffled
unless the cleaned text itself is asked for.

Cases: a null text has no words and fails, and is no document to the counts; an empty one is, and fails too; null hosts form one host; repeated rows get equal
results; lines without a word are never removed; an empty table gives an empty result; the input's own
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import SPACE, bound, carried, carried_text, prepare, restored, stage, without, words

WINDOW = 8


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of `window` words found twice or more in the same text."""

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return bound(windows, of_windows)

    def of_windows(v: Column) -> Column:
        return F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0).cast("long")).otherwise(bound(F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))

    def of_sorted(s: Column) -> Column:
        starts = F.transform(s, lambda e, k: F.when((F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]), e["i"]))
        starts = F.sort_array(F.filter(starts, lambda x: x.isNotNull()))
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        grow = lambda a, x: F.struct((a["n"] + (x + window - F.greatest(a["end"], x))).alias("n"), (x + window).alias("end"))
        return F.aggregate(starts, none, grow, lambda a: a["n"])

    hashes = F.transform(tokens, lambda x: F.xxhash64(x))
    return F.when(F.size(tokens) < window, F.lit(0).cast("long")).otherwise(bound(hashes, of_hashes))


def normal_lines(text: Column) -> Column:
    """(position among the text's lines, hash, words) of each line that has a word."""

    def line(x: Column, i: Column) -> Column:
        return bound(F.array_remove(F.split(F.lower(x), SPACE), ""), lambda w: F.struct(i.alias("i"), F.xxhash64(F.array_join(w, " ")).alias("h"), F.size(w).alias("n")))

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line), lambda x: x["n"] > 0)


def base_rules(text: Column) -> dict[str, Column]:
    """Columns over a column `_w` of the text's words."""
    body, w = F.coalesce(text, F.lit("")), F.col("_w")
    with_word = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": bound(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(w),
    }


def _keys(docs: DataFrame, id_column: str, text: str, host: str) -> list[Column]:
    return [F.col(id_column).alias("_id"), F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")).alias("_host"), F.when(F.col(text).isNotNull(), F.xxhash64(text)).alias("_text")]


def frequent_lines(docs: DataFrame, share: float, min_documents: int, id_column: str, text: str, host: str) -> DataFrame:
    """For each (_id, _host, _text) with lines above the limit: _bad, an array of (position, words) of those lines."""
    keys = _keys(docs, id_column, text, host)
    lines = docs.select(*keys, F.explode(normal_lines(F.col(text))).alias("_l")).select("_id", "_host", "_text", F.col("_l.h").alias("_h"), F.col("_l.i").alias("_i"), F.col("_l.n").alias("_n"))
    lines = stage(lines, "lines")
    held = lines.groupBy("_host", "_h").agg(F.count_distinct("_text").alias("_docs")).where(F.col("_docs") > min_documents)
    hosts = docs.select(*keys[1:]).groupBy("_host").agg(F.count_distinct("_text").alias("_all"))
    above = held.join(hosts, "_host").where(F.col("_docs") > F.col("_all") * share).select("_host", "_h")
    return lines.join(above, ["_host", "_h"]).groupBy("_id", "_host", "_text").agg(F.collect_set(F.struct("_i", "_n")).alias("_bad"))


def quality_rules(docs: DataFrame, share: float = 0.01, min_documents: int = 10, min_words: int = 20, min_left: float = 0.3, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per input row: `doc` (the row as a struct), the base columns, base_failed, n_removed_words, clean_text, kept."""
    prepare(docs.sparkSession)
    found = frequent_lines(docs, share, min_documents, id_column, text, host)
    base = docs.select(*carried(docs), *_keys(docs, id_column, text, host), words(F.col(text)).alias("_w"))
    body = carried_text(docs, text)
    rules = base_rules(body)
    base = base.select(*base.columns, *[c.alias(n) for n, c in rules.items()]).drop("_w")
    same = base["_id"].eqNullSafe(found["_id"]) & (base["_host"] == found["_host"]) & (base["_text"] == found["_text"])
    joined = base.join(found, same, "left").select(*[base[c] for c in base.columns], "_bad")
    bad = F.transform("_bad", lambda x: x["_i"])
    gone = F.aggregate("_bad", F.lit(0).cast("long"), lambda a, x: a + x["_n"])
    out = joined.select(
        *[c for c in base.columns if c.startswith("_doc")],
        *rules,
        ((F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)).alias("base_failed"),
        F.coalesce(gone, F.lit(0).cast("long")).alias("n_removed_words"),
        F.when(F.col("_bad").isNull(), body).otherwise(without(body, bad)).alias("clean_text"),
    )
    left = F.col("n_words") - F.col("n_removed_words")
    kept = ~F.col("base_failed") & (left >= F.col("n_words") * min_left)
    # the struct is made last, where the optimizer can still take it apart and prune
    return out.select(restored(docs), *rules, "base_failed", "n_removed_words", "clean_text", kept.alias("kept"))
