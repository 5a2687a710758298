"""The queries of the training-data operators: name to function, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table
from tidewater.llm.oracles import ORACLE


def op1_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.toxicity import score_toxicity

    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"), F.transform("offending", lambda x: x["number"]).alias("offending_sentences"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


def op3_kd_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.encode(F.coalesce("clean_text", F.lit("")), "UTF-8"))
    return out.select("doc.doc_id", F.size("deleted").alias("n_deleted_lines"), F.array_join("deleted", ",").alias("deleted_lines"), F.octet_length("clean_text").alias("clean_bytes"), crc.alias("clean_crc32"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.sentencepiece_codec import encode

    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    crc = F.crc32(F.encode(F.array_join("pieces", ","), "UTF-8"))
    return out.select("doc_id", F.octet_length("text").alias("n_bytes"), F.size("pieces").alias("n_pieces"), crc.alias("pieces_crc32"), (F.col("text") == F.col("decoded")).alias("round_trip"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op7_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.quality_crf import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.sharding import interleaved_shards

    return interleaved_shards(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.mixing import mix_sources

    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.token_alignment import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.html_extraction import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.word_runs import digests, find_runs

    return digests(find_runs(table(spark, sf_dir, "documents"), plant=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mil_toxicity,
        op2_quality_rules,
        op3_kd_tree_search,
        op4_line_dedup,
        op5_sentencepiece,
        op6_token_counts,
        op7_crf_quality,
        op8_interleaved_shards,
        op9_minhash_near_dedup,
        op10_mix_sources,
        op11_token_alignment,
        op12_html_extraction,
        op13_word_runs,
    )
}

__all__ = ["ORACLE", "QUERIES"]
