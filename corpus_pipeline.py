"""The corpus pipeline: documents through five of the training-data operators, each stage stored and read again.

Every stage takes what its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table
from tidewater.llm.line_dedup import dedup_lines
from tidewater.llm.mixing import mix_sources
from tidewater.llm.near_dedup import near_duplicates
from tidewater.llm.quality_rules import quality_rules
from tidewater.llm.sentencepiece_codec import encode
from tidewater.sources.scratch import new_path, remove_path


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of `doc`, with clean_text as the text and n_chars to match."""
    new = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}
    return rows.select(*[(new[c] if c in new else F.col("doc")[c]).alias(c) for c in columns])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the frequency limits go from the others."""
    return _with_text(quality_rules(docs).where("kept"), docs.columns)


def drop_repeated_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks go from the later documents; documents of which no word is left go."""
    out = dedup_lines(docs)
    empty = (F.size("deleted") > 0) & ~F.col("clean_text").rlike(r"[^\x20\x09-\x0D]")
    return _with_text(out.where(~F.coalesce(empty, F.lit(False))), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id. Linked as in op9, by four-word shingles."""
    lost = near_duplicates(docs, width=4, marks=True).where("stands AND NOT kept").select("doc_id", F.col("text_hash").alias("_lost")).distinct()
    # merged, not broadcast: how many documents are lost grows with the data; another text under a lost one's id stays
    same = (docs["doc_id"] == lost["doc_id"]) & (F.xxhash64(docs["text"]) == F.col("_lost"))
    return docs.join(lost.hint("merge"), same, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mixture takes it."""
    out = mix_sources(docs).where("copies > 0")
    rows = out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, and whether they decode to it."""
    out = encode(docs, decoded="decoded")
    return out.select("doc_id", "source", "n_chars", "pieces", F.size("pieces").alias("n_pieces"), (F.col("text") == F.col("decoded")).alias("round_trip"))


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_blocks),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("sentencepiece", to_pieces),
]

#: SQL has no SentencePiece, patience diff or MinHash; tests/llm checks the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
