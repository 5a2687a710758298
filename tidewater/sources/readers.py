"""Readers of manifests and lists. Every schema is stated; nothing is inferred."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "key string, source string, target string, prompt string, source_len long, target_len long, text_language string, emo_target string, event_target string, with_or_wo_itn string"
CHAT = "key string, messages array<struct<role:string,content:string>>, speech_length long, text_length long"
WORD_EVENT = "run string, pos int, emit_audio_t double, word string, att_start double, att_end double, src string"
_WAVE = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])


def manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Utterances, one JSON object a line; absent fields take their defaults."""
    rows = spark.read.schema(MANIFEST).json(paths)
    return rows.withColumns({"prompt": F.coalesce("prompt", F.lit("<ASR>")), "source_len": F.coalesce("source_len", F.lit(1).cast("long")), "target_len": F.coalesce("target_len", F.lit(0).cast("long"))})


def refresh_lengths(rows: DataFrame, lengths: dict[str, Column]) -> DataFrame:
    """The manifest with lengths measured anew, by column; other columns stay."""
    return rows.withColumns({c: x.cast("long") for c, x in lengths.items()})


EXPERIMENT = {"final": "run string, text string", "events": "run string, at double, text string", "snapshots": "run string, at double, text string", "meta": "run string, seed long"}


def experiments(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of all experiments below a folder, one JSON object a line: final texts, timed words, snapshots, settings."""
    return {part: spark.read.schema(schema).json(f"{path}/{part}") for part, schema in EXPERIMENT.items()}


def manifest_from_lists(spark: SparkSession, list_path: str) -> DataFrame:
    """The manifests that a text file names, a path a line. The list is short: one row for each file."""
    paths = [r.value.strip() for r in spark.read.text(list_path).where(F.trim("value") != "").collect()]
    return manifest(spark, paths)


def chat_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Chats with their messages by role; a lone system message serves every user turn."""
    rows = spark.read.schema(CHAT).json(paths)
    of = lambda role: F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"])
    rows = rows.select("key", of("system").alias("system"), of("user").alias("user"), of("assistant").alias("assistant"), F.floor(F.coalesce("speech_length", F.lit(-1)) / 8).alias("speech_len"), F.coalesce("text_length", F.lit(0).cast("long")).alias("text_len"))
    return rows.withColumn("system", F.flatten(F.array_repeat("system", F.size("user"))))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a key and the rest."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(parts[0].alias("key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("value"))


def kaldi_segments(spark: SparkSession, path: str) -> DataFrame:
    """utt, rec, st, et."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(p[0].alias("utt"), p[1].alias("rec"), p[2].cast("double").alias("st"), p[3].cast("double").alias("et"))


def speaker_lists(spark: SparkSession, utt2spk: str) -> DataFrame:
    """Utterances of each speaker, in order."""
    rows = key_values(spark, utt2spk)
    return rows.groupBy(F.col("value").alias("spk")).agg(F.array_sort(F.collect_list("key")).alias("utts"))


def timed_words(spark: SparkSession, path: str) -> DataFrame:
    """Words that have text and a time, in order of time within their run."""
    rows = spark.read.schema(WORD_EVENT).json(path)
    return rows.where((F.trim("word") != "") & F.col("att_start").isNotNull()).sortWithinPartitions("run", "att_start", "word")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Files as candidates: path, text, words."""
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return rows.select("path", F.col("value").alias("text"), F.size(F.filter(F.split("value", r"\s+"), lambda w: w != "")).alias("words"))


def hotword_rules(lines: DataFrame, line: str = "value") -> DataFrame:
    """wrong, right and is_explicit of each rule line: `wrong => right`, `wrong -> right`, `wrong → right` or a bare target; # starts a comment."""
    body = F.trim(line)
    parts = F.split(body, "=>|->|→", 2)
    explicit = F.size(parts) == 2
    wrong, right = F.when(explicit, F.trim(parts[0])), F.trim(F.when(explicit, F.get(parts, F.lit(1))).otherwise(parts[0]))
    rows = lines.where((body != "") & ~body.startswith("#")).select(wrong.alias("wrong"), right.alias("right"), explicit.alias("is_explicit"))
    return rows.where((F.col("right") != "") & (F.col("wrong").isNull() | (F.col("wrong") != "")))


def container_kind(head: Column) -> Column:
    """Kind of an audio file by its first bytes."""
    h = F.hex(F.substring(head, 1, 12))
    return (
        F.when(h.rlike("^52494646.{8}57415645"), "wav")
        .when(h.startswith("664C6143"), "flac")
        .when(h.startswith("4F676753"), "ogg")
        .when(h.startswith("494433") | h.rlike("^FF(?:F[A-F]|E[2-7])"), "mp3")
        .when(h.rlike("^.{8}66747970"), "mp4")
        .otherwise("raw")
    )


@F.pandas_udf(_WAVE)
def decode_wave(files: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """16-bit PCM as one channel of floats; what cannot be read gives its error and no samples."""
    for batch in files:
        rows = []
        for data in batch:
            try:
                with wave.open(io.BytesIO(data)) as w:
                    if w.getsampwidth() != 2:
                        raise wave.Error(f"{8 * w.getsampwidth()} bits")
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
                    rows.append((w.getframerate(), w.getnchannels(), (x.mean(1) / 32768).astype(np.float32), None))
            except (wave.Error, EOFError, TypeError, ValueError) as e:
                rows.append((None, None, None, str(e) or type(e).__name__))
        yield pd.DataFrame(rows, columns=["rate", "channels", "samples", "error"])


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, rate, channels and samples of each file."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", container_kind(F.col("content")).alias("kind"), decode_wave("content").alias("w")).select("path", "kind", "w.*")


def cut_segments(audio: DataFrame, segments: DataFrame) -> DataFrame:
    """Samples of each segment (utt, rec, st, et) out of its recording (rec, rate, samples)."""
    first = F.floor(F.col("st") * F.col("rate")).cast("int")
    n = F.greatest(F.floor(F.col("et") * F.col("rate")).cast("int") - first, F.lit(0))
    return segments.join(audio.select("rec", "rate", "samples"), "rec").select("utt", "rec", "rate", F.slice("samples", first + 1, n).alias("samples"))
