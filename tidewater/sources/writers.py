"""Writers of results: lines, subtitles, verbose JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.text import srt_time
from tidewater.streaming.machines import run_batch
from tidewater.streaming.sessions import Layout, wrapping


def key_value_lines(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(F.concat_ws(" ", F.col(key), F.col(value)).alias("value"))


def json_arrays(df: DataFrame, item: str) -> DataFrame:
    """The lines of one JSON array for each partition, empty ones too, so that each file of df.write.text holds one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lambda x: pa.RecordBatch.from_pydict({"value": pa.array(x, pa.string())})
        yield lines(["["])
        lead = ""
        for batch in batches:
            if batch.num_rows:
                first, *rest = batch.column(0).to_pylist()
                yield lines([lead + first, *["," + x for x in rest]])
                lead = ","
        yield lines(["]"])

    return df.select(item).mapInArrow(run, "value string")


def vtt_time(ms: Column) -> Column:
    """hh:mm:ss.mmm, without the hours where there are none."""
    full = F.replace(srt_time(ms), F.lit(","), F.lit("."))
    return F.when(full.startswith("00:"), F.substring(full, 4, 20)).otherwise(full)


def cues(df: DataFrame, session: str, begin: str, end: str, text: str, style: str = "srt") -> DataFrame:
    """One subtitle text for each session: srt, vtt, tsv (milliseconds) or txt."""
    n = F.row_number().over(W.partitionBy(session).orderBy(begin, end))
    stamp = srt_time if style == "srt" else vtt_time
    clean = F.replace(F.trim(text), F.lit("-->"), F.lit("->"))
    line = {
        "srt": F.concat(n.cast("string"), F.lit("\n"), stamp(F.col(begin)), F.lit(" --> "), stamp(F.col(end)), F.lit("\n"), clean, F.lit("\n")),
        "vtt": F.concat(stamp(F.col(begin)), F.lit(" --> "), stamp(F.col(end)), F.lit("\n"), clean, F.lit("\n")),
        "tsv": F.concat_ws("\t", F.round(begin).cast("long").cast("string"), F.round(end).cast("long").cast("string"), F.replace(F.trim(text), F.lit("\t"), F.lit(" "))),
        "txt": F.trim(text),
    }[style]
    rows = df.select(session, n.alias("_n"), line.alias("_line"))
    got = rows.groupBy(session).agg(F.array_join(F.sort_array(F.collect_list(F.struct("_n", "_line")))["_line"], "\n").alias("body"))
    head = {"vtt": "WEBVTT\n\n", "tsv": "start\tend\ttext\n"}.get(style, "")
    return got.withColumn("body", F.concat(F.lit(head), "body"))


def wrapped(words: DataFrame, session: str, order: list[str], layout: Layout) -> DataFrame:
    """session, begin, stop and text of the cues that timed words make (word with the space before it, begin, stop, first of a segment)."""
    return run_batch(words, session, order, wrapping(layout))


def verbose_json(df: DataFrame, session: str, begin: str, end: str, text: str) -> DataFrame:
    """Segments of a session with dense ids, as JSON."""
    item = F.struct(F.col(begin).alias("start"), F.col(end).alias("end"), F.col(text).alias("text"))
    got = df.groupBy(session).agg(F.sort_array(F.collect_list(item)).alias("s"))
    numbered = F.transform("s", lambda x, i: F.struct(i.alias("id"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    whole = F.struct(F.array_join("s.text", " ").alias("text"), F.array_max("s.end").alias("duration"), numbered.alias("segments"))
    return got.select(session, F.to_json(whole).alias("json"))
