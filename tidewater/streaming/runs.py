"""Running a stream over the files at hand, to a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.sources.scratch import make_path, new_path, remove_path
from tidewater.streaming.machines import Machine, run_stream

#: The event time, in microseconds, of the row that ends a stream: the year 2200 (pandas knows none after 2262).
END = 7_258_118_400_000_000


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_at_once: int = 4) -> DataFrame:
    """A table's files as a stream, of the schema that the files have."""
    # a glob, so that a single file and a folder of files both serve
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def disorder(table: DataFrame, at: Column) -> int:
    """How far, in microseconds, rows may lie behind rows of files that come before theirs, by their time of writing; 0 for one file."""
    files = table.select(at.alias("at"), "_metadata.file_path", "_metadata.file_modification_time").groupBy("file_path", "file_modification_time").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    # a row a file; files of one moment come in any order
    earlier = W.orderBy("file_modification_time").rangeBetween(W.unboundedPreceding, 0)
    most = F.max("high").over(earlier)
    row = files.select(F.when(F.count(F.lit(1)).over(earlier) > 1, most - F.col("low")).alias("d")).agg(F.max("d").alias("d")).first()
    return max(0, row["d"] or 0)


@dataclass
class Drained:
    """What a stream gave, and how many rows came too late for its watermark."""

    table: DataFrame
    late_rows: int


@dataclass
class Sessions:
    """A stream of rows with an event time, and where its end is written."""

    rows: DataFrame
    end_path: str

    def end(self) -> None:
        """Write the row that moves the watermark past all others."""
        spark = self.rows.sparkSession
        fields = [f for f in self.rows.schema.fields if f.name != "at"]
        row = [F.lit(END if f.name == "us" else None).cast(f.dataType).alias(f.name) for f in fields]
        spark.range(1).select(*row).write.mode("append").parquet(self.end_path)


def session_stream(spark: SparkSession, sf_dir: str, name: str, time: Column, shape: Callable[[DataFrame], DataFrame], files_at_once: int = 4, lateness: int | None = None) -> Sessions:
    """shape(the table) with its event time `us` (time of the table, in microseconds) as a stream with a watermark on `at`.

    lateness: the watermark's delay in microseconds; by default what the order of the table's files asks for, so that no row is late.
    """
    if lateness is None:
        lateness = disorder(spark.read.parquet(f"{sf_dir}/{name}.parquet"), time)
    rows = shape(stream_table(spark, sf_dir, name, files_at_once).withColumn("us", time))
    end_path = make_path(spark, f"{name}-end")
    both = rows.unionByName(spark.readStream.schema(rows.schema).parquet(end_path)).withColumn("at", F.timestamp_micros("us"))
    return Sessions(both.withWatermark("at", f"{lateness} microseconds"), end_path)


def drain(stream: DataFrame, name: str, mode: str = "append", end: Callable[[], None] | None = None) -> Drained:
    """Run the stream over what is there, then, if an end is given, over that; read what it gave.

    Complete mode keeps the last batch, append mode all.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, f"{name}-out"), new_path(spark, f"{name}-state")
    late = 0
    for part in range(2 if end else 1):
        if part:
            end()
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").option("path", out).start()
        else:
            query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
        query.awaitTermination()
        late += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    remove_path(spark, state)
    return Drained(spark.read.schema(stream.schema).parquet(out), late)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    return drain(stream, name, mode).table


def run_sessions(source: Sessions, session: str, order: list[str], machine: Machine, quiet: int, name: str) -> Drained:
    """A machine over all of a stream's sessions, up to their ends."""
    made = drain(run_stream(source.rows, session, order, machine, quiet, END), name, end=source.end)
    remove_path(source.rows.sparkSession, source.end_path)
    return made
