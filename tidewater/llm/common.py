"""Helpers shared by the training-data operators: table access, staging, column handling."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.shipping import ship
from tidewater.sources.scratch import new_path, remove_path

#: ASCII white space, the only separators of words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows, and bytes, of text handed to a Python worker at once; they bound worker memory. A longer text goes alone.
TEXT_ROWS_PER_BATCH = 256
TEXT_BYTES_PER_BATCH = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on, and their code on the workers; none changes a result."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS_PER_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES_PER_BATCH)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors.

    Columns of type void cannot be stored and must not occur.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables that no later plan reads; others, and None, are left alone."""
    for t in tables:
        if path := getattr(t, "staged_at", None):
            remove_path(t.sparkSession, path)


#: What this worker keeps between its tasks, of one operator at a time.
_kept: dict[tuple, object] = {}


def kept_by_worker(operator: str, key: str, make: Callable[[], object]) -> object:
    """What make() gives, kept for the worker's later tasks of the same operator."""
    if (operator, key) not in _kept:
        _kept[operator, key] = make()
    return _kept[operator, key]


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None  # not glibc


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits, or goes on to another operator, holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def make_room(operator: str) -> None:
    """Let go of what other operators keep in this worker."""
    others = [k for k in _kept if k[0] != operator]
    for k in others:
        del _kept[k]
    if others:
        give_back()


def frugal(operator: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow: what another operator keeps in the worker goes before it, and freed memory after it."""

    def task(batches: Iterator) -> Iterator:
        # by name, as the worker's own module holds what is kept
        make_room(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def words(text: Column) -> Column:
    """Words of a text: maximal runs of anything but ASCII white space; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fresh(df: DataFrame, base: str) -> str:
    """A column name like base that df does not have."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def carried(docs: DataFrame) -> list[Column]:
    """The input's columns under names that clash with none of the operators' own."""
    return [F.col(f"`{c}`").alias(f"_doc{k}") for k, c in enumerate(docs.columns)]


def restored(docs: DataFrame) -> Column:
    """The carried columns as one struct `doc` under their own names; what is not used of it is pruned."""
    return F.struct(*[F.col(f"_doc{k}").alias(c) for k, c in enumerate(docs.columns)]).alias("doc")


def carried_text(docs: DataFrame, text: str) -> Column:
    return F.col(f"_doc{docs.columns.index(text)}")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, positions: Column) -> Column:
    """The text without the \n-split lines at the positions (from 0), in time that is linear in both."""
    rest = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), positions)
    return bound(F.split(text, "\n"), lambda lines: F.array_join(F.transform(rest(lines), lambda i: F.get(lines, i)), "\n"))
