"""Session state machines: one pure step over (state, row) serves a batch and a stream alike.

Batch form: rows are dealt by session, sorted, and walked as a stream of Arrow batches with the state carried along,
so that a session of any length needs the memory of its state only.

Stream form: rows wait in the session's state until the watermark has passed them and are then walked in their order, so
the files that bring them may be cut and ordered in any way: what comes out is what the batch gives. A session ends once
the watermark has passed its last row by `quiet`: an event-time timer then gives its last rows and removes its state. What
waits is bounded by the watermark's delay. Rows that come when the watermark has already passed them are late: Spark leaves
them out and counts them (runs.drain gives the count). A watermark begins at 1970, so events lie after it.

Both forms begin a new session where more than `quiet` lies between two rows of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _nothing(state: tuple) -> list[tuple]:
    return []


@dataclass(frozen=True)
class Machine:
    """start: the state of a new session. step: the state after a row of inputs, and the rows that it gives. finish: what
    a session still gives when it ends. state and output name the fields of both with their types."""

    inputs: tuple[str, ...]
    state: str
    start: tuple
    output: str
    step: Callable[[tuple, tuple], tuple[tuple, list[tuple]]]
    finish: Callable[[tuple], list[tuple]] = _nothing


def fold(machine: Machine, rows: Iterable[tuple], state: tuple | None = None) -> tuple[list[tuple], tuple]:
    """What the rows of one session give, and the state after them."""
    now, out = machine.start if state is None else state, []
    for row in rows:
        now, got = machine.step(now, row)
        out += got
    return out, now


def _output_of(df: DataFrame, session: str, machine: Machine) -> T.StructType:
    out = T.StructType([df.schema[session]])
    for field in T.StructType.fromDDL(machine.output):
        out.add(field)
    return out


def _plain(value: Any) -> Any:
    """Numpy's values as Python's, which the state store can hold."""
    return value.tolist() if hasattr(value, "tolist") else None if value is pd.NA or value is pd.NaT else value


def _sorting(row: tuple) -> tuple:
    return tuple((x is not None, x) for x in row)


def run_batch(df: DataFrame, session: str, order: list[str], machine: Machine, flush: bool = True, quiet: int | None = None) -> DataFrame:
    """session and output of every session; flush: with what sessions give at their end.

    quiet: the pause that ends a session; the first of order is then a long (as microseconds), and rows without it take no part.
    """
    rows = df.select(session, *order, *machine.inputs)
    if quiet is not None:
        rows = rows.where(F.col(order[0]).isNotNull())
    rows = rows.repartition(session).sortWithinPartitions(session, *order)
    schema = _output_of(df, session, machine)
    skip = 1 + len(order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(schema)
        wrap = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)
        key, state, begun, last = None, machine.start, False, None
        for batch in batches:
            out: list[tuple] = []
            at = batch.column(1).to_pylist() if quiet is not None else [None] * batch.num_rows
            for k, now, *row in zip(batch.column(0).to_pylist(), at, *[c.to_pylist() for c in batch.columns[skip:]]):
                if not begun or k != key or (quiet is not None and now - last > quiet):
                    if begun and flush:
                        out += [(key, *o) for o in machine.finish(state)]
                    key, state, begun = k, machine.start, True
                last = now
                state, got = machine.step(state, tuple(row))
                out += [(k, *o) for o in got]
            if out:
                yield wrap(out)
        if begun and flush and (ends := [(key, *o) for o in machine.finish(state)]):
            yield wrap(ends)

    return rows.mapInArrow(walk, schema)


def run_stream(df: DataFrame, session: str, order: list[str], machine: Machine, quiet: int, end: int | None = None) -> DataFrame:
    """The same as a stream that has a watermark. The first of order is the event time in microseconds, a long.

    Rows of the time `end` or later are no events: they move the watermark only. Rows without a time take no part.
    """
    fields = T.StructType.fromDDL(machine.state).fields
    held = [*order, *machine.inputs]
    watermarked = [c for c in df.columns if c not in (session, *held)]
    rows = df.select(session, *held, *watermarked)
    waiting = [f"_w{k} array<{rows.schema[c].dataType.simpleString()}>" for k, c in enumerate(held)]
    kept = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], "_last long", *waiting])
    schema = _output_of(df, session, machine)
    n, width = len(fields), len(held)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = tuple(state.get) if state.exists else (*machine.start, None, *[[]] * width)
        now, last = old[:n], old[n]
        passed = state.getCurrentWatermarkMs()
        rest = list(zip(*old[n + 1 :]))
        if not state.hasTimedOut:
            for batch in batches:
                new = batch.iloc[:, 1 : 1 + width]
                rows = zip(*[[_plain(x) for x in new[c].astype(object)] for c in new.columns])
                rest += [r for r in rows if r[0] is not None and r[0] == r[0] and (end is None or r[0] < end)]
        rest.sort(key=lambda r: _sorting(r[: len(order)]))
        due = 0
        out: list[tuple] = []
        while due < len(rest) and rest[due][0] <= passed * 1000:
            at, *row = rest[due][0], *rest[due][len(order) :]
            if last is not None and at - last > quiet:
                out += machine.finish(now)
                now = machine.start
            last = at
            now, got = machine.step(now, tuple(row))
            out += got
            due += 1
        rest = rest[due:]
        if last is not None and last + quiet < passed * 1000:
            out += machine.finish(now)
            now, last = machine.start, None
        if last is None and not rest:
            if state.exists:
                state.remove()
        else:
            state.update((*now, last, *([list(c) for c in zip(*rest)] if rest else [[]] * width)))
            wait = [rest[0][0]] if rest else []
            wait += [last + quiet] if last is not None else []
            state.setTimeoutTimestamp(max(min(wait) // 1000, passed))
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=schema.names)

    return rows.groupBy(session).applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)
