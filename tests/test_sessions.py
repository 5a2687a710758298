"""State machines: plain loops, any cut of the input, streams against batches."""

from __future__ import annotations

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.plans.registry import QUERIES
from tidewater.plans.stream_queries import QUIET, _voiced
from tidewater.streaming import machines, runs, sessions

SF = "/root/testdata/sf0.001"
MACHINES = {
    "endpointing": sessions.endpointing(sessions.Rule(3, 2, 8)),
    "gating": sessions.gating(sessions.Gate(6, 5, 2)),
    "detecting": sessions.detecting(sessions.Detector(4, 3, 1, 1, 1, 12)),
    "thresholding": sessions.thresholding(sessions.Threshold(0.5, 0.35, 2, 1)),
    "controlling": sessions.controlling(5, 3),
    "commanded": sessions.commanded(6),
}


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(sorted(MACHINES)), st.lists(st.sampled_from([0.0, 0.4, 0.6, 1.0]), max_size=40), st.lists(st.integers(1, 7), max_size=12))
def test_any_cut_gives_the_same(name, frames, sizes):
    machine = MACHINES[name]
    rows = [(p if name == "thresholding" else p > 0.5,) for p in frames]
    whole, end = machines.fold(machine, rows)
    got, state, at = [], None, 0
    for n in [*sizes, len(rows)]:
        more, state = machines.fold(machine, rows[at : at + n], state)
        got, at = got + more, at + n
    assert (got, state) == (whole, end)


def test_detector_segments():
    rule = sessions.Detector(width=4, to_speech=3, to_silence=1, back=1, ahead=1, longest=100)
    machine = sessions.detecting(rule)
    frames = [0] * 6 + [1] * 6 + [0] * 8
    out, state = machines.fold(machine, [(f,) for f in frames])
    # three of four frames are voiced at frame 8; the window begins at 5, one frame more goes before it
    # one of four is voiced at frame 14; the voiced one is frame 11, one quiet frame more is kept
    assert out == [(4, 13, "silence")] and machine.finish(state) == []
    cut, _ = machines.fold(sessions.detecting(rule._replace(longest=5)), [(1,)] * 12)
    assert [b - a for a, b, _ in cut] == [5, 5] and cut[0][1] == cut[1][0]
    assert machine.finish(machines.fold(machine, [(1,)] * 5)[1]) == [(0, 5, "end")]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.booleans(), max_size=60))
def test_segments_do_not_overlap(frames):
    for machine in (sessions.detecting(sessions.Detector(4, 3, 1, 2, 1, 9)), sessions.controlling(4, 3), sessions.commanded(5)):
        out, state = machines.fold(machine, [(f,) for f in frames])
        spans = [(a, b) for a, b, *_ in out + machine.finish(state)]
        assert all(0 <= a < b <= len(frames) for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_controller_hands_on_speech_with_what_lies_before_it():
    out, _ = machines.fold(sessions.controlling(lookback=3, quiet=2), [(v,) for v in [0] * 5 + [1] * 4 + [0] * 3])
    assert out == [(2, 7, False), (7, 10, False), (10, 11, True)]


def test_confirmed_words_and_trimming():
    partials = ["a", "a b", "a b x", "a b c d", "a b c d e"]
    out, state = machines.fold(sessions.confirming(most=3), [(p.split(),) for p in partials])
    assert out[0] == (1, "a", 0) and "".join(c for _, c, _ in out).replace(" ", "").startswith("ab")
    assert len(state[2]) <= 5 and sum(t for *_, t in out) > 0


def test_client_commands():
    machine = sessions.commanded(longest=4)
    out, state = machines.fold(machine, [(c,) for c in [0, 0, 1, 0, 0, 0, 0, 0, 0]])
    assert out == [(0, 3, "command"), (3, 7, "longest")] and machine.finish(state) == [(7, 9, "end")]


@pytest.mark.parametrize("name", ["endpointing", "gating", "detecting", "thresholding", "commanded"])
def test_batch_equals_plain_loops(spark, name):
    machine = MACHINES[name]
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", (F.col("value") > 30).alias("voiced"), F.least(F.col("value") / 100, F.lit(1.0)).alias("chance"), (F.col("event_type") == "purchase").alias("command"))
    own = {}
    for r in rows.orderBy("us", "event_id").collect():
        own.setdefault(r.user_id, []).append(tuple(r[c] for c in machine.inputs))
    want = []
    for k, frames in own.items():
        out, state = machines.fold(machine, frames)
        want += [(k, *o) for o in out + machine.finish(state)]
    got = machines.run_batch(rows, "user_id", ["us", "event_id"], machine).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def write_files(df, path, files, seed):
    """df's rows dealt to files at random, the files in a random order of time."""
    r = random.Random(seed)
    rows = [tuple(x) for x in df.collect()]
    r.shuffle(rows)
    for k in range(files):
        df.sparkSession.createDataFrame(rows[k::files], df.schema).coalesce(1).write.mode("append").parquet(str(path))
    names = sorted(path.glob("part-*"))
    r.shuffle(names)
    for k, f in enumerate(names):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))


STREAMS = [
    ("stm_endpointing_batch", "stm_endpointing"),
    ("stm_hysteresis", "stm_hysteresis_stream"),
    ("stm_detector", "stm_detector_stream"),
    ("stm_threshold_gate", "stm_threshold_gate_stream"),
    ("stm_commanded_batch", "stm_client_endpoints"),
    ("stm_online_speakers", "stm_online_speakers_stream"),
]


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The tables of the streams as eight files that cut across all sessions."""
    folder = tmp_path_factory.mktemp("shuffled")
    for name in ("events", "embeddings"):
        write_files(spark.read.parquet(f"{SF}/{name}.parquet"), folder / f"{name}.parquet", 8, 3)
    return str(folder)


@pytest.mark.parametrize("batch, stream", STREAMS)
def test_streams_equal_batches_however_the_table_is_cut(spark, shuffled, batch, stream):
    if batch in QUERIES:
        want = QUERIES[batch](spark, SF).collect()
    else:
        events = _voiced(spark.read.parquet(f"{SF}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))))
        want = machines.run_batch(events, "user_id", ["us", "event_id"], sessions.commanded(longest=40), quiet=QUIET).collect()
    want = sorted(map(str, want))
    assert want and sorted(map(str, QUERIES[stream](spark, shuffled).collect())) == want
    assert sorted(map(str, QUERIES[stream](spark, SF).collect())) == want


FRAMES = "s long, us long, chance double, at timestamp"


def frames_stream(spark, tmp_path, parts, lateness):
    """A stream of one file for each part, in that order, of (session, second, chance)."""
    for k, part in enumerate(parts):
        folder = tmp_path / "frames.parquet"
        old = set(folder.glob("part-*"))
        spark.createDataFrame([(s, (1000 + sec) * 1_000_000, p) for s, sec, p in part], "s long, t long, chance double").coalesce(1).write.mode("append").parquet(str(folder))
        for f in set(folder.glob("part-*")) - old:
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return runs.session_stream(spark, str(tmp_path), "frames", F.col("t"), lambda d: d.select("s", "us", "chance"), files_at_once=1, lateness=lateness)


def test_late_rows_are_counted(spark, tmp_path):
    """The watermark stands 10 s behind the latest row; what comes behind it is left out and counted, what comes before is put in its place."""
    machine = sessions.thresholding(sessions.Threshold(0.5, 0.35, 2, 0))
    parts = [[(1, 0, 0.9), (1, 30, 0.1)], [(1, 31, 0.1)], [(1, 5, 0.1), (1, 25, 0.9), (1, 32, 0.9)], [(1, 60, 0.9)]]
    source = frames_stream(spark, tmp_path, parts, 10_000_000)
    got = runs.run_sessions(source, "s", ["us"], machine, 10**9, "late")
    frames = [0.9, 0.9, 0.1, 0.1, 0.9, 0.9]
    want = sessions.threshold_spans(frames, sessions.Threshold(0.5, 0.35, 2, 0))
    assert got.late_rows == 1 and sorted((r.begin, r.stop) for r in got.table.collect()) == sorted(want)


def test_quiet_sessions_end_and_leave_no_state(spark, tmp_path):
    """Event time alone ends a session; a later row begins a new one; nothing is left in the state."""
    machine = sessions.thresholding(sessions.Threshold(0.5, 0.35, 2, 0))
    parts = [[(1, 0, 0.1), (1, 1, 0.9), (2, 1, 0.9)], [(1, 100, 0.9), (2, 3, 0.9)], [(2, 200, 0.9)], [(None, 7, 0.9)]]
    source = frames_stream(spark, tmp_path, parts, 200_000_000)
    state = str(tmp_path / "state")
    stream = machines.run_stream(source.rows, "s", ["us"], machine, 50_000_000, runs.END)
    for _ in range(2):
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        source.end()
    got = sorted((r.s or 0, r.begin, r.stop) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 0, 1), (1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 0, 2)]
    assert spark.read.format("statestore").load(state).count() == 0


def test_batches_begin_sessions_after_quiet(spark):
    rows = spark.createDataFrame([(1, 0, 0.9), (1, 5, 0.9), (1, 20, 0.9), (2, 21, 0.9), (2, None, 0.9)], "s long, us long, chance double")
    machine = sessions.thresholding(sessions.Threshold(0.5, 0.35, 2, 0))
    got = machines.run_batch(rows, "s", ["us"], machine, quiet=10).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (1, 0, 2), (2, 0, 1)]
    assert len(machines.run_batch(rows, "s", ["us"], machine).collect()) == 2
