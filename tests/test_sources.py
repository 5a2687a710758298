"""Readers and writers over small files."""

from __future__ import annotations

import json
import struct
import wave

import numpy as np
from pyspark.sql import functions as F

from tidewater.functions import udfs
from tidewater.operators import sequences as Q
from tidewater.sources import readers, writers


def test_manifests(spark, tmp_path):
    a = tmp_path / "a.jsonl"
    a.write_text(json.dumps({"key": "k1", "source": "s", "target": "t"}) + "\n" + json.dumps({"key": "k2", "source": "s", "target": "t", "prompt": "<P>", "source_len": 7}) + "\n")
    (tmp_path / "list.txt").write_text(f"{a}\n\n")
    got = {r.key: r for r in readers.manifest_from_lists(spark, str(tmp_path / "list.txt")).collect()}
    assert (got["k1"].prompt, got["k1"].source_len, got["k1"].target_len, got["k1"].text_language) == ("<ASR>", 1, 0, None)
    assert (got["k2"].prompt, got["k2"].source_len) == ("<P>", 7)


def test_chats(spark, tmp_path):
    m = [{"role": r, "content": c} for r, c in (("system", "s"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"))]
    (tmp_path / "c.jsonl").write_text(json.dumps({"key": "k", "messages": m, "speech_length": 80}) + "\n")
    r = readers.chat_manifest(spark, str(tmp_path / "c.jsonl")).first()
    assert (r.system, r.user, r.assistant, r.speech_len, r.text_len) == (["s", "s"], ["u1", "u2"], ["a1"], 10, 0)


def test_lists(spark, tmp_path):
    (tmp_path / "scp").write_text("u1  a b c \nu2\n\n u3 x\n")
    assert {tuple(r) for r in readers.key_values(spark, str(tmp_path / "scp")).collect()} == {("u1", "a b c"), ("u2", ""), ("u3", "x")}
    (tmp_path / "u2s").write_text("u2 A\nu1 A\nu3 B\n")
    assert {r.spk: r.utts for r in readers.speaker_lists(spark, str(tmp_path / "u2s")).collect()} == {"A": ["u1", "u2"], "B": ["u3"]}
    (tmp_path / "hot").write_text("# note\nfoo => Bar Baz\na->b\n x → y \nplain\n=> nothing\n\n")
    got = {tuple(r) for r in readers.hotword_rules(spark.read.text(str(tmp_path / "hot"))).collect()}
    assert got == {("foo", "Bar Baz", True), ("a", "b", True), ("x", "y", True), (None, "plain", False)}


def test_timed_words_and_texts(spark, tmp_path):
    rows = [{"run": "r", "word": w, "att_start": s} for w, s in (("b", 2.0), ("a", 1.0), (" ", 3.0), ("c", None))]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [r.word for r in readers.timed_words(spark, str(tmp_path / "e.jsonl")).collect()] == ["a", "b"]
    (tmp_path / "t.txt").write_text("one two\n three\n")
    r = readers.whole_texts(spark, str(tmp_path / "t.txt")).first()
    assert r.words == 3 and r.path.endswith("t.txt")


def test_audio(spark, tmp_path):
    samples = [0, 16384, -16384, 32767]
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(4)
        w.writeframes(struct.pack("<8h", *[s for x in samples for s in (x, x)]))
    (tmp_path / "y.wav").write_bytes(b"RIFFxxxxWAVEbroken")
    (tmp_path / "z.bin").write_bytes(b"fLaC....")
    got = {r.path[-5:]: r for r in readers.audio_files(spark, str(tmp_path)).collect()}
    assert (got["x.wav"].kind, got["x.wav"].rate, got["x.wav"].channels) == ("wav", 4, 2)
    assert np.allclose(got["x.wav"].samples, np.array(samples) / 32768)
    assert got["y.wav"].kind == "wav" and got["y.wav"].error and got["y.wav"].samples is None
    assert got["z.bin"].kind == "flac"
    audio = readers.audio_files(spark, str(tmp_path)).where("error IS NULL").withColumn("rec", F.lit("r"))
    segments = spark.createDataFrame([("u", "r", 0.25, 0.75)], "utt string, rec string, st double, et double")
    assert readers.cut_segments(audio, segments).first().samples == [0.5, -0.5]


def test_writers(spark):
    rows = spark.createDataFrame([("s", 0, 1500, " a --> b "), ("s", 3600000, 3601000, "c")], "k string, b long, e long, t string")
    assert writers.cues(rows, "k", "b", "e", "t").first().body == "1\n00:00:00,000 --> 00:00:01,500\na -> b\n\n2\n01:00:00,000 --> 01:00:01,000\nc\n"
    assert writers.cues(rows, "k", "b", "e", "t", "vtt").first().body.startswith("WEBVTT\n\n00:00.000 --> 00:01.500\n")
    assert writers.cues(rows, "k", "b", "e", "t", "tsv").first().body == "start\tend\ttext\n0\t1500\ta --> b\n3600000\t3601000\tc"
    got = json.loads(writers.verbose_json(rows, "k", "b", "e", "t").first().json)
    assert got["duration"] == 3601000 and [s["id"] for s in got["segments"]] == [0, 1]


def test_text_helpers():
    assert udfs.joined("hello world again", "World, again and more") == "hello world again and more"
    assert udfs.joined("abc", "xyz") is None
    assert udfs.cut_text("aa " * 50, 20)[0] == "aa aa aa aa aa aa aa"
    assert udfs.cut_text("x" * 50, 20) == ["x" * 20, "x" * 20, "x" * 10] and udfs.cut_text("  ") == []
    assert udfs.fold("Éléphant — «ça»!") == "elephant ca"


def test_sequences():
    cost = np.abs(np.subtract.outer([0.0, 1, 2, 3], [0.0, 2, 3]))
    total, path = Q.warp_path(cost)
    assert total == 1.0 and path[0] == (0, 0) and path[-1] == (3, 2)
    r = np.random.default_rng(0)
    x = np.log(r.dirichlet(np.ones(4), size=7))
    got = Q.forced_alignment(x, [1, 1, 3])

    def collapse(p):
        return [a for k, a in enumerate(p) if a and (k == 0 or p[k - 1] != a)]

    import itertools

    best = max((p for p in itertools.product(range(4), repeat=7) if collapse(p) == [1, 1, 3]), key=lambda p: sum(x[t, k] for t, k in enumerate(p)))
    assert got == list(best)
    similar = np.array([[1, 0.5, 0.1], [0.5, 1, 0.5], [0.1, 0.5, 1]])
    assert Q.compatible_cluster(similar, [1.0, 2.0, 0.5]) == (1, 2)
