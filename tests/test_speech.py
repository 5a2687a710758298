"""Votes, fuzzy vocabulary, keyword beams, cues, token times, control rows and schedules against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import time
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.test_operators import plain_distance
from tidewater.operators import alignment as A
from tidewater.operators import fuzzy, keywords, votes
from tidewater.plans.registry import QUERIES
from tidewater.streaming import sessions
from tidewater.streaming.machines import fold

SF = "/root/testdata/sf0.001"


def run(machine, rows):
    out, state = fold(machine, rows)
    return out + machine.finish(state)


# votes


def test_fusion_values():
    base, said = ["ALPHA", "BRAVO", "CHARLIE"], [["ALPHA", "XRAY", "CHARLIE"], ["alpha", "xray", "charlie"]]
    assert votes.fuse(base, said, ["a", "b"])[:4] == (["ALPHA", "XRAY", "CHARLIE"], 1, 0, 2)
    # two voices of one family are not independent
    assert votes.fuse(base, said, ["a", "a"])[:4] == (base, 0, 1, 2)
    assert votes.fuse([*base, "DELTA"], [[*s, "delta"] for s in said], ["a", "b"])[1:] == (1, 0, 3, True)
    assert votes.fuse(["A", "B"], [["C"], []], ["a", "b"]) == (["A", "B"], 0, 2, 0, False)
    assert votes.fuse([], [[]], ["a"]) == ([], 0, 0, 0, True)


def test_rover_and_consensus_values():
    base = ["A", "B", "C"]
    assert votes.rover(base, [["A", "X", "C"], ["A", "X", "C"], ["A", "B", "C"]]) == (["A", "X", "C"], 1)
    assert votes.rover(base, [["A", "Y", "C"], ["A", "X", "C"], ["A", "Y", "C"], ["A", "X", "C"]]) == (["A", "X", "C"], 1)
    assert votes.rover(base, [["A", "X", "C"], ["A", "Y", "C"]]) == (base, 0)
    assert votes.consensus(base, [["A", "X", "C"], ["A", "Y", "C"]]) == (["A", "C"], 1)
    assert votes.consensus(base, [["A", "X", "C"], ["A", "B", "C"]]) == (base, 0) == votes.consensus(base, [["A", "X", "C"]])


def engines(spark):
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        base, n = " ".join(r.text.upper().split()).split(" "), r.conv_id + r.turn
        yield (r.conv_id, r.turn), base, [["NOISE" if (i * 7 + n) % 5 == k else "OTHER" if (i + n) % 11 == 3 else w for i, w in enumerate(base)] for k in range(3)]


def test_vote_queries(spark):
    want = {k: (b, e) for k, b, e in engines(spark)}
    rover = {(r.conv_id, r.turn): (r.text.split(" "), r.wins) for r in QUERIES["set_rover_vote"](spark, SF).collect()}
    assert rover == {k: votes.rover(*x) for k, x in want.items()}
    fused = {(r.conv_id, r.turn): (r.text.split(" "), r.applied, r.template_only, r.attested, r.accepted) for r in QUERIES["set_template_fusion"](spark, SF).collect()}
    assert fused == {k: votes.fuse(*x, ["first", "first", "second"]) for k, x in want.items()}
    assert any(x[1] for x in rover.values()) and any(x[1] for x in fused.values())


# fuzzy vocabulary


def plain_nearest(word, vocabulary, least):
    near = [v for v in vocabulary if v[0] == word[0] or (word[0] in v[:2] and v[0] in word[:2])]
    best = min(((-SequenceMatcher(None, word, v).ratio(), v) for v in near), default=(0, ""))
    return (word, best[1], -best[0]) if -best[0] >= least else None


@pytest.mark.parametrize("least", [0.66, 0.5, 0.9])
def test_nearest_words_equal_brute_force(spark, least):
    r = random.Random(3)
    make = lambda: "".join(r.choice("ABCDE") for _ in range(r.randint(1, 9)))
    vocabulary = sorted({make() for _ in range(150)} | {"ONE", "ALTIMETER", "ÉTÉ"})
    words = sorted({make() for _ in range(200)} | {"NEW", "ALTITUDE", "ÉTE", "A"})
    frame = lambda x: spark.createDataFrame([(w,) for w in [*x, *x[:5], None, ""]], "w string")
    got = fuzzy.nearest_words(frame(words), "w", frame(vocabulary), "w", least).collect()
    want = [x for w in words if (x := plain_nearest(w, vocabulary, least))]
    assert sorted(map(tuple, got)) == want and len(want) > 10


@pytest.mark.parametrize("seed", range(12))
def test_bounds_leave_no_partner_out(seed, monkeypatch):
    """Small parts, words of any characters, of one, and longer than a machine word has bits."""
    r = random.Random(seed)
    if seed % 3:
        for name, size in (("TABLE", 16), ("CELLS", 64), ("PAIRS", 8)):
            monkeypatch.setattr(fuzzy, name, size)
    letters, longest, least = r.choice(["AB", "ABCDE", "ABCDEFGHIJKLMNOPQRSTUVWXYZÉÈ.,", "漢字仮名\0😀Aa"]), r.choice([9, 14, 70, 230]), r.choice([0.66, 0.5, 0.9, 0.3, 1.0])
    make = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, longest)))
    entries, words = sorted({make() for _ in range(r.choice([1, 40, 80]))}), list({make() for _ in range(80)})
    got = sorted((words[k], entries[p], float(x)) for k, p, x in zip(*fuzzy.nearest(words, entries, least)))
    assert got == sorted(x for w in words if (x := plain_nearest(w, entries, least)))


def test_large_vocabularies_take_seconds(spark):
    """A quarter of a million words and two thousand entries of few letters: pairs are scored in bulk."""
    r = random.Random(4)
    make = lambda: "".join(r.choices("ENTHAIROSL", k=r.randint(4, 14)))
    frame = lambda n: spark.createDataFrame([(w,) for w in sorted({make() for _ in range(n)})], "w string")
    words, entries = frame(250_000), frame(2_000)
    begun = time.monotonic()
    assert fuzzy.nearest_words(words, "w", entries, "w").count() > 100_000
    assert time.monotonic() - begun < 40


def test_corrections(spark):
    vocabulary = spark.createDataFrame([("ALTIMETER",), ("ONE",), ("WEATHER",), ("VISIBILITY",)], "w string")
    texts = {1: "ALTITUDE THREE", 2: "NEW", 3: "WEATHERS 12345 WEATHERS", 4: None, 5: "", 6: "THREE"}
    rows = fuzzy.corrected(spark.createDataFrame(list(texts.items()), "k long, t string"), "k", "t", vocabulary, "w").collect()
    assert {r.k: r.fixed for r in rows} == {1: "ALTIMETER THREE", 2: "NEW", 3: "WEATHER 12345 WEATHER", 4: None, 5: "", 6: "THREE"}
    assert {r.k for r in rows if r.changed} == {1, 3}


def test_texts_are_cut_into_words_some_at_a_time(monkeypatch):
    texts = pa.array(["A B", None, "", "C  D", "A" * 90, "E", None])
    for size in (1, 20, 1 << 24):
        monkeypatch.setattr(fuzzy, "BYTES", size)
        got = [(part, lists, words) for part, lists, words in fuzzy._slices(iter([pa.RecordBatch.from_arrays([texts], ["t"])] * 2), 0)]
        assert [x for part, _, _ in got for x in part.column(0).to_pylist()] == texts.to_pylist() * 2
        assert [x for _, lists, _ in got for x in lists.to_pylist()] == [None if t is None else t.split(" ") for t in texts.to_pylist()] * 2
        assert all(words.dictionary.take(words.indices).equals(lists.flatten()) for _, lists, words in got)


@pytest.mark.parametrize("frequent", [0, 3, 1 << 17])
def test_frequent_and_rare_words_are_corrected_alike(spark, frequent):
    """Whatever is broadcast, words get the same fix; keys of any type, null and empty texts stay."""
    r = random.Random(frequent)
    vocabulary = ["ALTIMETER", "ONE", "WEATHER", "VISIBILITY", "ÉTÉS", "WIND"]
    pool = ["ALTITUDE", "WEATHERS", "WEATHRE", "VISABILITY", "ÉTÉX", "THREE", "ONE", "NEW", "12345", "1234.", "WINDS", "WEATHER"]
    texts = {f"k{k}": " ".join(r.choices(pool, k=r.randint(0, 9))) for k in range(40)} | {"null": None, "empty": ""}
    frame = spark.createDataFrame(list(texts.items()), "k string, t string")
    rows = fuzzy.corrected(frame, "k", "t", spark.createDataFrame([(w,) for w in vocabulary], "w string"), "w", frequent=frequent).collect()
    keeps = lambda w: w in vocabulary or len(w) < 4 or w.rstrip(".,?").isdigit()
    fix = {w: x[1] for w in pool if not keeps(w) and (x := plain_nearest(w, vocabulary, 0.66))}
    want = {k: t if t is None else " ".join(fix.get(w, w) for w in t.split(" ")) for k, t in texts.items()}
    assert {x.k: x.fixed for x in rows} == want and len(rows) == len(texts) and len(fix) > 5
    assert {x.k for x in rows if x.changed} == {k for k, t in texts.items() if t != want[k]}


def test_lexicon_query_uses_the_whole_vocabulary(spark):
    said = {r.doc_id: " ".join(r.text.upper().split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    vocabulary = {w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in r.text.upper().split()}
    rows = QUERIES["str_lexicon_correction"](spark, SF).collect()
    assert len(rows) == len(said)
    fixes = {}
    for r in random.Random(1).sample(rows, 12):
        for w, got in zip(said[r.doc_id].split(" ")[:150], r.fixed.split(" ")):
            if w not in fixes:
                keeps = w in vocabulary or len(w) < 4 or w.rstrip(".,?").isdigit()
                fixes[w] = w if keeps or not (x := plain_nearest(w, vocabulary, 0.66)) else x[1]
            assert got == fixes[w]
    assert any(k != v for k, v in fixes.items())


# keyword beam


def collapse(path):
    return tuple(s for k, s in enumerate(path) if s and (k == 0 or path[k - 1] != s))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6))
def test_prefix_masses_equal_enumeration(seed, frames):
    """With a wide beam the likeliest prefix with a keyword is the one that the sum over all paths gives."""
    r = random.Random(seed)
    rows = []
    for _ in range(frames):
        p = [r.random() + 0.1 for _ in range(3)]
        rows.append([x / sum(p) for x in p])
    mass = defaultdict(float)
    for path in itertools.product(range(3), repeat=frames):
        mass[collapse(path)] += math.prod(rows[t][s] for t, s in enumerate(path))
    order = sorted(mass, key=lambda x: -mass[x])
    holds = lambda said, word: any(said[i : i + len(word)] == word for i in range(len(said)))
    want = next((n for said in order for n, word in (("ab", (1, 2)), ("b", (2,))) if holds(said, word)), None)
    machine = keywords.keyword_search({"ab": (1, 2), "b": (2,)}, keywords.Beam(3, 0.0, 10_000))
    ((name, first, last, score),) = run(machine, [(p,) for p in rows])
    assert name == want and (name is None or 0 <= first <= last < frames and 0 < score <= 1)


def test_keyword_times_and_long_sessions():
    frame = lambda s: ([0.96 if k == s else 0.02 for k in range(3)],)
    path = [0] * 400 + [1, 1, 0, 2] + [0] * 400
    machine = keywords.keyword_search({"ab": (1, 2)})
    assert run(machine, [frame(s) for s in path]) == [("ab", 400, 403, pytest.approx(0.96))]
    assert run(machine, [frame(s) for s in [0] * 50 + [2, 0, 1]]) == [(None,) * 4] == run(machine, [])


# cues


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([100, 200, 4000])), min_size=1, max_size=30), st.integers(8, 20), st.integers(1, 3))
def test_words_are_wrapped(words, width, lines):
    rows, at = [], 0
    for k, (n, wait) in enumerate(words):
        at += wait
        rows.append((" " + chr(97 + k % 26) * n, at, at + 50, k % 5 == 0))
    cues = run(sessions.wrapping(sessions.Layout(width, lines)), rows)
    # what the rules ask for, word by word: a line takes what fits, a cue takes its lines, a pause ends it
    want, line, last = [], 0, None
    for word, begin, stop, _ in rows:
        if line and line + len(word) <= width and begin - last <= 3000:
            want[-1][2] += word
            line += len(word)
        else:
            if want and begin - last <= 3000 and want[-1][2].count("\n") + 1 < lines:
                want[-1][2] += "\n" + word.strip()
            else:
                want.append([begin, stop, word.strip()])
            line = len(word.strip())
        want[-1][1], last = stop, begin
    assert [list(c) for c in cues] == want


def test_segments_and_highlights():
    rows = [(" ab", 0, 10, True), (" cd", 10, 20, False), (" ef", 50, 60, True)]
    assert run(sessions.wrapping(sessions.Layout()), rows) == [(0, 20, "ab cd"), (50, 60, "ef")]
    assert run(sessions.wrapping(sessions.Layout(width=6, lines=2)), rows) == [(0, 60, "ab cd\nef")]
    marked = run(sessions.wrapping(sessions.Layout(width=20, lines=2, highlight=True)), rows)
    assert marked == [(0, 10, "<u>ab</u> cd ef"), (10, 20, "ab <u>cd</u> ef"), (20, 50, "ab cd ef"), (50, 60, "ab cd <u>ef</u>")]
    assert run(sessions.wrapping(sessions.Layout()), []) == []


def test_cue_queries(spark):
    vtt = QUERIES["snk_wrapped_vtt"](spark, SF).collect()
    texts = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        texts[r.conv_id] += r.text.split()
    for r in vtt:
        assert r.body.startswith("WEBVTT\n\n")
        cues = [c.split("\n")[1:] for c in r.body[8:].split("\n\n")]
        assert " ".join(x for c in cues for x in c).split() == texts[r.conv_id]
        assert all(len(c) <= 3 and all(len(x) <= 42 or " " not in x for x in c) for c in cues)
    assert {r.conv_id for r in vtt} == set(texts)
    srt = QUERIES["snk_highlighted_srt"](spark, SF).first().body
    assert srt.startswith("1\n00:00:00,") and "<u>" in srt


# fires


def test_token_times():
    weights = lambda n, fires: [(1.0 if k in fires else 0.0,) for k in range(n)]
    machine = sessions.timing(1.0)
    assert run(machine, weights(30, {10, 14, 29})) == [(None, 0.0, 8.5), (0, 8.5, 12.5), (1, 12.5, 24.5), (None, 24.5, 30.0)]
    assert run(machine, weights(40, {2, 10})) == [(0, 0.5, 24.25), (None, 24.25, 40.0)]
    assert run(machine, weights(20, {3})) == [(None, 10.75, 20.0)] and run(machine, weights(9, ())) == [(None, 0.0, 9.0)] and run(machine, []) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.1, 0.4, 1.0]), max_size=80))
def test_token_times_cover_what_follows_the_first(weights):
    out = run(sessions.timing(1.0), [(w,) for w in weights])
    assert all(a <= b for _, a, b in out) and all(x[2] == y[1] for x, y in zip(out, out[1:]))
    assert [t for t, _, _ in out if t is not None] == list(range(sum(t is not None for t, _, _ in out)))
    assert all(b - a <= 12 for t, a, b in out[:-2] if t is not None) and (not out or out[-1][2] == len(weights))


# sessions


def test_silence_shrinks_with_age():
    machine = sessions.scheduled(sessions.Schedule(10, 8, (5, 8), (4, 2), 1))
    quiet, loud = (0,), (100,)
    # after a first quiet frame sets the floor: two quiet frames do at an age of 6 to 8, one beyond
    assert run(machine, [quiet, loud, loud, quiet, quiet, quiet, loud]) == [(1, 3, 2)] or run(machine, [quiet, loud, loud, quiet, quiet, quiet])
    assert run(machine, [quiet] + [loud] * 9 + [quiet]) == [(1, 10, 1)]
    assert run(machine, [quiet, loud, quiet, quiet, quiet]) == [(1, 2, 0)]
    assert run(machine, [quiet, loud, quiet, quiet, quiet, quiet]) == [(1, 2, 2)]


def test_floor_follows():
    machine = sessions.scheduled(sessions.Schedule(10, 2, (), (), 1))
    # the floor rises to the noise, so that only what stands above it is speech
    out = run(machine, [(0,)] + [(8,), (12,), (16,)] * 2 + [(60,), (16,)])
    assert out == [(7, 8, 1)]


def test_commands():
    rows = [("frame", None), ("commit", None), ("language", "en"), ("start", None), ("frame", None), ("frame", None), ("commit", None), ("frame", None), ("hotwords", "x,y"), ("stop", None), ("stop", None), ("frame", None), ("start", None), ("stop", None)]
    assert run(sessions.controlled(), rows) == [
        ("error", 0, 0, None, None), ("language_set", 0, 0, "en", None), ("started", 0, 0, "en", None), ("final", 0, 2, "en", None), ("hotwords_set", 2, 3, "en", "x,y"),
        ("final", 2, 3, "en", "x,y"), ("stopped", 3, 3, "en", "x,y"), ("stopped", 3, 3, "en", "x,y"), ("started", 0, 0, "en", "x,y"), ("stopped", 0, 0, "en", "x,y"),
    ]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 4)), max_size=25))
def test_taken_spans(spans):
    rows, taken = [(k, a, a + n) for k, (a, n) in enumerate(spans)], []
    for k, a, b in rows:
        if not any(a < d and c < b for _, c, d in taken):
            taken.append((k, a, b))
    assert [k for k, in run(sessions.taking(), rows)] == [k for k, _, _ in taken]


# distances


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=6))
def test_distances_of_prefixes(hyp, ref, points):
    points = sorted((min(i, len(hyp)), min(j, len(ref))) for i, j in points)
    assert A.distances_at(hyp, ref, points) == [plain_distance(hyp[:i], ref[:j]) for i, j in points]


def test_lag_curve_query(spark):
    turns = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: r.turn):
        turns[r.conv_id].append(r)
    got = {r.conv_id: (r.mean_lag, r.n) for r in QUERIES["met_lag_curve"](spark, SF).collect()}
    tokens = {(r.conv_id, r.turn): r.w for r in _tokens(spark)}
    for conv in sorted(turns)[:6]:
        ref, hyp, lags = [], [], []
        for r in turns[conv]:
            w = tokens[conv, r.turn]
            ref = ref + w
            if ref:
                lags.append(plain_distance(hyp, ref) / len(ref))
            hyp = hyp + ["noise" if (i + r.turn) % 7 == 3 else x for i, x in enumerate(w)]
        assert got[conv] == (pytest.approx(sum(lags) / len(lags), abs=1e-6), len(lags))


def _tokens(spark):
    from pyspark.sql import functions as F

    from tidewater.functions import text as T

    return spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", T.tokens(F.col("text")).alias("w")).collect()


def test_latencies_are_of_aligned_tokens(spark):
    want = defaultdict(Counter)
    rows = sorted(_tokens(spark), key=lambda r: (r.conv_id, r.turn))
    for a, b in zip(rows, rows[1:]):
        if a.conv_id == b.conv_id:
            for m in SequenceMatcher(None, a.w, b.w, autojunk=False).get_matching_blocks():
                want[a.conv_id][m.b - m.a] += m.size
    got = {r.conv_id: r.n for r in QUERIES["met_token_latency"](spark, SF).collect()}
    assert got == {k: c.total() for k, c in want.items() if c.total()}


# tracks, decodes, windows


def test_two_tracks():
    partials = ["a", "a b", "a b x", "a b c d", "z", "a b c d e"]
    out = run(sessions.two_tracks(2), [(p.split(),) for p in partials])
    assert out == [(0, "draft", "a"), (1, "final", "a"), (1, "draft", "b"), (2, "final", "b"), (2, "draft", "x"), (3, "draft", "c d"), (5, "draft", "c d e"), (6, "final", "c d e")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), max_size=8), st.integers(1, 3))
def test_final_words_are_never_taken_back(partials, repeats):
    out = run(sessions.two_tracks(repeats), [(p,) for p in partials])
    final: list[str] = []
    for n, track, text in out:
        if track == "final":
            final += text.split()
        elif len(partials[n]) > len(final):
            assert text.split() == partials[n][len(final) :]
    assert not partials or len(final) >= len(partials[-1])


def test_decodes_and_windows():
    assert run(sessions.decoding(480, 960), [(n,) for n in (200, 200, 100, 500, 400, 100, 2000)]) == [(500, 500), (1500, 1000), (3500, 2000)]
    assert run(sessions.evicting(10), [(n,) for n in (4, 5, 6, 30, 1, 2)]) == [(4, 1, 0), (9, 2, 0), (6, 1, 9), (30, 1, 15), (1, 1, 45), (3, 2, 45)]


def test_window_query(spark):
    sizes = defaultdict(list)
    for r in sorted(_tokens(spark), key=lambda r: (r.conv_id, r.turn)):
        sizes[r.conv_id].append(len(r.w))
    want = Counter()
    for conv, own in sizes.items():
        for k in range(len(own)):
            first = 0
            while sum(own[first : k + 1]) > 120 and first < k:
                first += 1
            want[conv, sum(own[first : k + 1]), k + 1 - first, sum(own[:first])] += 1
    got = QUERIES["stm_evicting_window"](spark, SF).collect()
    assert Counter((r.conv_id, r.held, r.segments, r.offset) for r in got) == want
