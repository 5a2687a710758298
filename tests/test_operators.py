"""Operators that SQL cannot express, against stated vectors and plain loops."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import numbers as N
from tidewater.functions import text as T
from tidewater.operators import alignment as A
from tidewater.operators import clusters as C
from tidewater.operators import series as S
from tidewater.streaming import sessions


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v")).alias("o")).collect()]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("WIND TWO FOUR ZERO AT FIVE", "240,5"),
        ("TEMPERATURE ONE DEW POINT MINUS ONE", "1,-1"),
        ("DEW POINT MINUS TWO ZERO", "-20"),
        ("ALTIMETER THREE ZERO TWO THREE", "3023"),
        ("VISIBILITY ONE FIVE TWO FOUR THOUSAND FEET", "15,24000"),
        ("FREQUENCY ONE TWO THREE DECIMAL ONE FIVE", "12315"),
        ("TEMPERATURE MINUS THREE DEW POINT NEGATIVE TWO", "-3,-2"),
        ("ZERO TWO ZERO ZERO", "0200"),
        ("MINUS", ""),
        ("THOUSAND", ""),
    ],
)
def test_english_numbers(line, want):
    assert ",".join(N.english_numbers(line)) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [("风240 度5", "240,5"), ("气温1 露点零下1", "1,-1"), ("修正海压30.23", "3023"), ("能见度15 云高24000", "15,24000"), ("温度零下三 露点负二", "-3,-2"), ("温度零下", ""), ("云高15,240米", "15240"), ("一万五千二百四十", "15240"), ("二四零", "240"), ("修压3023（30.23 英寸汞柱）", "3023")],
)
def test_chinese_numbers(line, want):
    assert ",".join(N.canonical(n) for n in N.chinese_numbers(line)) == want


def test_grammar_completion(spark):
    lines = {
        "INFORM THAT YOU HAVE INFORMATION A": ("INFORM ATC THAT YOU HAVE INFORMATION A", 1),
        "INFORM ATC THAT YOU HAVE INFORMATION A": ("INFORM ATC THAT YOU HAVE INFORMATION A", 0),
        "WEATHER AT ONE THREE ZERO ZERO WIND": ("WEATHER AT ONE THREE ZERO ZERO ZULU WIND", 1),
        "ZULU TWO THREE ZERO AT ONE TWO": ("ZULU WIND TWO THREE ZERO AT ONE TWO", 1),
        "FREQUENCY ONE TWO THREE ONE TWO": ("FREQUENCY ONE TWO THREE DECIMAL ONE TWO", 1),
        "JOHNS INFORMATION A": ("SAINT JOHNS INFORMATION A", 1),
        "WEATHER AT IT ONE THREE ZERO ZERO": ("WEATHER AT IT ONE THREE ZERO ZERO", 0),
    }
    got = column(spark, lines, T.complete_grammar)
    assert [(r.text, r.fixes) for r in got] == list(lines.values())
    again = column(spark, [r.text for r in got], T.complete_grammar)
    assert [r.text for r in again] == [r.text for r in got] and not any(r.fixes for r in again)


def test_text_functions(spark):
    assert column(spark, ["Wind 240 at 5 ft", "St. John's hPa", "123.15"], T.norm_asr) == ["wind two four zero at five feet", "saint johns", "one two three one five"]
    assert column(spark, ["15,240", "1,5", "1234,567", "1,234,567 ft"], T.merge_thousands) == ["15240", "1,5", "1234,567", "1234567 ft"]
    assert column(spark, ["-15", "30.23", "0200"], T.canonical_number) == ["-15", "3023", "0200"]
    assert column(spark, ["cleared to land thank you. Thanks!", "bye-bye", "subscribe now ok"], T.strip_closing) == ["cleared to land", "", "subscribe now ok"]
    assert column(spark, ["135.15 x"], T.norm_upper) == ["135 POINT 15 X"]
    assert column(spark, ["ARNAV VISABILITY WETHER ALCIMBER"], T.apply_phrases) == ["RNAV VISIBILITY WEATHER ALTIMETER"]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_edit_operations(hyp, ref):
    cor, sub, ins, dele, dist = A.edit_operations(hyp, ref)
    assert dist == plain_distance(hyp, ref) == sub + ins + dele
    assert cor + sub + dele == len(ref) and cor + sub + ins == len(hyp)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9)), max_size=8))
def test_pairs_together_give_what_each_gives(pairs):
    assert A.edit_operations_of(pairs).tolist() == [list(A.edit_operations(*p)) for p in pairs]


def test_pairs_beyond_the_matrix_go_alone(monkeypatch):
    r = random.Random(2)
    pairs = [([r.choice("ab") for _ in range(r.randint(0, 30))], [r.choice("ab") for _ in range(r.randint(0, 30))]) for _ in range(40)]
    want = [list(A.edit_operations(*p)) for p in pairs]
    monkeypatch.setattr(A, "WHOLE_MATRIX", 500)
    assert A.edit_operations_of(pairs).tolist() == want


def test_chr_f():
    assert A.chr_f_score("same text", "Same  text") == pytest.approx(1.0)
    assert A.chr_f_score("", "x") == 0.0 and A.chr_f_score("abc", "xyz") == 0.0
    assert 0 < A.chr_f_score("abcd", "abxd") < 1


def plain_merge(segments, longest, shortest):
    if len(segments) <= 1:
        return [tuple(s) for s in segments]
    points, out, begin = sorted({x for s in segments for x in s}), [], 0
    for here, after in zip(points, points[1:]):
        if after - begin >= longest:
            if here - begin > shortest:
                out.append((begin, here))
            begin = here
    return [*out, (begin, points[-1])]


def test_merge_segments(spark):
    r = random.Random(4)
    cases = []
    for _ in range(30):
        cut = sorted(r.sample(range(60000), 2 * r.randint(0, 8)))
        cases.append(list(zip(cut[::2], cut[1::2])))
    got = column(spark, cases, lambda c: S.merge_segments(c, 15000, 100), "array<struct<begin:long,end:long>>")
    assert [[tuple(x) for x in g] for g in got] == [plain_merge(c, 15000, 100) for c in cases]


def test_endpoint_vectors():
    rule = sessions.Rule(silence=5, shortest=10, longest=20)
    events, _ = sessions.endpoints([1] * 5 + [0] * 30 + [1] * 25, rule)
    finals = [e for e in events if e[0] == "finalize"]
    assert sum(e[0] == "drop_short" for e in events) >= 1
    assert all(e[2] > e[1] for e in finals) and finals[-1][1:] == (35, 55, "max_utt")
    events, _ = sessions.endpoints([1] * 20 + [0] * 10, sessions.Rule(5, 3, 100))
    assert len(events) == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), max_size=80), st.lists(st.integers(1, 9), max_size=20))
def test_chunks_do_not_matter(frames, sizes):
    rule = sessions.Rule(3, 2, 8)
    whole, state, parts, at = sessions.endpoints(frames, rule)[0], sessions.Utterance(), [], 0
    for n in [*sizes, len(frames)]:
        got, state = sessions.endpoints(frames[at : at + n], rule, state)
        parts += got
        at += n
    assert parts == whole


def test_stream_equals_batch(spark):
    from tidewater.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    a, b = (sorted(map(str, QUERIES[n](spark, sf).collect())) for n in ("stm_endpointing", "stm_endpointing_batch"))
    assert a and a == b


def test_hysteresis_and_commits():
    assert sessions.hysteresis([0, 1, 1, 1, 0, 0, 0, 0], sessions.Gate(4, 3, 1)) == [(3, "open"), (6, "close")]
    assert sessions.commit_stable([["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "x"]]) == [(1, "a"), (2, "b")]


def test_spectral_clusters():
    r = np.random.default_rng(0)
    centres = np.eye(3, 16) * 5
    want = np.repeat([0, 1, 2], 15)
    labels = C.spectral_labels(centres[want] + r.normal(size=(45, 16)) * 0.1)
    assert (labels == want).all()
    assert (C.spectral_labels(r.normal(size=(10, 4))) == 0).all()


def test_smoothing(spark):
    rows = pd.DataFrame([("a", 0.0, 5.0, 0), ("a", 4.0, 4.5, 1), ("a", 4.5, 9.0, 0), ("a", 9.0, 12.0, 1)], columns=["s", "begin", "end", "speaker"]).astype({"speaker": float})
    got = C.smooth_speakers(spark.createDataFrame(rows), "s").orderBy("begin").collect()
    assert [(r.begin, r.end, r.speaker) for r in got] == [(0.0, 9.0, 0), (9.0, 12.0, 1)]


def test_dynamic_batches(spark):
    from tidewater.operators import manifest as M

    r = random.Random(2)
    lengths = [r.randint(1, 60) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(lengths)), "id int, n long").withColumn("g", F.lit(0))
    got = {x.id: x.batch for x in M.batches_by_tokens(df, "g", ["id"], "n", 100).collect()}
    batch, rows, longest = 0, 0, 0
    for k, n in enumerate(lengths):
        if max(longest, n) * (rows + 1) > 100:
            batch, rows, longest = batch + 1, 0, 0
        rows, longest = rows + 1, max(longest, n)
        assert got[k] == batch


def test_best_overlap(spark):
    r = random.Random(3)
    mk = lambda n: [(k, b, b + r.randint(1, 90)) for k, b in ((k, r.randint(0, 900)) for k in range(n))]
    q, s = mk(40), mk(25)
    qd = spark.createDataFrame([(1, *x) for x in q], "g int, id int, begin int, end int")
    sd = spark.createDataFrame([(1, *x) for x in s], "g int, span int, span_begin int, span_end int")
    got = {x.id: (x.span, x.overlap) for x in S.best_overlap(qd, sd, 50, ["g"]).collect()}
    want = {}
    for (i, b, e), (k, sb, se) in itertools.product(q, s):
        o = min(e, se) - max(b, sb)
        if o > 0 and (i not in want or (o, -k) > (want[i][1], -want[i][0])):
            want[i] = (k, o)
    assert got == want


def test_thresholds_and_online_speakers():
    p = [0.1, 0.6, 0.4, 0.3, 0.6, 0.2, 0.2, 0.2, 0.9]
    assert sessions.threshold_spans(p, sessions.Threshold(0.5, 0.35, 2, 0)) == [(1, 5), (8, 9)]
    assert sessions.threshold_spans([], sessions.Threshold(0.5, 0.35, 2, 0)) == []
    v = [[1, 0], [0.9, 0.1], [0, 1], [0.1, 1], [1, 0.05]]
    assert sessions.online_speakers(v) == [0, 0, 1, 1, 0]
    assert sessions.online_speakers([[1, 0], [0, 1], [-1, 0.1]], most=2) == [0, 1, 1]


def test_batches_cap_rows(spark):
    from tidewater.operators import manifest as M

    df = spark.createDataFrame([(0, k, 1) for k in range(10)], "g int, id int, n long")
    got = {r.id: r.batch for r in M.batches_by_tokens(df, "g", ["id"], "n", 1000, max_rows=4).collect()}
    assert [got[k] for k in range(10)] == [0] * 4 + [1] * 4 + [2] * 2


def _edits_plainly(hyp, ref):
    n, m = len(hyp), len(ref)
    cost = [[max(i, j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (hyp[i - 1] != ref[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    return cost[n][m]


@pytest.mark.parametrize("whole", [1 << 22, 50])
def test_edit_operations_with_part_of_the_matrix(monkeypatch, whole):
    r = random.Random(7)
    cases = [[[r.choice("abcd") for _ in range(r.randint(0, 40))] for _ in range(2)] for _ in range(60)]
    want = [A.edit_operations(h, f) for h, f in cases]
    monkeypatch.setattr(A, "WHOLE_MATRIX", whole)
    for (h, f), w in zip(cases, want):
        cor, sub, ins, dele, dist = A.edit_operations(h, f)
        assert (cor, sub, ins, dele, dist) == w
        assert dist == sub + ins + dele == _edits_plainly(h, f) and cor + sub + ins == len(h) and cor + sub + dele == len(f)


def test_joins_at_the_longest_overlap():
    from tidewater.functions import udfs

    r = random.Random(8)
    for _ in range(300):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in range(2))
        n = next((n for n in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:n])), 0)
        want = a + b[n:] if n >= max(2, min(len(a), len(b)) // 4) else None
        assert udfs.joined(a, b, least=2) == want
    assert udfs.joined("x" * 200_000, "x" * 200_000) == "x" * 200_000


def test_repeats_are_cut():
    from tidewater.functions import udfs

    cut = lambda t: None if udfs.end_of_repeats(t) is None else t[: udfs.end_of_repeats(t)]
    assert cut("we stop, stop, stop it") == "we stop"
    assert cut("and lalalala so") == "and la"
    assert cut("no repeats of any kind") is None and cut("") is None
    assert cut("123 123 123 123") is None
    assert cut("hmmmm") == "hm"


def test_warping_and_clusters_equal_plain_search():
    from tidewater.operators import sequences as Q

    r = np.random.default_rng(4)
    a, b = r.normal(size=(12, 7)), r.normal(size=(12, 5))
    want = [Q.warp_path(np.abs(np.subtract.outer(x, y)))[0] for x, y in zip(a, b)]
    assert np.allclose(Q.warp_distances(a, b), want)
    for _ in range(30):
        n = int(r.integers(1, 8))
        near = r.random((n, n))
        near = (near + near.T) / 2
        loss = r.random(n).tolist()
        sets = [s for k in range(1, n + 1) for s in itertools.combinations(range(n), k) if all(near[i, j] >= 0.5 for i, j in itertools.combinations(s, 2))]
        best = min(sets, key=lambda s: (-len(s), sum(loss[i] for i in s) / len(s)))
        assert Q.compatible_cluster(near, loss, 0.5) == best


def test_grammar_and_closings_over_tokens(spark):
    lines = {
        "WEATHER AT ONE TWO ZERO ZERO TWO FOUR ZERO AT FIVE": ("WEATHER AT ONE TWO ZERO ZERO ZULU WIND TWO FOUR ZERO AT FIVE", 2),
        "WEATHER AT ONE TWO ZERO ZERO ZULU WIND TWO FOUR ZERO AT FIVE": ("WEATHER AT ONE TWO ZERO ZERO ZULU WIND TWO FOUR ZERO AT FIVE", 0),
        "FREQUENCY ONE TWO ONE FIVE": ("FREQUENCY ONE TWO DECIMAL ONE FIVE", 1),
        "FREQUENCY ONE TWO ONE": ("FREQUENCY ONE TWO ONE", 0),
        "SAINT JOHNS INFORMATION B THAT YOU HAVE INFORMATION B": ("SAINT JOHNS INFORMATION B INFORM ATC THAT YOU HAVE INFORMATION B", 1),
        "THAT YOU HAVE INFORMATION": ("INFORM ATC THAT YOU HAVE INFORMATION", 1),
        "": ("", 0),
    }
    assert [(r.text, r.fixes) for r in column(spark, lines, T.complete_grammar)] == list(lines.values())
    closings = {"Thank you for watching. Bye bye. Thanks!": "", "over and out, thank you everyone": "over and out,", "thanks for all": "thanks for all", "ok Amara.org": "ok", "a bye-bye thank you": "a", "": ""}
    assert column(spark, list(closings), T.strip_closing) == list(closings.values())


def test_walked_speaker(spark):
    turns = [(1, 0, 10), (2, 10, 22), (1, 22, 30), (2, 30, 60)]
    rows = spark.createDataFrame([(0, 30, turns), (100, 110, turns), (0, 30, [])], "a long, b long, l array<struct<spk:long,a:long,b:long>>")
    # speaker 1 holds 20 after its first turn counts twice; 12 of speaker 2 and 8 more of speaker 1 do not change hands
    assert [r[0] for r in rows.select(S.walked_speaker(F.col("a"), F.col("b"), F.col("l"))).collect()] == [1, 0, 0]
