"""Periodic runs against brute force: the arrays, the runs, and the query's digests."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tidewater.llm import word_runs
from tidewater.llm.queries import QUERIES

WORDS = st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k), max_size=40))


def plain_runs(w, shortest):
    """By period, smallest first: maximal stretches that agree with themselves p later, without multiples of a smaller period's."""
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j + p - i
            if n >= max(2 * p, shortest) and not any(s <= i and s + m >= i + n and p % q == 0 for s, m, q in out):
                out.append((i, n, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(WORDS, st.sampled_from([1, 2, 12]))
def test_runs_equal_brute_force(w, shortest):
    assert word_runs.runs(w, shortest) == plain_runs(w, shortest)


@settings(max_examples=200, deadline=None)
@given(WORDS)
def test_lyndon_array_and_extensions(w):
    after, ext = word_runs.lyndon(w)
    left = word_runs.left_extensions(w, after)
    for i, j in enumerate(after):
        assert j == next((k for k in range(i + 1, len(w)) if w[k:] < w[i:]), len(w))
        same = 0
        while j + same < len(w) and w[i + same] == w[j + same]:
            same += 1
        assert ext[i] == same
        same = 0
        while same < min(j - i, i) and w[i - same - 1] == w[j - same - 1]:
            same += 1
        assert left[i] == same


class Counted(int):
    n = 0

    def __eq__(self, other):
        Counted.n += 1
        return int(self) == int(other)

    def __lt__(self, other):
        Counted.n += 1
        return int(self) < int(other)

    __hash__ = int.__hash__


def test_comparisons_are_linear():
    n = 4000
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < n:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    made = [fibonacci[1][:n], [1] * n, [k % 7 for k in range(n)], [(k & -k).bit_length() for k in range(1, n + 1)], list(range(n)), [k.bit_count() % 2 for k in range(n)]]
    made += [np.random.default_rng(s).integers(0, 2, n).tolist() for s in range(4)]
    for w in made:
        for own in (w, [-x for x in w]):
            Counted.n = 0
            after, _ = word_runs.lyndon([Counted(x) for x in own])
            word_runs.left_extensions([Counted(x) for x in own], after)
            assert Counted.n <= 7 * n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=5))
def test_stretches_hold_all_runs(texts):
    ids = np.array([x for t in texts for x in t], np.int64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    starts = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = sorted((a + s, n, p) for a, b in word_runs.stretches(ids, of) for s, n, p in word_runs.runs(ids[a:b].tolist()))
    assert got == sorted((int(starts[k]) + s, n, p) for k, t in enumerate(texts) for s, n, p in plain_runs(t, 12))


def digest(doc_id, text):
    w = brute.words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w, 12)
    top = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
    kept = [x for i, x in enumerate(w) if not any(s + p <= i < s + m for s, m, p in found)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(kept))


def short(rows):
    return [(k, t) for k, t in rows if t is None or len(t) < 5000]


def test_query_equals_brute_force(spark, tmp_path):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    own = short(map(tuple, documents.collect()))
    spark.createDataFrame(own, documents.schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r)[:8] for r in QUERIES["op13_word_runs"](spark, str(tmp_path)).collect())
    want = sorted(digest(*r) for r in own)
    assert got == want and sum(w[1] > 0 for w in want) > 10


def test_odd_inputs(spark, docs, rows, no_docs):
    got = word_runs.digests(word_runs.find_runs(docs, plant=True))
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted((digest(k, t) for k, t in short([r[:2] for r in rows])), key=key)
    small = {w[0] for w in want} - {r[0] for r in rows if len(r[1] or "") >= 5000}
    assert sorted((tuple(r)[:8] for r in got.collect() if r.doc_id in small), key=key) == [w for w in want if w[0] in small]
    whole = {r.doc_id: r for r in word_runs.find_runs(docs).collect()}
    assert [tuple(x) for x in whole[506].runs] == [(0, 9000, 1)] and whole[506].collapsed == "say"
    assert whole[507].n_words == 30000 and whole[500].runs == [] and whole[500].collapsed == ""
    assert got.count() == len(rows) and word_runs.find_runs(no_docs).collect() == []
