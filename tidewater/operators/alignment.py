"""Sequence alignment: edit operations, matching blocks, votes. Each row's sequences are aligned in an Arrow-fed function."""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDITS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("n_ref", "cor", "sub", "ins", "del", "dist")])
OPCODES = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("a0", "a1", "b0", "b1")]]))


#: Cells of a cost matrix that is kept whole.
WHOLE_MATRIX = 1 << 22


def edit_operations(hyp: list[str], ref: list[str]) -> tuple[int, int, int, int, int]:
    """Correct, substituted, inserted and deleted tokens and the distance; ties prefer substitution, then insertion.

    Rows of the cost matrix are made whole in numpy: a row's insertions depend on the row above only, and its
    deletions are a running minimum. Of a large matrix every sqrt(n)th row is kept and the walk back makes the rows
    between them again, so memory is m * sqrt(n).
    """
    n, m = len(hyp), len(ref)
    if not n or not m:
        return 0, 0, n, m, max(n, m)
    names = {t: k for k, t in enumerate(dict.fromkeys([*hyp, *ref]))}
    h, r = (np.array([names[t] for t in s]) for s in (hyp, ref))
    steps = np.arange(m + 1, dtype=np.int32)

    def next_row(above: np.ndarray, token: int) -> np.ndarray:
        row = np.empty(m + 1, np.int32)
        row[0] = above[0] + 1
        row[1:] = np.minimum(above[:-1] + (r != token), above[1:] + 1)
        return np.minimum.accumulate(row - steps) + steps

    size = n if n * m <= WHOLE_MATRIX else math.isqrt(n) + 1
    row, kept = steps, [steps]
    for i in range(1, n - (n - 1) % size):
        row = next_row(row, h[i - 1])
        if i % size == 0:
            kept.append(row)
    i, j, cor, sub, ins, dele, dist = n, m, 0, 0, 0, 0, 0
    first = -1  # the row of the matrix that cost begins with
    cost = np.zeros((0, 0), np.int32)

    while i and j:
        if (i - 1) // size * size != first:
            first = (i - 1) // size * size
            cost = np.empty((min(n, first + size) - first + 1, m + 1), np.int32)
            cost[0] = kept[first // size]
            for k in range(1, len(cost)):
                cost[k] = next_row(cost[k - 1], h[first + k - 1])
            dist = dist or int(cost[-1, m])
        k = i - first
        if h[i - 1] == r[j - 1]:
            cor, i, j = cor + 1, i - 1, j - 1
        elif cost[k, j] == cost[k - 1, j - 1] + 1:
            sub, i, j = sub + 1, i - 1, j - 1
        elif cost[k, j] == cost[k - 1, j] + 1:
            ins, i = ins + 1, i - 1
        else:
            dele, j = dele + 1, j - 1
    return cor, sub, ins + i, dele + j, dist


def _walk_back(cost: np.ndarray, h: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Correct, substituted, inserted, deleted and distance of pairs whose cost matrices lie side by side (row of hyp, pair, row of ref)."""
    out = np.zeros((len(i), 5), np.int64)
    every = np.arange(len(i))
    out[:, 4] = cost[i, every, j]
    i, j = i.copy(), j.copy()
    while len(b := np.flatnonzero((i > 0) & (j > 0))):
        x, y = i[b], j[b]
        here = cost[x, b, y]
        same = h[b, x - 1] == r[b, y - 1]
        sub = ~same & (here == cost[x - 1, b, y - 1] + 1)
        ins = ~same & ~sub & (here == cost[x - 1, b, y] + 1)
        dele = ~same & ~sub & ~ins
        out[b, :4] += np.stack([same, sub, ins, dele], 1)
        i[b] -= same | sub | ins
        j[b] -= same | sub | dele
    out[:, 2] += i
    out[:, 3] += j
    return out


def edit_operations_of(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """edit_operations of many (hyp, ref): pairs of about one size go through their cost matrices together, a row at a time."""
    out = np.zeros((len(pairs), 5), np.int64)
    names: dict[str, int] = {}
    coded = [[np.array([names.setdefault(t, len(names)) for t in s], np.int64) for s in p] for p in pairs]
    order = sorted(range(len(pairs)), key=lambda k: (len(coded[k][0]), len(coded[k][1])))
    start = 0
    while start < len(order):
        stop, n, m = start, 0, 0
        while stop < len(order):
            a, b = max(n, len(coded[order[stop]][0])), max(m, len(coded[order[stop]][1]))
            if stop > start and (stop + 1 - start) * (a + 1) * (b + 1) > WHOLE_MATRIX:
                break
            stop, n, m = stop + 1, a, b
        some = order[start:stop]
        start = stop
        if len(some) == 1:
            out[some[0]] = edit_operations(*pairs[some[0]])
            continue
        h, r = np.full((len(some), n), -1), np.full((len(some), m), -2)
        for k, at in enumerate(some):
            h[k, : len(coded[at][0])], r[k, : len(coded[at][1])] = coded[at]
        steps = np.arange(m + 1, dtype=np.int32)
        cost = np.empty((n + 1, len(some), m + 1), np.int32)
        cost[0] = steps
        for i in range(1, n + 1):
            above, row = cost[i - 1], cost[i]
            row[:, 0] = i
            np.minimum(above[:, :-1] + (r != h[:, i - 1 : i]), above[:, 1:] + 1, out=row[:, 1:])
            row[:] = np.minimum.accumulate(row - steps, axis=1) + steps
        out[some] = _walk_back(cost, h, r, np.array([len(coded[k][0]) for k in some]), np.array([len(coded[k][1]) for k in some]))
    return out


@F.pandas_udf(EDITS)
def edits(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Edit operations of two token arrays; null counts as empty."""
    low = lambda s: [[] if x is None else [t.lower() for t in x] for x in s]
    pairs = list(zip(low(hyp), low(ref)))
    rows = np.column_stack([np.array([len(r) for _, r in pairs], np.int64), edit_operations_of(pairs)]) if pairs else np.zeros((0, 6))
    return pd.DataFrame(rows, columns=["n_ref", "cor", "sub", "ins", "del", "dist"]).astype("int32")


@F.pandas_udf(OPCODES)
def opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block opcodes (longest common blocks first) that turn a into b."""
    out = []
    for x, y in zip(a, b):
        m = SequenceMatcher(None, list(x), list(y), autojunk=False)
        out.append([dict(zip(("tag", "a0", "a1", "b0", "b1"), op)) for op in m.get_opcodes()])
    return pd.Series(out)


def distances_at(hyp: list[str], ref: list[str], points: list[tuple[int, int]]) -> list[int]:
    """Edit distances of the first i words of hyp and j of ref for each of the points (i, j), i rising: one walk over the cost matrix."""
    names = {t: k for k, t in enumerate(dict.fromkeys([*hyp, *ref]))}
    r = np.array([names[t] for t in ref], np.int64)
    steps, out, done = np.arange(len(ref) + 1), [], 0
    row = steps
    for i, j in points:
        for h in hyp[done:i]:
            new = np.r_[row[0] + 1, np.minimum(row[:-1] + (r != names[h]), row[1:] + 1)]
            row = np.minimum.accumulate(new - steps) + steps
        done = i
        out.append(int(row[j]))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("n_ref", "dist")])))
def prefix_distances(ref: pd.Series, hyp: pd.Series, sizes: pd.Series) -> pd.Series:
    """For parts of these sizes: words of ref up to each part's end, and their distance to hyp's words up to the part before."""
    out = []
    for a, b, n in zip(ref, hyp, sizes):
        ends = np.cumsum(n).tolist()
        got = distances_at(list(b), list(a), list(zip([0, *ends[:-1]], ends)))
        out.append([{"n_ref": e, "dist": d} for e, d in zip(ends, got)])
    return pd.Series(out)


def error_rates(pairs: DataFrame, keys: list[str], hyp: Column, ref: Column) -> DataFrame:
    """Corpus error rates by keys: sums of edits over sums of reference tokens, in percent."""
    e = pairs.select(*keys, edits(hyp, ref).alias("e"))
    total = lambda c: F.sum(f"e.{c}").alias(c)
    wrong = F.count_if(F.col("e.dist") > 0)
    out = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("sentences"), total("n_ref"), total("cor"), total("sub"), total("ins"), total("del"), total("dist"), wrong.alias("wrong_sentences"))
    return out.withColumn("error_rate", F.round(F.try_divide(F.col("dist") * 100.0, F.col("n_ref")), 2)).withColumn("sentence_error_rate", F.round(F.col("wrong_sentences") * 100.0 / F.col("sentences"), 2))


def chr_f_score(ref: str, hyp: str, longest: int = 6, beta: float = 2.0) -> float:
    """Character F-score with counts pooled over n-gram lengths; a text shorter than n is one gram."""
    overlap = n_ref = n_hyp = 0
    a, b = (" ".join(x.lower().split()) for x in (ref, hyp))
    for n in range(1, longest + 1):
        ga, gb = (Counter(x[i : i + n] for i in range(max(1, len(x) - n + 1))) if x else Counter() for x in (a, b))
        overlap, n_ref, n_hyp = overlap + (ga & gb).total(), n_ref + ga.total(), n_hyp + gb.total()
    if not overlap:
        return 0.0
    p, r = overlap / n_hyp, overlap / n_ref
    return (1 + beta**2) * p * r / (beta**2 * p + r)


@F.pandas_udf(T.DoubleType())
def chr_f(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([chr_f_score(a or "", b or "") for a, b in zip(ref, hyp)])
