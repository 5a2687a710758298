"""Alignments and searches over numeric sequences, grouped by session: time warping, forced alignment, keyword search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def warp_path(cost: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """The cheapest monotone path through a cost matrix; ties prefer the diagonal."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            total[i, j] = cost[i - 1, j - 1] + min(total[i - 1, j - 1], total[i - 1, j], total[i, j - 1])
    i, j, path = n, m, []
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: total[p])
    return float(total[n, m]), path[::-1]


def warp_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Warping distances of rows of equal shape; the table of costs is walked once for all rows, two of its lines at a time."""
    above = np.full((len(a), b.shape[1] + 1), np.inf)
    above[:, 0] = 0
    for i in range(a.shape[1]):
        line = np.full_like(above, np.inf)
        cost = np.abs(a[:, i : i + 1] - b)
        best = np.minimum(above[:, 1:], above[:, :-1])
        for j in range(b.shape[1]):
            line[:, j + 1] = cost[:, j] + np.minimum(best[:, j], line[:, j])
        above = line
    return above[:, -1]


@F.pandas_udf(T.DoubleType())
def warp_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Dynamic time warping distance of two number arrays; null where one is null or empty."""
    out = pd.Series([None] * len(a), index=a.index, dtype=object)
    size = lambda s: s.map(lambda x: 0 if x is None else len(x))
    for (n, m), rows in a.groupby([size(a), size(b)]).groups.items():
        if n and m:
            out[rows] = warp_distances(*(np.stack([np.asarray(x, float) for x in s[rows]]) for s in (a, b)))
    return out.astype(float)


def forced_alignment(log_probs: np.ndarray, labels: list[int], blank: int = 0) -> list[int]:
    """The label of each frame on the best path that collapses to labels: Viterbi over labels with blanks between."""
    states = [blank]
    for x in labels:
        states += [x, blank]
    s = np.array(states)
    skip = np.zeros(len(s), bool)
    skip[2:] = (s[2:] != blank) & (s[2:] != s[:-2])
    score = np.full(len(s), -np.inf)
    score[:2] = log_probs[0, s[:2]]
    back = np.zeros((len(log_probs), len(s)), np.int8)
    for t in range(1, len(log_probs)):
        moves = np.stack([score, np.r_[-np.inf, score[:-1]], np.where(skip, np.r_[-np.inf, -np.inf, score[:-2]], -np.inf)]) if len(s) > 1 else score[None]
        back[t] = moves.argmax(0)
        score = moves.max(0) + log_probs[t, s]
    k = len(s) - 1 if len(s) < 2 or score[-1] >= score[-2] else len(s) - 2
    path = []
    for t in range(len(log_probs) - 1, -1, -1):
        path.append(int(s[k]))
        k -= int(back[t, k])
    return path[::-1]


def align_sessions(df: DataFrame, session: str, order: str, vector: str, labels: list[int]) -> DataFrame:
    """The aligned label of every frame; vector holds a session's scores by label."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        x = np.stack(own[vector].to_numpy()).astype(float)
        x -= np.logaddexp.reduce(x, axis=1, keepdims=True)
        return pd.DataFrame({session: own[session], order: own[order], "label": forced_alignment(x, labels)})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(session, order, vector).groupBy(session).applyInPandas(run, f"{session} {kinds[session]}, {order} {kinds[order]}, label long")


def compatible_cluster(similar: np.ndarray, loss: list[float], least: float = 0.3) -> tuple[int, ...]:
    """The largest set of candidates that are pairwise alike; ties go to the lower mean loss, then to the first.

    Branches of the search that cannot reach the best size so far are cut: of the open candidates no two of one colour are alike, so
    a cluster has one of each colour at most.
    """
    n = len(loss)
    near = [{j for j in range(n) if j != i and similar[i, j] >= least} for i in range(n)]

    def colours(open_: list[int]) -> int:
        classes: list[set[int]] = []
        for i in open_:
            own = next((c for c in classes if not c & near[i]), None)
            if own is None:
                classes.append({i})
            else:
                own.add(i)
        return len(classes)

    best: tuple = (0, 0.0, ())
    stack = [((), list(range(n)))]
    while stack:
        taken, open_ = stack.pop()
        if len(taken) + len(open_) < -best[0] or len(taken) + colours(open_) < -best[0]:
            continue
        if taken:
            best = min(best, (-len(taken), sum(loss[i] for i in taken) / len(taken), taken))
        for k, i in enumerate(open_):
            stack.append(((*taken, i), [j for j in open_[k + 1 :] if j in near[i]]))
    return best[2]


def cluster_candidates(df: DataFrame, key: str, name: str, tokens: str, loss: str, least: float = 0.3) -> DataFrame:
    """winner and members of each key's compatible cluster of candidates."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(name).reset_index(drop=True)
        sets = [set(t) for t in own[tokens]]
        similar = np.array([[len(a & b) / max(1, len(a | b)) for b in sets] for a in sets])
        members = compatible_cluster(similar, own[loss].tolist(), least)
        winner = min(members, key=lambda i: own[loss][i])
        return pd.DataFrame({key: [own[key].iloc[0]], "winner": [own[name][winner]], "members": [",".join(str(own[name][i]) for i in members)]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(key, name, tokens, loss).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, winner {kinds[name]}, members string")
