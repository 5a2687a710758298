"""Embedding operators: similarity, centroids, spectral clustering of a session, label smoothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ROWS, MAX_CLUSTERS, PRUNE, MERGE_AT = 20, 15, 0.022, 0.78


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's steps from farthest-point starts; no chance is involved."""
    centres = [x[int(np.argmax((x**2).sum(1)))]]
    while len(centres) < k:
        centres.append(x[int(np.argmax(np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)))])
    c = np.array(centres)
    labels = np.zeros(len(x), int)
    for _ in range(50):
        new = np.argmin(((x[:, None] - c[None]) ** 2).sum(2), axis=1)
        if (new == labels).all() and _:
            break
        labels = new
        c = np.array([x[labels == j].mean(0) if (labels == j).any() else c[j] for j in range(k)])
    return labels


def spectral_labels(x: np.ndarray, clusters: int | None = None) -> np.ndarray:
    """Clusters by the eigengap of a pruned affinity's Laplacian; then centroids nearer than MERGE_AT merge."""
    n = len(x)
    if n < MIN_ROWS:
        return np.zeros(n, int)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    a = unit @ unit.T
    low = int((1 - max(PRUNE, 6 / n)) * n)
    order = np.argsort(a, axis=1, kind="stable")[:, :low]
    np.put_along_axis(a, order, 0.0, axis=1)
    a = (a + a.T) / 2
    np.fill_diagonal(a, 0)
    values, vectors = np.linalg.eigh(np.diag(np.abs(a).sum(1)) - a)
    k = clusters or int(np.argmax(np.diff(values[: MAX_CLUSTERS + 1]))) + 1
    labels = _k_means(vectors[:, :k], k)
    if clusters is None:
        while len(names := np.unique(labels)) > 1:
            c = np.array([x[labels == j].mean(0) for j in names])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            near = np.triu(c @ c.T, 1)
            i, j = np.unravel_index(np.argmax(near), near.shape)
            if near[i, j] < MERGE_AT:
                break
            labels[labels == names[j]] = names[i]
    # by first appearance
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(int(v), len(seen)) for v in labels])


def cluster_sessions(df: DataFrame, session: str, order: str, vector: str) -> DataFrame:
    """A speaker label for each row of each session. A session is one recording, small enough for one task."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        x = np.stack(own[vector].to_numpy()).astype(float)
        return pd.DataFrame({session: own[session], order: own[order], "speaker": spectral_labels(x)})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(session, order, vector).groupBy(session).applyInPandas(run, f"{session} {kinds[session]}, {order} {kinds[order]}, speaker long")


def smooth_speakers(df: DataFrame, session: str, shortest: float = 0.7) -> DataFrame:
    """session, begin, end, speaker: overlaps split in the middle, short turns given to the nearer neighbour, runs merged."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        turns = own.sort_values(["begin", "end"])[["begin", "end", "speaker"]].to_numpy(float).tolist()
        for a, b in zip(turns, turns[1:]):
            if a[1] > b[0] + 1e-4:
                a[1] = b[0] = (a[1] + b[0]) / 2
        # each step sees the labels that the steps before it changed
        for i, turn in enumerate(turns):
            if len(turns) < 2:
                break
            turn[0], turn[1] = round(turn[0], 2), round(turn[1], 2)
            if turn[1] - turn[0] < shortest:
                before, after = i > 0, i + 1 < len(turns)
                take = i - 1 if before and (not after or turn[0] - turns[i - 1][1] <= turns[i + 1][0] - turn[1]) else i + 1
                turn[2] = turns[take][2]
        out: list[list[float]] = []
        for turn in turns:
            if out and turn[2] == out[-1][2] and turn[0] <= out[-1][1]:
                out[-1][1] = turn[1]
            else:
                out.append(turn)
        got = pd.DataFrame(out, columns=["begin", "end", "speaker"])
        got.insert(0, session, own[session].iloc[0])
        return got.astype({"speaker": "int64"})

    kind = df.schema[session].dataType.simpleString()
    return df.select(session, "begin", "end", "speaker").groupBy(session).applyInPandas(run, f"{session} {kind}, begin double, end double, speaker long")
