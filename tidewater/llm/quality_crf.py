"""Quality by a linear-chain conditional random field over lines.

Every line of a document is good or bad. A line's features, and those of the lines before and after it, give its
log-odds; a transition weight ties neighbours. Forward-backward gives each line's chance of being good, and their
mean weighted by line length is the document's quality; a logistic curve, fitted on the same sample, turns it
into the chance of label 1.

Only documents have labels. Training starts from every line bearing its document's label; then, twice, the lines
of bad documents are relabelled by the model (a bad document keeps at least its worst line bad) and the field
is fitted again. The sample is bounded as for toxicity: max_per_class documents of each label, texts of up to
max_chars, weighted back to the labels' frequency.

Cases: null and empty texts have no lines and get the curve's value for quality 0; lines without a word are skipped;
long lines and texts are taken whole; repeated rows score alike; labels other than 0 and 1 or without a document are not
learnt from; with labels of one kind, scores are that label, with none 0; an empty table gives an
empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import prepare
from tidewater.llm.toxicity import held_out, training_sample

MAX_PER_CLASS, MAX_CHARS = 2000, 60_000
STEPS, RATE, L2, ROUNDS = 150, 0.1, 1e-3, 3
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "#*$%&", "|<>{}[]\\/=_~^+@", " \t")
_TABLE = np.zeros((256, len(_CLASSES) + 1))
for _k, _chars in enumerate(_CLASSES):
    _TABLE[[ord(c) for c in _chars], _k] = 1
_TABLE[128:, -1] = 1
#: Shares of character classes, then: log words, word length, share of distinct words, of distinct word triples, of words met in the document before, last character a stop, seen before, one.
N_OWN = _TABLE.shape[1] + 8


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # own features, those of the line before, those of the line after
    stay: float  # log-odds of two neighbours being alike
    curve: tuple[float, float]
    prior: float | None = None  # the score where there was nothing to learn


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, N_OWN) features, and the lengths of the lines."""
    rows, lengths, seen, met = [], [], set(), set()
    for line in (text or "").split("\n"):
        raw = line.encode()
        words = raw.split()
        if not words:
            continue
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE
        n = len(words)
        distinct = set(words)
        triples = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
        rows.append([*(counts / len(raw)), np.log1p(n), min(len(raw) / n, 40.0), len(distinct) / n**0.9, triples, len(distinct & met) / len(distinct), words[-1][-1:] in b".!?", line in seen, 1.0])
        lengths.append(n)
        seen.add(line)
        met |= distinct
    return np.array(rows, float).reshape(len(rows), N_OWN), np.array(lengths, float)


def _neighbours(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own features beside those of the lines before and after in the same document (zeros at its ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts[:-1][starts[:-1] < len(x)]] = 0
    after[starts[1:][starts[1:] > 0] - 1] = 0
    return np.hstack([x, before, after])


def marginals(z: np.ndarray, starts: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once: log-odds z of good per line, documents at starts.

    Chance of good per line, chance that a line is like the one before it (0 for first lines), log partition.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, length = starts[:-1][order], sizes[order]
    # messages as log-odds of good; a chain of two states needs one number
    forward, backward, alike = np.zeros(len(z)), np.zeros(len(z)), np.zeros(len(z))
    link = lambda m: np.logaddexp(m + stay, 0) - np.logaddexp(m, stay)
    log_z = np.zeros(len(sizes))
    scale = np.zeros(len(sizes))
    steps = int(length[0]) if len(length) else 0
    alive = len(length) - np.searchsorted(length[::-1], np.arange(steps), side="right")
    for t in range(steps):
        at = first[: alive[t]] + t
        if t == 0:
            forward[at] = z[at]
        else:
            m = forward[at - 1]
            forward[at] = z[at] + link(m)
            scale[order[: alive[t]]] += np.logaddexp(m, stay)
    for t in range(steps - 1, 0, -1):
        at = first[: alive[t]] + t
        backward[at - 1] = link(z[at] + backward[at])
    good = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
    for t in range(1, steps):
        at = first[: alive[t]] + t
        a, b = forward[at - 1], z[at] + backward[at]
        both, none, other = a + b + stay, np.full(len(at), stay), np.logaddexp(a, b)
        top = np.logaddexp(both, none)
        alike[at] = np.exp(top - np.logaddexp(top, other))
    ends = starts[1:] - 1
    full = sizes > 0
    log_z[full] = np.logaddexp(forward[ends[full]], 0) + scale[full]
    return good, alike, log_z


def _qualities(good: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length-weighted means of the chances by document; 0 for documents without lines."""
    document = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return np.bincount(document, good * lengths, minlength=len(starts) - 1) / np.maximum(np.bincount(document, lengths, minlength=len(starts) - 1), 1)


def _fit_field(x: np.ndarray, y: np.ndarray, starts: np.ndarray, share: np.ndarray, w: np.ndarray, stay: float) -> tuple[np.ndarray, float]:
    """Adam on the penalised likelihood of the line labels y; share: weight of each document, summing to 1."""
    document = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    # the likelihood of a document counts as one line
    weight = (share / np.maximum(np.diff(starts), 1))[document]
    like = np.zeros(len(y))
    like[1:] = y[1:] == y[:-1]
    inner = np.ones(len(y), bool)
    inner[starts[:-1][starts[:-1] < len(y)]] = False
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        good, alike, _ = marginals(x @ w, starts, stay)
        g = np.r_[x.T @ ((good - y) * weight) + L2 * w, (((alike - like) * weight)[inner]).sum() + L2 * stay]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, stay = w - move[:-1], stay - move[-1]
    return w, float(stay)


def fit(texts: list[str], y: np.ndarray, totals: dict[int, int]) -> Model:
    none = np.zeros(N_OWN)
    # with nothing to learn from, what is known is how often each label occurs
    known = Model(none, none + 1, np.zeros(3 * N_OWN), 0.0, (0.0, 0.0), totals.get(1, 0) / max(1, sum(totals.values())))
    if len(set(y)) < 2:
        return known
    found = [line_features(t) for t in texts]
    keep = [k for k, (f, _) in enumerate(found) if len(f)]
    if len({y[k] for k in keep}) < 2:
        return known
    found, y = [found[k] for k in keep], y[keep]
    starts = np.r_[0, np.cumsum([len(f) for f, _ in found])]
    raw, lengths = np.vstack([f for f, _ in found]), np.concatenate([n for _, n in found])
    mean, scale = raw.mean(0), raw.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = _neighbours((raw - mean) / scale, starts)
    document = np.repeat(np.arange(len(y)), np.diff(starts))
    share = np.array([totals[int(v)] / max(1, (y == v).sum()) for v in y])
    share /= share.sum()
    labels = y[document]
    w, stay = np.zeros(x.shape[1]), 0.0
    for turn in range(ROUNDS):
        if turn:
            good, _, _ = marginals(x @ w, starts, stay)
            labels = np.where(y[document] == 1, 1.0, (good >= 0.5).astype(float))
            for d in np.flatnonzero(y == 0):
                s = slice(starts[d], starts[d + 1])
                labels[s.start + int(np.argmin(good[s]))] = 0
        w, stay = _fit_field(x, labels, starts, share, w, stay)
    good, _, _ = marginals(x @ w, starts, stay)
    q = _qualities(good, lengths, starts)
    # the curve: a logistic regression on one number, by Newton steps
    a, b = np.zeros(2), np.c_[q, np.ones(len(q))]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(b @ a, -30, 30)))
        g = b.T @ ((p - y) * share) + 1e-5 * np.r_[a[0], 0]
        h = (b * (p * (1 - p) * share)[:, None]).T @ b + np.diag([1e-5, 1e-9])
        a = a - np.clip(np.linalg.solve(h, g), -5, 5)
    return Model(mean, scale, w, stay, (float(a[0]), float(a[1])))


def batch_scores(texts: list[str | None], model: Model) -> tuple[np.ndarray, list[np.ndarray]]:
    """Score of each text, and the chance of good of each of its lines."""
    found = [line_features(t) for t in texts]
    starts = np.r_[0, np.cumsum([len(f) for f, _ in found])].astype(int)
    raw, lengths = np.vstack([f for f, _ in found]), np.concatenate([n for _, n in found])
    x = _neighbours((raw - model.mean) / model.scale, starts)
    good, _, _ = marginals(x @ model.weights, starts, model.stay)
    q = _qualities(good, lengths, starts)
    score = 1 / (1 + np.exp(-np.clip(model.curve[0] * q + model.curve[1], -500, 500)))
    if model.prior is not None:
        score = np.full(len(texts), model.prior)
    return score, [good[starts[k] : starts[k + 1]] for k in range(len(texts))]


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score and line_marginals (chance of good of each line with a word)."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**shared.value)
        for batch in batches:
            if batch.num_rows:
                score, good = batch_scores(batch.column(1).to_pylist(), own)
                offsets = np.r_[0, np.cumsum([len(g) for g in good])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(good), pa.float64()))], names=[id_column, "score", "line_marginals"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, score double, line_marginals array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines and n_bad_lines of every document."""
    prepare(docs.sparkSession)
    model = fit(*training_sample(docs, labels, "quality", max_per_class, max_chars))
    out = score_documents(docs, model)
    bad = F.size(F.filter("line_marginals", lambda x: x < 0.5))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("line_marginals").alias("n_lines"), bad.alias("n_bad_lines"))
