"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only documents have labels. A sentence is toxic with chance
p = sigmoid(bias + weights of its distinct words), where a word weighs the sum of its own weight and those of its
beginnings (3 to 7 characters; so inflected and invented forms of a stem are known), and a document with chance 1 - prod(1 - p): noisy-or. The weights
are fitted to document labels by proximal Adam steps on that likelihood, so the blame for a label
falls on the sentences that explain it; the fitted p then locates the offending sentences.

The fit uses a bounded sample of labelled documents (max_per_class of each label, by hash of the id, texts of up
to max_chars), weighted back to the label's frequency; the words come from that sample, and the model
is at most max_words numbers. Scoring is one map over all whole texts.

Cases: null and empty texts, and texts without words, score 0; texts may be of any length; repeated rows score alike;
labels without a document or other than 0 and 1, and null ids, are not learnt from; with labels of one kind only, scores are
the label; no labels at all give 0; an empty table gives an empty result; columns other than id and
text are not read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import prepare

MAX_PER_CLASS, MAX_CHARS, MAX_WORDS, MIN_DOCUMENTS = 2000, 60_000, 12_000, 3
PREFIXES = (3, 4, 5, 6, 7)
WORD_CACHE = 500_000
STEPS, RATE, L1 = 250, 0.1, 2e-4
_sentences = re.compile(r"[^.!?\n]+").finditer
_words = re.compile(r"[^\W_]+").findall


@dataclass
class Model:
    bias: float
    weights: dict[str, float]


def held_out(id_column: str = "doc_id") -> Column:
    """Every fifth document, by crc32 of the id as text, is never learnt from."""
    return F.coalesce(F.crc32(F.encode(F.col(id_column).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_per_class: int, max_chars: int, id_column: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray, dict[int, int]]:
    """Texts and labels of the bounded sample, and how many labelled documents each label has."""
    known = labels.where(~held_out(id_column) & F.col(id_column).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    totals = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).orderBy("_y").collect()}
    if not totals:
        return [], np.zeros(0), totals
    # labels whose document is not there, or too long to learn from, take no place in the sample
    own = docs.where(F.char_length(text) <= max_chars).select(F.col(id_column).alias("_id"))
    known = known.join(own, "_id", "left_semi")
    parts = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_per_class) for y in totals]
    some = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).where(F.char_length("_text") <= max_chars)
    # `some` has max_per_class rows of each label at most
    rows = texts.join(F.broadcast(some), "_id").select("_id", "_y", "_text").collect()
    rows.sort(key=lambda r: (r["_id"], r["_text"]))
    return [r["_text"] for r in rows], np.array([r["_y"] for r in rows], float), totals


def features(word: str) -> list[str]:
    """The word, and its beginnings with a star."""
    return [word, *[word[:n] + "*" for n in PREFIXES if n < len(word)]]


def fit(texts: list[str], y: np.ndarray, totals: dict[int, int], max_words: int = MAX_WORDS) -> Model:
    if not len(y) or len(set(y)) < 2:
        return Model(40.0 if len(y) and y[0] else -40.0, {})
    # the words and beginnings that tell the labels apart best, by chi-square over documents
    seen = [Counter(), Counter()]
    for t, label in zip(texts, y):
        seen[int(label)].update({f for w in set(_words(t.lower())) for f in features(w)})
    n = [max(1, int((y == label).sum())) for label in (0, 1)]
    found = [f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= MIN_DOCUMENTS]
    rate = {f: (seen[0][f] / n[0], seen[1][f] / n[1], (seen[0][f] + seen[1][f]) / sum(n)) for f in found}
    best = sorted(found, key=lambda f: (-((rate[f][1] - rate[f][0]) ** 2) / (rate[f][2] * (1 - rate[f][2]) + 1e-9), f))[:max_words]
    vocabulary = {f: k for k, f in enumerate(best)}
    del seen, found, rate
    sentence, word, document = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        for m in _sentences(t.lower()):
            s = set(_words(m.group()))
            if s:
                k = [vocabulary[f] for w in sorted(s) for f in features(w) if f in vocabulary]
                sentence.extend([len(document)] * len(k))
                word.extend(k)
                document.append(d)
    sentence, word, document = (np.array(x, np.int32) for x in (sentence, word, document))
    share = np.array([totals[int(v)] / max(1, (y == v).sum()) for v in y])
    share /= share.sum()
    w, b = np.zeros(len(vocabulary)), -5.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sentence, w[word], minlength=len(document))
        p = 1 / (1 + np.exp(-z))
        # log of the chance that no sentence is toxic
        clean = np.bincount(document, -np.logaddexp(0, z), minlength=len(y))
        toxic = -np.expm1(clean)
        pull = np.where(y == 1, -np.exp(clean) / np.maximum(toxic, 1e-12), 1.0) * share
        dz = p * pull[document]
        g = np.r_[np.bincount(word, dz[sentence], minlength=len(w)), dz.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        # the proximal step of the L1 penalty, in Adam's metric
        shrink = RATE * L1 / (np.sqrt(v[:-1] / (1 - 0.999**step)) + 1e-8)
        w = np.sign(w) * np.maximum(0, np.abs(w) - shrink)
    return Model(float(b), {x: float(w[k]) for x, k in vocabulary.items() if w[k]})


class Scorer:
    """Scores sentences in one worker, remembering which words weigh anything."""

    def __init__(self, model: Model):
        self.bias, self.weights, self.met, self.heavy = model.bias, model.weights, set(), {}

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Begin, end and logit of each sentence that has a word, in the lowered text."""
        out, bags = [], []
        for m in _sentences(text.lower()):
            found = set(_words(m.group()))
            if found:
                bags.append((m.start(), m.end(), found))
        if len(self.met) > WORD_CACHE:
            self.met, self.heavy = set(), {}
        for w in set().union(*[b for _, _, b in bags]) - self.met:
            weight = sum(self.weights.get(f, 0.0) for f in features(w))
            if weight:
                self.heavy[w] = weight
            self.met.add(w)
        heavy, known = self.heavy, self.heavy.keys()
        for a, b, found in bags:
            z = self.bias
            for w in sorted(known & found):
                z += heavy[w]
            out.append((a, b, z))
        return out


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", locate_at: float = 0.5) -> DataFrame:
    """id, score, n_sentences and offending: (number, begin, end, chance) of each sentence whose chance reaches locate_at."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.bias, model.weights))
    line = math.log(locate_at / (1 - locate_at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(Model(*shared.value))
        for batch in batches:
            scores, n, found = [], [], []
            for t in batch.column(1).to_pylist():
                s = own.sentences(t or "")
                # 1 - prod(1 - p), in logs
                scores.append(-math.expm1(-sum(math.log1p(math.exp(z)) if z < 30 else z for _, _, z in s)))
                n.append(len(s))
                found.append([{"number": k, "begin": a, "end": b, "chance": 1 / (1 + math.exp(-z))} for k, (a, b, z) in enumerate(s) if z >= line])
            kind = pa.list_(pa.struct([("number", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(n, pa.int32()), pa.array(found, kind)], names=[id_column, "score", "n_sentences", "offending"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, score double, n_sentences int, offending array<struct<number:int,begin:int,end:int,chance:double>>")


def score_toxicity(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences and offending of every document."""
    prepare(docs.sparkSession)
    model = fit(*training_sample(docs, labels, "toxic", max_per_class, max_chars), max_words)
    out = score_documents(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")
