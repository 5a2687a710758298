"""Toxicity, SentencePiece, token counts and the line field against definitions, libraries and held-out accuracy."""

from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from tidewater.llm import quality_crf, sentencepiece_codec, token_counts, toxicity

SF = "/root/testdata/sf0.01"


def test_token_counts_equal_the_library(docs, rows, no_docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_counts.default_tokenizer())
    out = token_counts.count_tokens(docs, entries=50, sample_documents=20, cache_entries=100).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out)
    texts = [r[1] or "" for r in rows]
    n = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert got == sorted((r[0] is None, r[0] or 0, len(t.encode()), k, k > 1024) for r, t, k in zip(rows, texts, n))
    assert token_counts.count_tokens(no_docs).collect() == []


def test_token_counts_take_no_shuffle(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "LONG_TEXT", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = token_counts.count_tokens(docs)
    assert "Exchange" not in out._jdf.queryExecution().toString()
    lib = Tokenizer.from_file(token_counts.default_tokenizer())
    counter = token_counts.PreTokenCounter(token_counts.default_tokenizer(), {})
    texts = ["many words here <|endoftext|> " * 20, "y" * 3000, " " * 3000 + "z", ""]
    assert counter.count(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert all(len(p) <= token_counts.KEPT_LENGTH for p in counter.cache)


def test_runs_of_spaces_and_long_words():
    import time

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    texts = [*(" " * n for n in range(70)), *("a" + " " * n + "bc" for n in (2, 3, 17, 500)), "  " * 300 + "x\n   y", "ab" * 5000, "\u2581 \u2581\u2581x"]
    assert [x.tolist() for x in codec.encode(texts)] == [lib.encode(t) for t in texts]
    long = "a" + " " * 1_000_000 + "b"
    start = time.perf_counter()
    found = codec.encode([long])[0]
    assert time.perf_counter() - start < 60
    assert codec.decode(found) == long and found.tolist() == lib.encode(long)
    assert all(len(w) <= sentencepiece_codec.CACHED_LENGTH for w in codec.cache)


def test_merging_equals_the_plain_rule():
    """The heap gives what scanning for the best pair, the leftmost of equals, gives."""
    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    r = np.random.default_rng(8)
    for _ in range(300):
        parts = list("".join(r.choice(list("\u2581\u2581ethanio"), r.integers(0, 25))))
        want = list(parts)
        while True:
            best = max(((codec.scores[codec.ids[want[k] + want[k + 1]]], -k) for k in range(len(want) - 1) if want[k] + want[k + 1] in codec.ids), default=None)
            if best is None:
                break
            want[-best[1] : 2 - best[1]] = [want[-best[1]] + want[1 - best[1]]]
        assert codec.merge(parts) == want


def test_sentencepiece_fits_from_merges():
    """What the merges of two pieces tell is what merging their characters gives."""
    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    r = random.Random(7)
    ids = sorted(codec.pieces)
    pairs = [tuple(r.choices(ids, k=2)) for _ in range(3000)]
    # parts of pieces, which often join
    for p in map(codec.pieces.get, r.sample(ids, 1500)):
        pairs += [(codec.ids[p[:k]], codec.ids[p[k:]]) for k in range(1, len(p)) if p[:k] in codec.ids and p[k:] in codec.ids]
    told = 0
    for a, b in pairs:
        x, y = codec.pieces[a], codec.pieces[b]
        fit = codec.merge([*x, *y]) == [x, y]
        assert codec.taken_back(a, b) in (fit, None) and codec.pair_fits(a, b) == fit
        told += codec.taken_back(a, b) is not None
    assert told > 0.9 * len(pairs)


def test_pieces_equal_the_library_and_decode(docs, rows, no_docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(docs))
    assert out.columns[:-2] == docs.columns
    for r in out.collect():
        if r.text is None:
            assert r.pieces is None and r.decoded is None
        else:
            assert r.pieces == lib.encode(r.text)
            assert r.decoded == r.text.replace("▁", " ")
    both = sentencepiece_codec.encode(docs, decoded="back").select("text", "pieces", "back")
    assert sorted(map(str, both.collect())) == sorted(str(r).replace("decoded=", "back=") for r in out.select("text", "pieces", "decoded").collect())
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(no_docs)).collect() == []


def test_columns_that_clash_get_other_names(docs):
    out = sentencepiece_codec.encode(docs.select("doc_id", "text", docs.lang.alias("pieces")))
    assert out.columns == ["doc_id", "text", "pieces", "pieces_"]


def test_unigram_forward_pass_is_viterbi():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    codec.unigram = True
    r = np.random.default_rng(3)
    codec.ids = {p: k for k, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "cab"])}
    codec.scores = list(-r.random(8) * 3)
    ends = {}
    for p in codec.ids:
        if len(p) > 1:
            ends.setdefault(p[-2:], set()).add(len(p))
    codec.lengths = {k: (*sorted(v, reverse=True), 1) for k, v in ends.items()}
    words = sorted({"".join(r.choice(list("abc"), r.integers(1, 8))) for _ in range(60)})
    for word, got in zip(words, codec.encode_sorted(words)):
        best = -math.inf
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            parts, start = [], 0
            for k, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[start:k])
                    start = k
            if all(p in codec.ids for p in parts):
                best = max(best, sum(codec.scores[codec.ids[p]] for p in parts))
        names = {v: k for k, v in codec.ids.items()}
        assert "".join(names[i] for i in got) == word
        assert math.isclose(sum(codec.scores[i] for i in got), best)


def _accuracy(out, labels, label):
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = [r for r in out.collect() if r.doc_id in truth]
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    return held, truth


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held, truth = _accuracy(toxicity.score_toxicity(docs, labels), labels, "toxic")
    hits = sum(r.predicted and truth[r.doc_id] for r in held)
    assert hits / sum(truth[r.doc_id] for r in held) > 0.8
    assert hits / sum(r.predicted for r in held) > 0.9


def test_sentences_are_located():
    texts = [f"all is well. {'you utter fool of a thing' if k % 2 else 'a quiet place'}! fine day. some more {'words' if k % 3 else 'lines'}." for k in range(80)]
    y = np.array([k % 2 for k in range(80)], float)
    model = toxicity.fit(texts, y, {0: 40, 1: 40})
    found = toxicity.Scorer(model).sentences("fine day. you utter fool! all is well.")
    assert [z >= 0 for _, _, z in found] == [False, True, False]
    assert "fool" in "fine day. you utter fool! all is well."[found[1][0] : found[1][1]]


def test_toxicity_scores_follow_the_definition(docs, rows, labels):
    """Noisy-or over the sentences, from the definition and the fitted weights."""
    import re

    model = toxicity.fit(*toxicity.training_sample(docs, labels, "toxic", 500, 60_000), 3000)
    assert any(model.weights.values())

    def score(text):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", (text or "").lower()):
            words = set(re.findall(r"[^\W_]+", sentence))
            if words:
                z = model.bias + sum(model.weights.get(w, 0) + sum(model.weights.get(w[:n] + "*", 0) for n in (3, 4, 5, 6, 7) if n < len(w)) for w in words)
                clean *= 1 - 1 / (1 + math.exp(-z))
        return 1 - clean

    got = sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.score_documents(docs, model).collect())
    assert got == sorted((str(r[0]), round(score(r[1]), 9)) for r in rows)


def test_other_label_values_are_not_learnt_from(spark, docs, labels):
    more = labels.unionByName(spark.createDataFrame([(k, 7, -1, "x") for k in range(0, 60, 2)], labels.schema))
    want, got = (toxicity.training_sample(docs, b, "toxic", 500, 60_000) for b in (labels, more))
    assert set(got[2]) <= {0, 1} and want[2] == got[2] and want[0] == got[0]


def test_quality_scores_follow_the_definition(docs, labels):
    """Length-weighted chances of the lines by enumerating all labelings, then the curve."""
    model = quality_crf.fit(*quality_crf.training_sample(docs, labels, "quality", 500, 60_000))
    some = {r.doc_id: r for r in docs.where("doc_id in (0, 1, 2, 5, 300, 500, 501, 503, 504, 505, 509)").collect()}
    got = {r.doc_id: r for r in quality_crf.score_documents(docs, model).collect()}
    for k, row in some.items():
        own, lengths = quality_crf.line_features(row.text)
        n = len(own)
        assert n <= 14 and len(got[k].line_marginals) == n
        x = (own - model.mean) / model.scale
        none = np.zeros(quality_crf.N_OWN)
        z = [float(np.concatenate([x[i], x[i - 1] if i else none, x[i + 1] if i + 1 < n else none]) @ model.weights) for i in range(n)]
        total, good = 0.0, np.zeros(n)
        for lab in itertools.product((0, 1), repeat=n):
            e = math.exp(sum(a * b for a, b in zip(z, lab)) + model.stay * sum(lab[i] == lab[i - 1] for i in range(1, n)))
            total, good = total + e, good + e * np.array(lab)
        quality = float(good / total @ lengths / lengths.sum()) if n else 0.0
        assert math.isclose(got[k].score, 1 / (1 + math.exp(-(model.curve[0] * quality + model.curve[1]))), rel_tol=1e-6)


@pytest.mark.parametrize("score", [lambda d, b: toxicity.score_toxicity(d, b), lambda d, b: quality_crf.score_quality(d, b)])
def test_scores_of_odd_inputs(score, docs, no_docs, rows, labels):
    out = score(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in out)
    same = {r.doc_id: r.score for r in out}
    assert same[400] == same[401] == same[3]
    assert score(no_docs, labels).collect() == []
    assert len(score(docs, labels.limit(0)).collect()) == len(rows)
    assert all(r.score < 1e-9 for r in score(docs.limit(5), labels.limit(0)).collect())


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held, truth = _accuracy(quality_crf.score_quality(docs, labels), labels, "quality")
    right = [r.predicted == truth[r.doc_id] for r in held]
    assert sum(right) / len(right) > 0.9


def test_forward_backward_is_exact():
    r = np.random.default_rng(0)
    z, starts, stay = r.normal(size=10), np.array([0, 4, 4, 5, 10]), 0.7
    good, alike, log_z = quality_crf.marginals(z, starts, stay)
    for d in range(4):
        n, own = starts[d + 1] - starts[d], z[starts[d] : starts[d + 1]]
        if not n:
            continue
        total, up, same = 0.0, np.zeros(n), np.zeros(n)
        for lab in itertools.product((0, 1), repeat=int(n)):
            e = math.exp(sum(own * lab) + stay * sum(lab[i] == lab[i - 1] for i in range(1, n)))
            total += e
            up += e * np.array(lab)
            same[1:] += e * np.array([lab[i] == lab[i - 1] for i in range(1, n)])
        assert np.allclose(up / total, good[starts[d] : starts[d + 1]])
        assert np.allclose(same / total, alike[starts[d] : starts[d + 1]])
        assert math.isclose(math.log(total), log_z[d])


@pytest.mark.parametrize("texts", [["", ""], [None, ""], ["", " \n\t"], ["some words here", ""]])
def test_quality_without_lines_to_learn_from(spark, texts):
    """Both labels occur, but not with lines: the score is the share of label 1."""
    from tidewater.llm.toxicity import held_out

    ids = [r.doc_id for r in spark.range(50).toDF("doc_id").where(~held_out()).limit(4).collect()]
    rows = [(k, texts[n % 2]) for n, k in enumerate(ids)] + [(900, "a line\nanother line"), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, n % 2, n % 2) for n, k in enumerate(ids)], "doc_id long, quality int, toxic int")
    out = quality_crf.score_quality(docs, labels).collect()
    assert len(out) == 6 and all(r.score == 0.5 and r.predicted == 1 for r in out)
    assert toxicity.score_toxicity(docs, labels).count() == 6


def test_labels_without_a_document_take_no_place_in_the_sample(spark):
    from tidewater.llm.toxicity import held_out, training_sample

    ids = [r.doc_id for r in spark.range(400).toDF("doc_id").where(~held_out()).collect()]
    docs = spark.createDataFrame([(k, f"text {k}") for k in ids[-6:]] + [(ids[0], "x" * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, n % 2) for n, k in enumerate(ids)], "doc_id long, quality int")
    texts, y, totals = training_sample(docs, labels, "quality", 3, 50)
    assert len(texts) == 6 and sorted(y) == [0, 0, 0, 1, 1, 1] and sum(totals.values()) == len(ids)
