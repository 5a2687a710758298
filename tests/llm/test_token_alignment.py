"""Token alignment against a plain version: all pairs of byte ranges, and the libraries on whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import token_alignment
from tidewater.llm.queries import QUERIES


def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b, decoders.ByteLevel()


def overlaps(first, second):
    """Pairs of positions whose ranges overlap, and the groups as lists of positions."""
    spans = lambda n: [(sum(n[:k]), sum(n[: k + 1])) for k in range(len(n))]
    a, b = spans(first), spans(second)
    links = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] < y[1] and y[0] < x[1]]
    ends = sorted({e for _, e in a} & {e for _, e in b})
    groups, at = [], 0
    for e in ends:
        groups.append(([i for i, x in enumerate(a) if at <= x[0] < e], [j for j, y in enumerate(b) if at <= y[0] < e]))
        at = e
    return links, groups


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=25), st.randoms(use_true_random=False))
def test_overlaps_equal_all_pairs(first, r):
    total, second = sum(first), []
    while sum(second) < total:
        second.append(min(r.randint(1, 6), total - sum(second)))
    found = token_alignment.Overlaps(np.array(first), np.array(second))
    links, groups = overlaps(first, second)
    assert sorted(zip(*map(np.ndarray.tolist, found.links()))) == links and found.groups == len(groups)
    names = [b"%d%c" % (k, c) for ends in (b",|", b",;") for k in range(30) for c in ends]
    text = token_alignment.listed(np.arange(len(first)), np.arange(len(second)), found, names, 30)
    assert text.decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def plain(texts):
    """The contract's columns for (id, text) rows."""
    a, b, decoder = libraries()
    bytes_a = {k: v for v, k in a.get_vocab(with_added_tokens=True).items()}
    table = token_alignment.byte_of_character()
    assert sorted(table.values()) == list(range(256)) and all(decoder.decode([c]) == chr(v) for c, v in table.items() if v < 128)
    rows, counts = [], Counter()
    for name, t in texts:
        x, y = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        size_a = [len(bytes_a[k]) for k in x]
        pieces = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        own = (" " + (t or "")).encode()
        joined = bytes(table[c] for k in x for c in bytes_a[k])
        if not t or joined != own or b"".join(pieces) != own:
            rows.append((name, [], [], [], []))
            continue
        links, groups = overlaps(size_a, list(map(len, pieces)))
        counts.update((x[i], y[j]) for i, j in links)
        rows.append((name, x, y, links, groups))
    best = {}
    for (_, k), n in counts.items():
        best[k] = max(best.get(k, 0), n)
    out = []
    for name, x, y, links, groups in rows:
        listed = ";".join(",".join(str(x[i]) for i in i_s) + "|" + ",".join(str(y[j]) for j in j_s) for i_s, j_s in groups)
        n_best = sum(counts[x[i], y[j]] == best[y[j]] for i, j in links)
        out.append((name, len(x), len(y), len(groups), len(links), n_best, sum(counts[x[i], y[j]] for i, j in links), hashlib.sha256(listed.encode()).hexdigest() if x else ""))
    return out


@pytest.mark.parametrize("part_pairs", [token_alignment.PART_PAIRS, 700])
def test_equals_the_plain_version(spark, docs, rows, no_docs, part_pairs):
    small = [(r[0], r[1]) for r in rows if len(r[1] or "") < 3000]
    odd = [(600, "café ▁ mark"), (601, "a<|endoftext|>b <s> </s> <0x41>"), (602, " lead and trail "), (603, "\x00\x01 nul"), (604, "\U0001f600\U0001f600 ЖЖ"), (605, "\n\n  \t x")]
    df = spark.createDataFrame(small + odd, "doc_id long, text string").repartition(3)
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(map(tuple, token_alignment.align_tokens(df, part_pairs=part_pairs).collect()), key=order)
    assert got == sorted(plain(small + odd), key=order)
    assert token_alignment.align_tokens(no_docs).collect() == []


def test_query_has_a_row_for_each_document(spark):
    out = QUERIES["op11_token_alignment"](spark, "/root/testdata/sf0.001")
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in documents.collect())


def test_long_texts_and_runs_of_space(spark):
    texts = [(1, " " * 200_000 + "x"), (2, "x" * 100_000), (3, "word " * 60_000)]
    out = token_alignment.align_tokens(spark.createDataFrame(texts, "doc_id long, text string"), whole=True)
    a, b, _ = libraries()
    for r in out.collect():
        t = dict(texts)[r.doc_id]
        assert r.n_a in (0, len(a.encode(" " + t, add_special_tokens=False).ids)) and r.n_b in (0, len(b.encode(t)))
        assert (r.groups.count(";") + 1 if r.groups else 0) == r.n_groups


def test_first_side_equals_the_library():
    texts = ["it's <|endoftext|>  a  b\n\n c", "über 12345 ...!? 中文", "", " ", "x" * 3000, "\t\t" * 40]
    own = token_alignment.ByteLevel(token_alignment.default_paths()[0])
    want = [libraries()[0].encode(t, add_special_tokens=False).ids for t in texts]
    assert own.encode(texts) == want == [own.encode_cut(t) for t in texts]


def test_second_side_equals_the_library():
    texts = ["a b  c", " lead", "trail ", "ü ▁ x", "one\ntwo three\n\nfour", "", "the the\tthe", "x" * 500 + " y", "Ж 中文 \x00 é"]
    own = token_alignment.Pieces(token_alignment.default_paths()[1])
    assert own.by_word and own.encode(texts) == [libraries()[1].encode(t) for t in texts] == own.encode(texts)
