"""Alignment of two tokenizers by byte ranges, with corpus-wide counts of linked ids.

Both tokenizers cut the same bytes. A static index of the second one's tokens, their sorted starts and ends, is stabbed by
bisection with every token of the first one: that gives the first and the last token that its bytes overlap, and so all
links. A gap between tokens that no token of the other side spans is a group boundary.

Counts go in two passes. The first encodes each text once and stores what a document has (sizes, digest, its distinct pairs of
ids with their numbers), beside the tasks' own sums of pairs, which Spark then adds up. The second looks up every pair of
a document in the corpus's counts. These are dealt by a hash of the pair into parts of about PART_PAIRS, each
broadcast by itself; every document meets every part, and its partial sums are added. So no pair of ids, however
frequent, gathers in one task, and what is broadcast at a time is bounded whatever the corpus.

Cases: null and empty texts, and texts whose bytes one of the tokenizers does not give back, have no tokens: zeros and an
empty column of groups. Special strings inside texts are plain text. Repeated rows count each; rows without id
are kept; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import discard, prepare, stage

#: Pairs of ids that are broadcast at once (16 bytes each), and that a task holds before it hands them on.
PART_PAIRS, TASK_PAIRS = 1 << 21, 1 << 20
#: Pairs in one stored row.
ROW_PAIRS = 1 << 16
#: A pair is the first id times this plus the second id.
SECOND_IDS = 1 << 24
#: Runs of white space of this length are long.
LONG_SPACE = 10_000
#: Words that a worker remembers, and the longest of them.
WORDS, WORD_LENGTH = 200_000, 64
MARK = "\N{LOWER ONE EIGHTH BLOCK}"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself if it is one, else one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Ids of texts by a byte-level tokenizer.

    Where its merges are in the order of their ids, the plain rule of merging the least id first gives the same ids, and a
    faster library that knows only this rule is asked. Texts with long runs of white space, which that library
    cannot cut, are cut here and go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        from tidewater.llm.token_counts import PRE_TOKEN

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cut, self.long_space = regex.compile(PRE_TOKEN), regex.compile(r"\s{%d}" % LONG_SPACE)
        table, vocabulary = byte_of_character(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            self.bytes[k] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        ranks = {self.bytes[k]: k for k in model["vocab"].values()}
        self.fast = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}) if merged == sorted(merged) else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(t) if self.fast and not self.long_space.search(t) else self.encode_cut(t) for t in texts]

    def encode_cut(self, text: str) -> list[int]:
        ids: list[int] = []
        found = self.cut.finditer(text)
        while some := [m.group() for m in itertools.islice(found, 4096)]:
            for e in self.tokenizer.encode_batch(some, add_special_tokens=False):
                ids += e.ids
        return ids


class Pieces:
    """Ids of texts by a SentencePiece model.

    Where texts are not normalised and no piece crosses from one word into the next, the pieces of a text whose words stand one space apart
    are those of its words, which are remembered; other texts go to the library whole.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model, self.known = sentencepiece.SentencePieceProcessor(model_file=path), {}
        self.bytes = []
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace(MARK, " ").encode())
        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normal, trainer = spec.normalizer_spec, spec.trainer_spec
        plain = not normal.precompiled_charsmap and not normal.remove_extra_whitespaces and normal.escape_whitespaces and normal.add_dummy_prefix and not trainer.treat_whitespace_as_suffix
        self.by_word = plain and not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        known = self.known
        if len(known) > WORDS:
            known.clear()
        cut = [t.split(" ") if self.by_word and t and MARK not in t else None for t in texts]
        # an empty word is a second space, or one at an end
        cut = [None if own is None or "" in own else own for own in cut]
        misses = list({w for own in cut if own for w in own if w not in known})
        for w, ids in zip(misses, self.model.encode(misses, num_threads=1)):
            known[w] = ids
        out = []
        for t, own in zip(texts, cut):
            if own is None:
                out.append(self.model.encode(t))
            else:
                ids: list[int] = []
                for w in own:
                    ids += known[w]
                out.append(ids)
        for w in misses:
            if len(w) > WORD_LENGTH:
                del known[w]
        return out


class Overlaps:
    """Links and groups of two cuts of one string of bytes, given the lengths of their tokens (all over 0)."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        ends_a, ends_b = np.cumsum(first), np.cumsum(second)
        starts_a, starts_b = ends_a - first, ends_b - second
        # the tokens of b that each token of a stabs
        self.low = np.searchsorted(ends_b, starts_a, "right")
        self.high = np.searchsorted(starts_b, ends_a, "left")
        # gap k lies before token k of b; a token of a spans the gaps between its first and last partner
        spans = np.zeros(len(second) + 1, np.int64)
        np.add.at(spans, self.low + 1, 1)
        np.add.at(spans, self.high, -1)
        open_gap = np.cumsum(spans[:-1]) == 0
        self.group_b = np.cumsum(open_gap) - 1
        self.group_a = self.group_b[self.low]
        self.groups = int(self.group_b[-1]) + 1

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a and in b of every link."""
        n = self.high - self.low
        a = np.repeat(np.arange(len(n)), n)
        return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + self.low[a]


def listed(a: np.ndarray, b: np.ndarray, found: Overlaps, names: list[bytes], size: int) -> bytes:
    """`a1,a2|b1;a3|b2,b3`. names: of ids of a with a comma and with a bar, then of ids of b with a comma and with a semicolon."""
    last_a, last_b = (np.r_[g[1:] != g[:-1], True] for g in (found.group_a, found.group_b))
    n_a, n_b = (np.bincount(g, minlength=found.groups) for g in (found.group_a, found.group_b))
    code = np.empty(len(a) + len(b), np.int64)
    before_b, before_a = np.cumsum(n_b) - n_b, np.cumsum(n_a)
    code[np.arange(len(a)) + before_b[found.group_a]] = 2 * a + last_a
    code[np.arange(len(b)) + before_a[found.group_b]] = 2 * size + 2 * b + last_b
    return b"".join([names[k] for k in code.tolist()])[:-1]


class Sums:
    """Numbers of pairs, in memory that is bounded: beyond TASK_PAIRS distinct ones they are handed on."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > 2 * TASK_PAIRS:
            keys, counts = self._merged()
            self.parts, self.held = [(keys, counts)], len(keys)
            if self.held > TASK_PAIRS:
                yield from self.rest()

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([c for _, c in self.parts])).astype(np.int64)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            keys, counts = self._merged()
            self.parts, self.held = [], 0
            for k in range(0, len(keys), ROW_PAIRS):
                yield keys[k : k + ROW_PAIRS], counts[k : k + ROW_PAIRS]


_models: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def models(paths: tuple[str, str]) -> tuple[ByteLevel, Pieces]:
    if paths not in _models:
        _models.clear()
        _models[paths] = ByteLevel(paths[0]), Pieces(paths[1])
    return _models[paths]


_SIDES = "n_a long, n_b long, n_groups long, n_links long, groups string, _pairs binary, _numbers binary"


def aligned(docs: DataFrame, paths: tuple[str, str], id_column: str, text: str, whole: bool = False) -> DataFrame:
    """Rows of documents (_pairs: their distinct pairs, as differences; _numbers: how many links each has), and rows of sums (_sum).

    groups is the text that lists them if `whole`, else its digest.
    """
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = models(paths)
        sizes = [np.array([len(x) for x in m.bytes], np.int64) for m in (first, second)]
        names = [b"%d%c" % (k, c) for m, ends in ((first, b",|"), (second, b",;")) for k in range(len(m.bytes)) for c in ends]
        sums, names_type = Sums(), None

        def packed(ids, sides, groups, pairs, sizes_of, is_sum) -> pa.RecordBatch:
            n = len(ids)
            columns = [pa.array(ids, names_type)]
            columns += [pa.array([x[k] for x in sides], pa.int64()) for k in range(4)]
            columns += [pa.array(groups, pa.string()), pa.array(pairs, pa.binary()), pa.array(sizes_of, pa.binary()), pa.array([is_sum] * n, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["_id", "n_a", "n_b", "n_groups", "n_links", "groups", "_pairs", "_numbers", "_sum"])

        def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
            return np.diff(keys, prepend=0).tobytes(), counts.astype(np.int64).tobytes()

        for batch in batches:
            names_type = batch.column(0).type
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sides, groups, pairs, numbers = [], [], [], []
            for t, a, b in zip(texts, first.encode([" " + t for t in texts]), second.encode(texts)):
                own = (" " + t).encode()
                same = t and all(b"".join([m.bytes[k] for k in ids]) == own for m, ids in ((first, a), (second, b)))
                if not same:
                    sides.append((0, 0, 0, 0))
                    groups.append("")
                    pairs.append(b"")
                    numbers.append(b"")
                    continue
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                found = Overlaps(sizes[0][a], sizes[1][b])
                x, y = found.links()
                keys, counts = np.unique(a[x] * SECOND_IDS + b[y], return_counts=True)
                text_of = listed(a, b, found, names, len(first.bytes))
                sides.append((len(a), len(b), found.groups, len(x)))
                groups.append(text_of.decode() if whole else hashlib.sha256(text_of).hexdigest())
                pairs.append(np.diff(keys, prepend=0).tobytes())
                numbers.append(counts.astype(np.int64).tobytes())
                for row in sums.add(keys, counts):
                    yield packed([None], [(0, 0, 0, 0)], [""], *[[x] for x in pack(*row)], True)
            yield packed(batch.column(0), sides, groups, pairs, numbers, False)
        for row in sums.rest():
            yield packed([None], [(0, 0, 0, 0)], [""], *[[x] for x in pack(*row)], True)

    return docs.select(F.col(id_column).alias("_id"), F.col(text)).mapInArrow(run, f"_id {kind.simpleString()}, {_SIDES}, _sum boolean")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, second (the id of the second tokenizer), n (its links in the corpus) and best (no pair of that second id has more)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                pair = np.cumsum(np.frombuffer(keys.as_buffer(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.frombuffer(counts.as_buffer(), np.int64))], names=["pair", "n"])

    each = rows.where("_sum").select("_pairs", "_numbers").mapInArrow(unpack, "pair long, n long")
    total = stage(each.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("second", F.col("pair") % SECOND_IDS), "pair-counts")
    top = total.groupBy("second").agg(F.max("n").alias("_top"))
    out = stage(total.join(top, "second").select("pair", "second", "n", (F.col("n") == F.col("_top")).alias("best")), "pair-counts")
    discard(total)
    return out


def with_counts(spark: SparkSession, rows: DataFrame, counts: DataFrame, part_pairs: int) -> DataFrame:
    """n_best and count_sum beside the staged rows of documents."""
    parts = max(1, -(-counts.count() // part_pairs))
    columns = ["_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    numbered = rows.where("NOT _sum").select(F.monotonically_increasing_id().alias("_row"), "*")
    total = None
    for k in range(parts):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == k).select("pair", "n", "best").toArrow()
        keys = part.column("pair").to_numpy()
        order = np.argsort(keys)
        table = spark.sparkContext.broadcast((keys[order], part.column("n").to_numpy()[order], part.column("best").to_numpy(zero_copy_only=False)[order]))

        def look_up(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            keys, counts, best = table.value
            for batch in batches:
                n_best, total = [], []
                for pairs, numbers in zip(batch.column(7), batch.column(8)):
                    pair, n = np.cumsum(np.frombuffer(pairs.as_buffer(), np.int64)), np.frombuffer(numbers.as_buffer(), np.int64)
                    if not len(pair) or not len(keys):
                        n_best.append(0)
                        total.append(0)
                        continue
                    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                    here = keys[at] == pair
                    n_best.append(int(n[here & best[at]].sum()))
                    total.append(int((n * counts[at])[here].sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], names=["_row", *columns, "n_best", "count_sum"])

        fields = ", ".join(f"{c} {numbered.schema[c].dataType.simpleString()}" for c in ["_row", *columns])
        one = numbered.mapInArrow(look_up, f"{fields}, n_best long, count_sum long")
        total = one if total is None else total.unionByName(one)
    if parts > 1:
        sums = total.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        return numbered.select("_row", *columns).join(sums, "_row").drop("_row")
    return total.drop("_row")


def align_tokens(docs: DataFrame, paths: tuple[str, str] | None = None, id_column: str = "doc_id", text: str = "text", whole: bool = False, part_pairs: int = PART_PAIRS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other pair of its second id exceeds), count_sum (over
    links, of their pairs' counts) and groups_sha256 of every document; with `whole` groups, the text that lists them, instead.

    paths: of a byte-level tokenizer's .json and of a SentencePiece .model.
    """
    spark = prepare(docs.sparkSession)
    rows = stage(aligned(docs, paths or default_paths(), id_column, text, whole), "alignments")
    counts = pair_counts(rows)
    out = with_counts(spark, rows, counts, part_pairs)
    discard(counts)
    return out.select(F.col("_id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups" if whole else "groups_sha256"))

