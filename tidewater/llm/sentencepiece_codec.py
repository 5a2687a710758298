"""SentencePiece encoding and decoding with a shared-prefix forward pass.

Texts are marked (a mark stands for a space, one more goes before the text) and cut into marked words where no
piece of the model can cross. The distinct words of a batch that the worker has not met are sorted, which lays them
out as the leaves of a trie in depth-first order; the forward table of a word is kept up to the prefix it
shares with the next, so each edge of the trie is scored once.

The forward table depends on the model's kind:
- unigram models: the classic Viterbi best score and best last piece of every prefix;
- BPE models (the one supplied): a path of greatest score is not what merging gives, so the table holds the last
  piece of each prefix's encoding. A sequence of pieces is the encoding of its string exactly when every
  adjacent pair is (each pair encodes to itself), and cutting the last piece off an encoding leaves the encoding
  of the rest; hence the last piece of a prefix is the one that fits the last piece of the prefix before it.
  Whether two pieces fit is found by taking the two back along their merges, the later merge first: they fit unless what
  meets at the border would have merged before. It is remembered.
Words with several leading marks, whose pieces tie in score, are merged directly, in n log n.

Characters outside the model become byte pieces where the model has them, else the unknown piece. Decoding joins the
pieces' bytes, turns marks into spaces and drops the space put in front.

Cases: null texts give null pieces and a null text back; empty texts give none and an empty text; the mark
character itself in a text reads back as a space; repeated rows are encoded alike; an empty table
gives an empty result; the input's other columns travel along untouched.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import TEXT_ROWS_PER_BATCH, fresh, frugal, kept_by_worker, prepare

MARK = "▁"
#: Entries of the worker's caches, some 50 MB at most each; they bound its memory, not the results.
WORD_CACHE, PAIR_CACHE, TAIL_CACHE = 150_000, 200_000, 100_000
#: Longer words are encoded anew in each batch, so that the cache's entries are small.
CACHED_LENGTH = 128
#: Text whose new words are sorted into one trie.
TRIE_BYTES = 4 << 20
#: Candidates for a prefix's last piece are remembered by its last characters, so many.
TAIL = 3
_UNKNOWN = -1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encodes and decodes in one worker."""

    def __init__(self, path: str, cache_entries: int = WORD_CACHE):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal, trainer = model.normalizer_spec, model.trainer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("models that normalise their input are not supported")
        self.dummy, self.unigram = normal.add_dummy_prefix, trainer.model_type == trainer.UNIGRAM
        self.ids, self.scores, self.bytes, self.raw = {}, [], {}, []
        self.unknown = 0
        for k, p in enumerate(model.pieces):
            self.scores.append(p.score)
            if p.type == p.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = k
                self.raw.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (p.NORMAL, p.USER_DEFINED):
                self.ids[p.piece] = k
                self.raw.append(p.piece.replace(MARK, " ").encode())
            else:
                self.unknown = k if p.type == p.UNKNOWN else self.unknown
                self.raw.append(" ⁇ ".encode() if p.type == p.UNKNOWN else b"")
        self.pieces = {k: p for p, k in self.ids.items()}
        # lengths of the pieces that end in two given characters, the longest first
        ends: dict[str, set[int]] = {}
        # of those with more than TAIL characters, by their last TAIL
        longer: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
            if len(p) > TAIL:
                longer.setdefault(p[-TAIL:], set()).add(len(p))
        self.lengths = {k: (*sorted(v, reverse=True), 1) for k, v in ends.items()}
        self.longer = {k: sorted(v, reverse=True) for k, v in longer.items()}
        # candidates by the last TAIL characters
        self.tails: dict[str, list[tuple[int, int | None]]] = {}
        # pieces of several characters whose score no other has: only their merges have an order of their own
        often = Counter(self.scores[i] for p, i in self.ids.items() if len(p) > 1)
        self.ranked = {i for p, i in self.ids.items() if len(p) > 1 and often[self.scores[i]] == 1}
        # the two parts that a piece is merged from last
        self.parts: dict[int, tuple[int, int] | None] = {}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            self.cut = re.compile(r"(?s).+").findall  # pieces cross words: the text is one word
        else:
            alone = "" if any("\n" in p and len(p) > 1 for p in self.ids) else "\n"
            self.cut = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else "")).findall
        self.cache: dict[str, bytes] = {}
        # whether a piece encodes to itself, and whether two do (by left * pieces + right)
        self.whole: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.cache_entries = cache_entries

    def merge(self, chars: list[str], without: int | None = None) -> list[str]:
        """Plain BPE: the adjacent pair whose union scores best merges first, the leftmost of equals. The piece `without` is not made.

        Pairs wait in a heap as (score, where the left part begins, length of the union); a pair whose parts have
        changed since has another length there and is passed over. Costs n log n, also for runs of one character.
        """
        ids, scores, n = self.ids, self.scores, len(chars)
        parts: list[str | None] = list(chars)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            i = ids.get(chars[k] + chars[k + 1])
            if i is not None and i != without:
                heap.append((-scores[i], k, len(chars[k]) + len(chars[k + 1])))
        heapq.heapify(heap)
        while heap:
            _, k, size = heapq.heappop(heap)
            j = after[k]
            if parts[k] is None or j >= n or len(parts[k]) + len(parts[j]) != size:
                continue
            parts[k], parts[j], after[k] = parts[k] + parts[j], None, after[j]
            if after[k] < n:
                ahead[after[k]] = k
            for left in (ahead[k], k):
                right = after[left] if left >= 0 else n
                if right < n:
                    i = ids.get(parts[left] + parts[right])
                    if i is not None and i != without:
                        heapq.heappush(heap, (-scores[i], left, len(parts[left]) + len(parts[right])))
        return [p for p in parts if p is not None]

    def stands_alone(self, piece: int) -> bool:
        fit = self.whole.get(piece)
        if fit is None:
            p = self.pieces[piece]
            fit = self.whole[piece] = self.merge([*p]) == [p]
        return fit

    def split(self, piece: int) -> tuple[int, int] | None:
        """The parts that are merged last into a piece that stands alone; None where merging alone can tell what becomes of it.

        Merging its characters without making the piece itself leaves them.
        """
        if piece not in self.parts:
            p, found = self.pieces[piece], None
            if piece in self.ranked and self.stands_alone(piece):
                limit = self.scores[piece]
                steps = self.merge([*p], without=piece)
                if len(steps) == 2:
                    a, b = (self.ids.get(x) for x in steps)
                    # parts are merged before the whole
                    if a is not None and b is not None and all(len(self.pieces[x]) == 1 or self.scores[x] > limit for x in (a, b)):
                        found = a, b
            self.parts[piece] = found
        return self.parts[piece]

    def taken_back(self, left: int, right: int) -> bool | None:
        """Whether two pieces that stand alone fit, from the merges that made them; None where equal scores leave it open."""
        ids, scores, pieces, ranked = self.ids, self.scores, self.pieces, self.ranked
        # what is merged at the border must come before all that has been taken back; a tie goes to the left
        limit, later = -np.inf, False
        while True:
            both = ids.get(pieces[left] + pieces[right])
            if both is not None:
                if both not in ranked:
                    return None
                if scores[both] > limit or (later and scores[both] == limit):
                    return False
            a, b = len(pieces[left]) > 1, len(pieces[right]) > 1
            if not a and not b:
                return True
            # the right part's merge comes after an equal one to its left
            if b and (not a or scores[right] <= scores[left]):
                limit, later, parts, one = scores[right], True, self.split(right), False
            else:
                limit, later, parts, one = scores[left], False, self.split(left), True
            if parts is None:
                return None
            if one:
                left = parts[1]
            else:
                right = parts[0]

    def pair_fits(self, left: int, right: int) -> bool:
        if len(self.fits) > PAIR_CACHE:
            self.fits.clear()
        fit = self.taken_back(left, right) if self.stands_alone(left) and self.stands_alone(right) else False
        if fit is None:
            a, b = self.pieces[left], self.pieces[right]
            fit = self.merge([*a, *b]) == [a, b]
        self.fits[left * len(self.scores) + right] = fit
        return fit

    def candidates(self, tail: str) -> list[tuple[int, int | None]]:
        """Lengths of the pieces that may end in a prefix's last TAIL characters (all, if fewer), the longest first, with their ids where these characters tell them."""
        if len(self.tails) > TAIL_CACHE:
            self.tails.clear()
        found: list[tuple[int, int | None]] = [(n, None) for n in self.longer.get(tail, ())] if len(tail) == TAIL else []
        found += [(len(tail) - k, self.ids[tail[k:]]) for k in range(len(tail)) if tail[k:] in self.ids]
        self.tails[tail] = found
        return found

    def spell(self, char: str) -> list[int]:
        """An unknown character: its bytes, or the unknown piece."""
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Pieces of sorted distinct words; the forward table is shared along common prefixes."""
        before = ""
        # of each prefix: its last piece, where that begins, and (unigram) the score of its best path
        last, begins, score = [_UNKNOWN], [0], [0.0]
        extend = self._best if self.unigram else self._fitting
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], begins[shared + 1 :], score[shared + 1 :]
            extend(word, shared + 1, last, begins, score)
            before = word
            out, end = [], len(word)
            while end:
                if last[end] == _UNKNOWN:
                    out += reversed(self.spell(word[end - 1]))
                    end -= 1
                else:
                    out.append(last[end])
                    end = begins[end]
            out.reverse()
            yield out

    def _best(self, word: str, first: int, last: list[int], begins: list[int], score: list[float]) -> None:
        """The forward table of a unigram model from prefix `first` on: the end of the best path."""
        ids, lengths, one = self.ids, self.lengths, (1,)
        floor = min(self.scores, default=0.0) - 10.0
        for end in range(first, len(word) + 1):
            piece, start = _UNKNOWN, end - 1
            best = score[end - 1] + floor
            for length in lengths.get(word[end - 2 : end], one) if end > 1 else one:
                s = end - length
                i = ids.get(word[s:end]) if s >= 0 else None
                if i is not None and score[s] + self.scores[i] > best:
                    best, piece, start = score[s] + self.scores[i], i, s
            score.append(best)
            last.append(piece)
            begins.append(start)

    def _fitting(self, word: str, first: int, last: list[int], begins: list[int], score: list[float]) -> None:
        """The forward table of a BPE model from prefix `first` on: the piece that fits the last one of what is before it."""
        get_id, get_fit, get_tail, n = self.ids.get, self.fits.get, self.tails.get, len(self.scores)
        for end in range(first, len(word) + 1):
            tail = word[end - TAIL : end] if end > TAIL else word[:end]
            found = get_tail(tail)
            if found is None:
                found = self.candidates(tail)
            for length, i in found:
                s = end - length
                if i is None:
                    if s < 0:
                        continue
                    i = get_id(word[s:end])
                    if i is None:
                        continue
                if s == 0 or last[s] == _UNKNOWN:
                    fit = self.stands_alone(i)
                else:
                    fit = get_fit(last[s] * n + i)
                    if fit is None:
                        fit = self.pair_fits(last[s], i)
                if fit:
                    last.append(i)
                    begins.append(s)
                    break
            else:
                last.append(_UNKNOWN)
                begins.append(end - 1)

    def encode_merged(self, word: str) -> list[int]:
        out = []
        for p in self.merge([*word]):
            i = self.ids.get(p)
            out += [i] if i is not None else self.spell(p)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece ids of each text."""
        cut = []
        for t in texts:
            cut.append(self.cut((MARK if self.dummy else "") + t.replace(" ", MARK)) if t else [])
        needed = set().union(*cut)
        new = sorted(w for w in needed if w not in self.cache)
        if len(self.cache) + len(new) > self.cache_entries:
            # what this batch uses stays
            self.cache = {w: self.cache[w] for w in needed if w in self.cache}
        cache = self.cache
        plain = [w for w in new if self.unigram or not w.startswith(MARK * 2)]
        for w, ids in zip(plain, self.encode_sorted(plain)):
            cache[w] = array("i", ids).tobytes()
        for w in new:
            if w not in cache:
                cache[w] = np.array(self.encode_merged(w), np.int32).tobytes()
        out = [np.frombuffer(b"".join([cache[w] for w in words]), np.int32) for words in cut]
        for w in new:
            if len(w) > CACHED_LENGTH:
                del cache[w]
        return out

    def rest(self) -> None:
        """Give the words back between tasks: a worker that waits holds little."""
        self.cache = {}

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode(errors="replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def worker_codec(path: str) -> Codec:
    """The worker's codec; its tables and known pairs serve the tasks of this operator that the worker runs."""
    return kept_by_worker("sentencepiece", path, lambda: Codec(path))


def _gathered(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up to TRIE_BYTES of text, so that more words share prefixes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(at).nbytes
        if size >= TRIE_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encode(docs: DataFrame, model: str | None = None, text: str = "text", output: str = "pieces", decoded: str | None = None) -> DataFrame:
    """docs with a column of piece ids; with `decoded`, also one of what they decode to, made by the same worker."""
    prepare(docs.sparkSession)
    path, name = model or default_model(), fresh(docs, output)
    back = decoded and fresh(docs, decoded)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path)
        for batch in _gathered(batches, at):
            texts = batch.column(at)
            found = codec.encode(texts.to_pylist())
            offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
            null = texts.is_null().to_numpy(zero_copy_only=False)
            pieces = pa.ListArray.from_arrays(pa.array(offsets, mask=np.r_[null, False]) if texts.null_count else pa.array(offsets), values)
            more = [pa.array([None if n else codec.decode(x) for x, n in zip(found, null)], pa.string())] if back else []
            out = pa.RecordBatch.from_arrays([*batch.columns, pieces, *more], names=[*batch.schema.names, name, *([back] if back else [])])
            for start in range(0, out.num_rows, TEXT_ROWS_PER_BATCH):
                yield out.slice(start, TEXT_ROWS_PER_BATCH)
            del batch, texts, found, values, pieces, more, out
        codec.rest()

    return docs.mapInArrow(frugal("sentencepiece", run), ", ".join([*fields, f"`{name}` array<int>", *([f"`{back}` string"] if back else [])]))


def decode(docs: DataFrame, model: str | None = None, pieces: str = "pieces", output: str = "decoded") -> DataFrame:
    """docs with a column of the text that the piece ids stand for."""
    prepare(docs.sparkSession)
    path, name = model or default_model(), fresh(docs, output)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    at = docs.columns.index(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path)
        for batch in batches:
            column = batch.column(at)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            texts = [codec.decode(values[offsets[k] : offsets[k + 1]]) if valid[k] else None for k in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(frugal("sentencepiece", run), ", ".join([*fields, f"`{name}` string"]))
