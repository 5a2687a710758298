"""Line dedup by pairwise alignment.

Lines are normalised (lower case, white space runs to one space) and hashed. A document's rare line keys are the
hashes of its minimal runs of consecutive lines that reach `min_words` words: any common block long enough to be
deleted starts with such a run, in both documents. For each key the later documents are paired with the
earliest that holds it, so pairs grow with the occurrences and not with their square, and yet every
repeated block meets its first holder. Pairs are aligned by patience diff on the line hashes (lines unique
in both sides anchor the longest increasing chain; gaps are aligned in turn, by occurrence number
where no line is unique), and aligned blocks of at least min_words words are deleted from the later document. Its
other lines are then matched with all of the first document, in whatever order, until no block of min_words words is
left in common. Earlier means the smaller id.

A run of 50 words is what makes a key rare: single lines recur everywhere, such runs only where a passage was copied.

Only hashes travel to the pairs. Pairs are dealt by their first document, in groups of about GROUP later ones, and the
first's lines go to each group once, not to each pair; a task holds one pair at a time. Texts meet the deletions once,
in an equi-join by id.

Cases: null and empty texts, and lines without a word, are never touched; rows without id are returned as they
are; of rows that share an id the text with the smallest hash takes part (null texts and those without a word do not
count), the others are returned as they are;
a document all of whose lines are deleted has an empty text; an empty table gives an empty result; the input's
own columns may have any names.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bound, carried, carried_text, discard, frugal, prepare, restored, stage, without

MIN_WORDS = 50
#: Later documents that share one copy of their first document's lines.
GROUP = 256
_FAR = 1 << 30


def hashed_lines(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Positions, hashes and word counts of the lines that have a word."""
    import xxhash

    at, hashes, counts = [], [], []
    for i, line in enumerate((text or "").split("\n")):
        tokens = line.encode().lower().split()
        if tokens:
            at.append(i)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(tokens)) - (1 << 63))
            counts.append(len(tokens))
    return at, hashes, counts


def run_keys(hashes: list[int], counts: list[int], min_words: int) -> set[int]:
    """Hashes of the minimal runs of lines that reach min_words words."""
    import xxhash

    keys, end, total = set(), 0, 0
    raw = np.array(hashes, np.int64)
    for start in range(len(hashes)):
        while end < len(hashes) and total < min_words:
            total += counts[end]
            end += 1
        if total < min_words:
            break
        keys.add(xxhash.xxh64_intdigest(raw[start:end].tobytes()) - (1 << 63))
        total -= counts[start]
    return keys


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs (sorted by the first) that rises in the second: patience sorting."""
    tops, piles, back = [], [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tops, j)
        if k == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[k], piles[k] = j, n
        back[n] = piles[k - 1] if k else -1
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal lines, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {x for x, n in in_a.items() if n == 1 and in_b.get(x) == 1}
        if once:
            place = {a[i]: i for i in range(a0, a1) if a[i] in once}
            # walk b, so that chains rise in b and then in a
            found = [(i, j) for j, i in _chain([(j, place[b[j]]) for j in range(b0, b1) if b[j] in once])]
        else:
            nth: Counter = Counter()
            place = {}
            for i in range(a0, a1):
                if a[i] in in_b:
                    place[a[i], nth[a[i]]] = i
                    nth[a[i]] += 1
            nth, pairs = Counter(), []
            for j in range(b0, b1):
                if (b[j], nth[b[j]]) in place:
                    pairs.append((j, place[b[j], nth[b[j]]]))
                nth[b[j]] += 1
            out += [(i, j) for j, i in _chain(pairs)]
            continue
        last = (a0, b0)
        for i, j in [*found, (a1, b1)]:
            todo.append((last[0], i, last[1], j))
            if i < a1:
                out.append((i, j))
            last = (i + 1, j + 1)
    return sorted(out)


def common_blocks(a: list[int], b: list[int], counts: list[int], min_words: int) -> list[int]:
    """Positions in b of the aligned blocks (consecutive in both) that have min_words words."""
    out, block, words, last = [], [], 0, (-2, -2)
    for i, j in [*patience(a, b), (_FAR, _FAR)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if words >= min_words:
                out += block
            block, words = [], 0
        if i < _FAR:
            block.append(j)
            words += counts[j]
        last = (i, j)
    return out


class Runs:
    """All runs of consecutive lines of one document, as a suffix automaton."""

    def __init__(self, a: list[int]):
        length, link, step, last = [0], [-1], [{}], 0
        for x in a:
            new, p = len(length), last
            length.append(length[last] + 1)
            link.append(0)
            step.append({})
            while p >= 0 and x not in step[p]:
                step[p][x] = new
                p = link[p]
            if p >= 0:
                q = step[p][x]
                if length[q] != length[p] + 1:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    step.append(dict(step[q]))
                    while p >= 0 and step[p].get(x) == q:
                        step[p][x] = copy
                        p = link[p]
                    link[q] = q = copy
                link[new] = q
            last = new
        self.length, self.link, self.step = length, link, step

    def within(self, b: list[int], counts: list[int], min_words: int) -> list[int]:
        """Positions in b of all runs that the document has too, wherever, and that have min_words words."""
        length, link, step = self.length, self.link, self.step
        total, starts, state, size = [0], [], 0, 0
        for j, x in enumerate(b):
            total.append(total[-1] + counts[j])
            while state and x not in step[state]:
                state = link[state]
                size = length[state]
            state, size = (step[state][x], size + 1) if x in step[state] else (0, 0)
            start = j + 1 - size
            starts.append(start if total[-1] - total[start] >= min_words else _FAR)
        out, reach = [], _FAR
        for j in range(len(b) - 1, -1, -1):
            reach = min(reach, starts[j])
            if j >= reach:
                out.append(j)
        return out[::-1]


def left_blocks(a: list[int], b: list[int], counts: list[int], min_words: int) -> list[int]:
    return Runs(a).within(b, counts, min_words)


class First:
    """The document that later ones are compared with; its runs are laid out once, when first asked for."""

    def __init__(self, lines: list[int]):
        self.lines, self.have, self._runs = lines, set(lines), None

    def runs(self) -> Runs:
        if self._runs is None:
            self._runs = Runs(self.lines)
        return self._runs

    def repeated_blocks(self, b: list[int], counts: list[int], min_words: int) -> list[int]:
        """Positions in b of the aligned blocks, then of all blocks that are left: what crosses the alignment or comes again."""
        gone = set(common_blocks(self.lines, b, counts, min_words))
        while True:
            rest = [j for j in range(len(b)) if j not in gone]
            if sum(counts[j] for j in rest if b[j] in self.have) < min_words:
                return sorted(gone)
            found = self.runs().within([b[j] for j in rest], [counts[j] for j in rest], min_words)
            if not found:
                return sorted(gone)
            gone.update(rest[j] for j in found)


def repeated_blocks(a: list[int], b: list[int], counts: list[int], min_words: int) -> list[int]:
    return First(a).repeated_blocks(b, counts, min_words)


def document_lines(docs: DataFrame, min_words: int, id_column: str, text: str) -> DataFrame:
    """_id, _t (hash of the text), _h, _c (line hashes and word counts, packed), _keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, keys = [], [], []
            for t in batch.column(1).to_pylist():
                _, hashes, counts = hashed_lines(t)
                h.append(np.array(hashes, np.int64).tobytes())
                c.append(np.array(counts, np.int32).tobytes())
                keys.append(sorted(run_keys(hashes, counts, min_words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(h, pa.binary()), pa.array(c, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_t", "_h", "_c", "_keys"])

    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_t"))
    return rows.mapInArrow(frugal("line_dedup", run), "_id long, _t long, _h binary, _c binary, _keys array<long>")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _t and _gone, staged: the numbers (among the lines with a word) of the lines to delete."""
    some = docs.where(F.col(id_column).isNotNull() & F.col(text).isNotNull())
    # texts without a word do not stand for an id
    staged = stage(document_lines(some, min_words, id_column, text).where(F.octet_length("_h") > 0), "lines")
    lines = staged.join(staged.groupBy("_id").agg(F.min("_t").alias("_t")), ["_id", "_t"])
    keys = lines.select("_id", F.explode("_keys").alias("key"))
    holders = keys.groupBy("key").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first < last").select("key", "first")
    pairs = stage(keys.join(holders, "key").where("first != _id").select("first", F.col("_id").alias("later")).distinct(), "line-pairs")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = First([])
        for batch in batches:
            ids, hashes, found = [], [], []
            for later, own, t, h, c in zip(*[batch.column(k) for k in range(2, 7)]):
                lines = np.frombuffer(h.as_buffer(), np.int64).tolist()
                if not later.as_py():
                    first = First(lines)
                    continue
                ids.append(own.as_py())
                hashes.append(t.as_py())
                found.append(first.repeated_blocks(lines, np.frombuffer(c.as_buffer(), np.int32).tolist(), min_words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["_id", "_t", "_gone"])

    groups = pairs.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    columns = ["first", "salt", "is_later", "_id", "_t", "_h", "_c"]
    later = pairs.join(groups, "first").select("first", F.pmod(F.xxhash64("later"), "groups").alias("salt"), F.lit(True).alias("is_later"), F.col("later").alias("_id")).join(lines, "_id").select(columns)
    firsts = groups.select("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"), F.lit(False).alias("is_later"), F.col("first").alias("_id")).join(lines, "_id").select(columns)
    rows = later.unionByName(firsts).repartition("first", "salt").sortWithinPartitions("first", "salt", "is_later")
    aligned = rows.mapInArrow(frugal("line_dedup", align), "_id long, _t long, _gone array<int>")
    out = stage(aligned.select("_id", "_t", F.explode("_gone").alias("g")).groupBy("_id", "_t").agg(F.collect_set("g").alias("_gone")), "deletions")
    discard(staged, pairs)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: `doc` (the row as a struct), clean_text and deleted (numbers of its lines among those with a word)."""
    prepare(docs.sparkSession)
    gone = deletions(docs, min_words, id_column, text)
    body = carried_text(docs, text)
    rows = docs.select(*carried(docs), F.col(id_column).cast("long").alias("_id"), F.when(F.col(text).isNotNull(), F.xxhash64(text)).alias("_t"))
    # merged, not broadcast: how many rows have deletions grows with the data
    rows = rows.join(gone.withColumnsRenamed({"_id": "_i", "_t": "_u"}).hint("merge"), (F.col("_id") == F.col("_i")) & (F.col("_t") == F.col("_u")), "left")
    worded = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    at = bound(bound(F.split(body, "\n"), worded), lambda w: F.transform("_gone", lambda g: F.get(w, g)))
    clean = F.when(F.col("_gone").isNull(), body).otherwise(without(body, at))
    return rows.select(restored(docs), clean.alias("clean_text"), F.coalesce(F.array_sort("_gone"), F.array().cast("array<int>")).alias("deleted"))
