"""Periodic runs of words, in linear time over an ordered alphabet, without suffix structures or fingerprints.

A run with smallest period q is a maximal repetition of length >= 2q. By the runs theorem its period is the length of
the longest Lyndon word that begins at some position of it, for one of two orders of the alphabet: the given one or its
reverse (the end of the text is smallest in both). So all runs come out of the Lyndon array of each order, if each of its
words [i, j) is known with how far i and j go on alike to the right and to the left.

`lyndon` goes through the text from left to right with the stack of the starts that no later suffix undercuts. Each pair
(start, next position) that it compares is an edge of the array: to the next smaller suffix if the start is popped, from
the previous smaller one if not. What two positions have in common is reused in two ways.
- Let (l, r) be the edge whose extension reached the furthest, to `end`. At a position inside [r, end) the stack above r is
  that of the copy, d = r - l earlier, and edges that end before `end` have the copies' extensions. Only what reaches `end` is
  compared further, from `end` on. (No position inside pops r without reaching `end`, as its copy did not pop l.)
- Down the stack of one position, extensions follow from that between neighbours on the stack: the smaller of the two if they
  differ, and at least as much if they are equal.
So each comparison of two words moves `end` or ends an edge, of which there are less than 2n.

`left_extensions` does the same from right to left for the edges to next smaller suffixes, up to an edge's own length.
Inside the part matched before l (as before r) every edge ends at l or before and has a copy d later that is an edge too.

Before that, words that occur once in a stretch cut it: no run holds them. Words are numbered by first occurrence (any
order of the alphabet serves).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import prepare

#: The least length of a run in words.
SHORTEST = 12


def lyndon(word: list[int]) -> tuple[list[int], list[int]]:
    """The next smaller suffix of each position (its Lyndon word ends there), and how long both go on alike."""
    n = len(word)
    after, after_ext = [n] * n, [0] * n
    before, before_ext = [-1] * n, [0] * n
    # word[r : end] equals word[r - d : end - d]; r is the last position of which an edge reached end
    end, d = 0, 0
    for r in range(1, n):
        top = r - 1
        copy, inside = r - d, end - r
        touched = inside <= 0
        ext = 0
        if touched:
            while r + ext < n and word[top + ext] == word[r + ext]:
                ext += 1
            end, d = r + ext, r - top
        while True:
            if not touched:
                # the edge of the copies
                known = after_ext[top - (r - copy)] if after[top - (r - copy)] == copy else before_ext[copy]
                if known < inside:
                    ext = known
                else:
                    ext = inside
                    while r + ext < n and word[top + ext] == word[r + ext]:
                        ext += 1
                    touched, end, d = True, r + ext, r - top
            at = r + ext
            if at < n and word[top + ext] < word[at]:
                before[r], before_ext[r] = top, ext
                break
            after[top], after_ext[top] = r, ext
            below = before[top]
            if below < 0:
                break
            if touched:
                common = before_ext[top]
                if ext > common:
                    # word[below + common] < word[top + common], which is word[r + common]
                    before[r], before_ext[r] = below, common
                    break
                if ext == common:
                    while r + ext < n and word[below + ext] == word[r + ext]:
                        ext += 1
                    end, d = r + ext, r - below
            top = below
    return after, after_ext


def left_extensions(word: list[int], after: list[int]) -> list[int]:
    """How far both ends of each edge to a next smaller suffix go on alike to the left, up to the edge's length."""
    n = len(word)
    out = [0] * n
    # word[begin : l] equals word[begin + d : l + d] for the last edge (l, l + d) that reached begin
    begin, d = n, 0
    for i in range(n - 1, -1, -1):
        j = after[i]
        most = min(j - i, i)
        ext = 0
        if i > begin:
            known = min(out[i + d], most)
            # ended by a difference inside the part, or by the edge's length
            if i - known > begin or known == most and i - known == begin:
                out[i] = known
                continue
            ext = min(i - begin, most)
        while ext < most and word[i - ext - 1] == word[j - ext - 1]:
            ext += 1
        out[i] = ext
        if i - ext <= begin:
            begin, d = i - ext, j - i
    return out


def runs(word: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `shortest`, by start and period."""
    found = set()
    for own in (word, [-x for x in word]):
        after, ext = lyndon(own)
        left = left_extensions(own, after)
        for i, j in enumerate(after):
            p = j - i
            # a root with a whole root before it is not the run's first
            if left[i] < p and left[i] + ext[i] >= p and left[i] + p + ext[i] >= shortest:
                found.add((i - left[i], left[i] + p + ext[i], p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def stretches(ids: np.ndarray, text: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Maximal stretches of one text (given for each word) in which every word recurs, found by cutting at those that do not."""
    n = len(ids)
    if n == 0:
        return []
    at = np.arange(n)
    part = text.astype(np.int64)
    while True:
        order = np.lexsort((ids[at], part))
        key_part, key_id = part[order], ids[at][order]
        new = np.r_[True, (key_part[1:] != key_part[:-1]) | (key_id[1:] != key_id[:-1])]
        group = np.cumsum(new) - 1
        recurs = np.empty(len(at), bool)
        recurs[order] = np.bincount(group)[group] > 1
        # stretches of what recurs
        at2, part2 = at[recurs], part[recurs]
        if not len(at2):
            return []
        cut = np.r_[True, (at2[1:] != at2[:-1] + 1) | (part2[1:] != part2[:-1])]
        part2 = np.cumsum(cut) - 1
        size = np.bincount(part2)
        keep = size[part2] >= shortest
        same = keep.all() and recurs.all()
        at, part = at2[keep], part2[keep]
        if not len(at):
            return []
        if same:
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            last = np.r_[first[1:], len(at)]
            return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(first, last)]


def planted(n: int, doc_id: int) -> np.ndarray | None:
    """Positions of the words of a text of n that stand in each place, if its id plants a repetition in it."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or n == 0:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def find_runs(docs: DataFrame, plant: bool = False, id_column: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """id, n_words, runs (start, length, period; by start, then period) and the text collapsed, of every document.

    Collapsed: words that a run holds after its first period are dropped; the others are joined by a space. With plant, texts whose id
    says so get a repetition first (see `planted`).

    Cases: a null or empty text has no word, no run and an empty collapsed text; rows without id are kept, with a null
    id, and get nothing planted; repeated rows are walked each; a long text is walked whole, in memory that is linear in it; an empty
    table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            number: dict[bytes, int] = {}
            texts, ids = [], []
            for name, t in zip(names, batch.column(1).to_pylist()):
                # bytes split at ASCII white space only, which is the definition asked for
                words = (t or "").encode().split()
                own = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                if plant and name is not None and (moved := planted(len(words), name)) is not None:
                    words, own = [words[k] for k in moved.tolist()], own[moved]
                texts.append(words)
                ids.append(own)
            lengths = np.array([len(w) for w in texts], np.int64)
            starts = np.r_[0, np.cumsum(lengths)]
            joined = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            found: list[list[tuple[int, int, int]]] = [[] for _ in names]
            for a, b in stretches(joined, np.repeat(np.arange(len(names)), lengths), shortest):
                k = int(np.searchsorted(starts, a, "right")) - 1
                found[k] += [(a - int(starts[k]) + s, n, p) for s, n, p in runs(joined[a:b].tolist(), shortest)]
            collapsed = []
            for words, own in zip(texts, found):
                if own:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s, n, p in own:
                        gone[s + p] += 1
                        gone[s + n] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(words).decode())
            rows = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found], pa.list_(shape))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), rows, pa.array(collapsed, pa.string())], names=[id_column, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(walk, f"`{id_column}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row a document of `find_runs`: the number of runs, the longest one, and digests of all of them and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    top = found.withColumn("_top", longest)
    length, period = -F.col("_top.n"), F.col("_top.p")
    return top.select(
        id_column,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_top.s").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
        "n_words",
    )
