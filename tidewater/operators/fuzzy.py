"""The most alike vocabulary word of each word, over vocabularies of any size.

Likeness is the matching-blocks ratio 2m / (a + b) of two words of a and b characters. m is at most the length of the longest common
subsequence, and that at most the number of characters that both have (each as often as both have it). A character with its number
among equal ones (the second e of a word is not its first) makes the latter an inner product of 0/1 vectors. So words are dealt
out to tasks, each of which meets the vocabulary in parts of bounded size: a matrix product for each first letter finds the pairs that may
be alike enough, bits in machine words give their common subsequences, and blocks are matched, best bound first, where no better
pair is known yet. Bounds only leave out what cannot win; no pair that could is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.scratch import new_path

#: Words for a task.
TASK = 1 << 15
#: Vocabulary words in a part, words that meet it at a time, entries that share a table of characters, cells of a product, and pairs that are walked together.
PART, WORDS, TABLE, CELLS, PAIRS = 1 << 16, 1 << 16, 1 << 11, 1 << 22, 1 << 15
#: Bytes of texts that are cut into words at a time.
BYTES = 1 << 24
#: Characters that fit a machine word; longer words are compared one by one.
BITS = 64


def ratio_of(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row a word, -1 after its end; and lengths."""
    n = np.array([len(w) for w in words], np.int64)
    out = np.full((len(words), int(n.max(initial=1))), -1, np.int32)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    return out, n


def _numbered(codes: np.ndarray) -> np.ndarray:
    """Of each character a bucket of its code and its number among those of the bucket, as one number; -1 for none."""
    s = np.sort(np.where(codes >= 0, codes % BITS, -1), axis=1)
    at = np.arange(s.shape[1])
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    return np.where(s >= 0, s * BITS + at - np.maximum.accumulate(np.where(new, at, 0), axis=1), -1)


def _vectors(numbered: np.ndarray, dims: np.ndarray, more: list[np.ndarray]) -> np.ndarray:
    """A 0/1 vector of each row, and further columns."""
    out = np.zeros((len(numbered), int(dims.max(initial=0)) + 1 + len(more)), np.float32)
    d = dims[numbered]
    r, c = np.nonzero(d >= 0)
    out[r, d[r, c]] = 1
    for k, x in enumerate(more):
        out[:, out.shape[1] - len(more) + k] = x
    return out


def _subsequences(a: np.ndarray, table: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of words (characters of the table, a row a word) and the table's rows."""
    v = np.full(len(row), ~np.uint64(0))
    for c in a.T:
        u = v & table[row, c]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def _blocks(a: np.ndarray, na: np.ndarray, table: np.ndarray, row: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of pairs, as difflib finds them: the longest block, first in a, then in b, and so on at both sides."""
    one = np.uint64(1)
    below = np.array([(1 << k) - 1 for k in range(BITS + 1)], np.uint64)
    same = np.ascontiguousarray(table[row[:, None], a].T)
    out, at = np.zeros(len(row), np.int64), np.arange(a.shape[1])[:, None]
    p, alo, ahi, blo, bhi = np.arange(len(row)), np.zeros_like(na), na, np.zeros_like(nb), nb
    while len(p):
        e = np.where((at >= alo) & (at < ahi), same[:, p] & (below[bhi] & ~below[blo]), np.uint64(0))
        # bit j of row i: a block of so many characters ends at i and j
        r, live, size = e, np.arange(len(p)), 0
        i, j, k = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        while True:
            hit = r != 0
            some = hit.any(axis=0)
            if not some.any():
                break
            if not some.all():
                r, e, hit, live = r[:, some], e[:, some], hit[:, some], live[some]
            size += 1
            end = hit.argmax(axis=0)
            bits = r[end, np.arange(len(live))]
            i[live], k[live], j[live] = end + 1 - size, size, np.bitwise_count((bits & -bits) - one).astype(np.int64) + 1 - size
            nxt = np.zeros_like(r)
            nxt[1:] = (r[:-1] << one) & e[1:]
            r = nxt
        np.add.at(out, p, k)
        left, right = (k > 0) & (alo < i) & (blo < j), (k > 0) & (i + k < ahi) & (j + k < bhi)
        p, alo, ahi, blo, bhi = (np.concatenate(x) for x in ((p[left], p[right]), (alo[left], (i + k)[right]), (i[left], ahi[right]), (blo[left], (j + k)[right]), (j[left], bhi[right])))
    return out


def _candidates(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose product is not negative, some words at a time."""
    step = max(1, CELLS // max(1, len(y)))
    for k in range(0, len(x), step):
        w, e = np.nonzero(x[k : k + step] @ y.T > -1e-3)
        yield w + k, e


def nearest(words: list[str], entries: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words that have a partner, of their partners among the entries (which are sorted) and the ratios."""
    best, partner = np.zeros(len(words)), np.full(len(words), len(entries), np.int64)

    def offer(w: np.ndarray, e: np.ndarray, r: np.ndarray) -> None:
        order = np.lexsort((e, -r, w))
        w, e, r = w[order], e[order], r[order]
        first = np.ones(len(w), bool)
        first[1:] = w[1:] != w[:-1]
        w, e, r = w[first], e[first], r[first]
        better = (r >= least) & ((r > best[w]) | ((r == best[w]) & (e < partner[w])))
        best[w[better]], partner[w[better]] = r[better], e[better]

    lengths = np.array([len(w) for w in words], np.int64)
    short = np.flatnonzero((lengths > 0) & (lengths <= BITS))
    short = short[np.argsort(lengths[short], kind="stable")]
    brief = np.array([k for k, e in enumerate(entries) if 0 < len(e) <= BITS], np.int64)
    if len(short) and len(brief):
        a, na = _codes([words[k] for k in short])
        b, nb = _codes([entries[k] for k in brief])
        sa, sb = _numbered(a), _numbered(b)
        second = lambda x: x[:, 1] if x.shape[1] > 1 else np.full(len(x), -1, np.int32)
        a2, b2 = second(a), second(b)
        by_first, by_second = np.argsort(a[:, 0], kind="stable"), np.argsort(a2, kind="stable")
        firsts, seconds = a[by_first, 0], a2[by_second]
        span = lambda x, c: slice(np.searchsorted(x, c, "left"), np.searchsorted(x, c, "right"))
        # characters of the entries as numbers; the last stands for any other and for none
        chars = np.unique(b)[1 if (b < 0).any() else 0 :]
        ta, tb = (np.where(chars[(at := np.minimum(np.searchsorted(chars, x), len(chars) - 1))] == x, at, len(chars)) for x in (a, b))
        for letter in np.unique(b[:, 0]):
            own, swapped = by_first[span(firsts, letter)], by_second[span(seconds, letter)]
            swapped = swapped[a[swapped, 0] != letter]
            all_rows = np.flatnonzero(b[:, 0] == letter)
            for rows in np.split(all_rows, range(TABLE, len(all_rows), TABLE)):
                dims = np.full(BITS * BITS + 1, -1, np.int64)
                seen = np.unique(sb[rows])
                seen = seen[seen >= 0]
                dims[seen] = np.arange(len(seen))
                y = _vectors(sb[rows], dims, [-least / 2 * nb[rows], np.full(len(rows), -least / 2)])
                table = np.zeros((len(rows), len(chars) + 1), np.uint64)
                for k in range(b.shape[1]):
                    have = np.flatnonzero(nb[rows] > k)
                    table[have, tb[rows[have], k]] |= np.uint64(1 << k)
                order = np.argsort(b2[rows], kind="stable")
                found = [(own[w], e) for w, e in _candidates(_vectors(sa[own], dims, [np.ones(len(own)), na[own]]), y)]
                # words that swap their first two letters with entries
                lo, hi = (np.searchsorted(b2[rows][order], a[swapped, 0], side) for side in ("left", "right"))
                n = hi - lo
                found.append((np.repeat(swapped, n), order[np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())]))
                w, e = (np.concatenate(x) for x in zip(*found))
                if not len(w):
                    continue
                bound = np.empty(len(w))
                for k in range(0, len(w), PAIRS):
                    p = slice(k, k + PAIRS)
                    bound[p] = 2.0 * _subsequences(ta[w[p], : na[w[p]].max()], table, e[p]) / (na[w[p]] + nb[rows[e[p]]])
                alike = bound >= least
                w, e, bound = w[alike], e[alike], bound[alike]
                while len(w):
                    # of each word the pair of the highest bound that is left
                    open_ = (bound > best[short[w]]) | ((bound == best[short[w]]) & (brief[rows[e]] < partner[short[w]]))
                    w, e, bound = w[open_], e[open_], bound[open_]
                    by = np.lexsort((e, -bound, w))
                    w, e, bound = w[by], e[by], bound[by]
                    first = np.ones(len(w), bool)
                    first[1:] = w[1:] != w[:-1]
                    for k in range(0, first.sum(), PAIRS):
                        fw, fe = w[first][k : k + PAIRS], e[first][k : k + PAIRS]
                        m = _blocks(ta[fw, : na[fw].max()], na[fw], table, fe, nb[rows[fe]])
                        offer(short[fw], brief[rows[fe]], 2.0 * m / (na[fw] + nb[rows[fe]]))
                    w, e, bound = w[~first], e[~first], bound[~first]
    # pairs with a long word
    sizes = np.array([len(e) for e in entries], np.int64)
    for k in np.flatnonzero(lengths > 0) if sizes.max(initial=0) > BITS else np.flatnonzero(lengths > BITS):
        w, n = words[k], lengths[k]
        fits = (2.0 * np.minimum(n, sizes) / (n + sizes) >= least) & (sizes > 0)
        for at in np.flatnonzero(fits if n > BITS else fits & (sizes > BITS)):
            v = entries[at]
            if v[0] == w[0] or (w[0] in v[:2] and v[0] in w[:2]):
                offer(np.array([k]), np.array([at]), np.array([ratio_of(w, v)]))
    with_one = np.flatnonzero(partner < len(entries))
    return with_one, partner[with_one], best[with_one]


def nearest_words(words: DataFrame, word: str, vocabulary: DataFrame, entry: str, least: float = 0.66, tasks: int | None = None) -> DataFrame:
    """word, nearest and ratio of each distinct word that is alike enough to a vocabulary word under the rule on first letters.

    The rule: first letters agree, or each is among the other's first two. Ties go to the first in the alphabet. Null and empty
    words have no partner.
    """
    # a stated number of tasks, as rows are narrow and what is done with them is not
    tasks = tasks or int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = lambda df, c: df.select(F.col(c).alias("_w")).where(F.col(c).isNotNull() & (F.col(c) != "")).distinct()
    known = some(vocabulary, entry)
    parts = max(1, -(-known.count() // PART))
    part = lambda n: F.pmod(F.xxhash64("_w"), F.lit(n)).cast("int")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    a = some(words, word).select("_w", part(tasks).alias("_task"), every(parts, "_part"))
    b = known.groupBy(part(parts).alias("_part")).agg(F.collect_list("_w").alias("_v")).select("_v", "_part", every(tasks, "_task"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        v, out = sorted(x for r in right.column("_v").to_pylist() for x in r), []
        for batch in left.select(["_w"]).to_batches(WORDS):
            w = batch.column(0).to_pylist()
            k, p, r = nearest(w, v, least)
            out.append(pa.table({"_a": pa.array([w[x] for x in k], pa.string()), "_b": pa.array([v[x] for x in p], pa.string()), "_r": pa.array(r, pa.float64())}))
        return pa.concat_tables(out) if out else pa.table({"_a": pa.array([], pa.string()), "_b": pa.array([], pa.string()), "_r": pa.array([], pa.float64())})

    keys = ["_task", "_part"]
    near = a.repartition(tasks, *keys).groupBy(*keys).cogroup(b.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(meet, "_a string, _b string, _r double")
    best = near.groupBy("_a").agg(F.min(F.struct((-F.col("_r")).alias("r"), F.col("_b").alias("b"))).alias("_x"))
    return best.select(F.col("_a").alias("word"), F.col("_x.b").alias("nearest"), (-F.col("_x.r")).alias("ratio"))


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, pa.ListArray, pa.DictionaryArray]]:
    """Some rows at a time, the words of their texts (one space apart), and all these words with their dictionary."""
    for batch in batches:
        step = max(1, batch.num_rows * BYTES // max(1, batch.column(text).nbytes))
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            words = pc.split_pattern(part.column(text), " ")
            yield part, words, words.flatten().dictionary_encode()


def word_counts(texts: DataFrame, text: str, skip_below: int) -> DataFrame:
    """w and n: the words of texts (one space apart) of so many characters, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, words in _slices(batches, 0):
            n = np.bincount(words.indices, minlength=len(words.dictionary))
            got = pa.RecordBatch.from_arrays([words.dictionary, pa.array(n, pa.int64())], ["w", "n"])
            yield got.filter(pc.greater_equal(pc.utf8_length(got.column(0)), skip_below))

    return texts.select(text).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, fixes: DataFrame, most: int) -> dict[str, str | None]:
    """Of the most frequent words, at most so many, what each gives way to, or None."""
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).alias("b")).count().collect())
    least, room = 64, most
    while least > 0 and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    return dict(counts.where(F.floor(F.log2("n")) >= least).join(fixes, "w", "left").select("w", "nearest").collect())


def corrected(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, entry: str, least: float = 0.66, skip_below: int = 4, frequent: int = 1 << 18) -> DataFrame:
    """key, fixed and changed: texts (of words one space apart) whose unknown words give way to the most alike vocabulary word.

    Words of the vocabulary, short words and numbers stay. key is unique. What becomes of the most frequent words, of which `frequent`
    bounds the number, is broadcast; the others are joined with their fixes and come back to their texts.
    """
    spark = texts.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = new_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    known = vocabulary.select(F.col(entry).alias("w")).distinct()
    counts = stored(word_counts(texts, text, skip_below), "words")
    open_ = counts.where(~F.col("w").rlike(r"^\d+[.,?]*$")).join(known, "w", "left_anti")
    tasks = max(spark.sparkContext.defaultParallelism, -(-counts.count() // TASK))
    fixes = stored(nearest_words(open_, "w", known, "w", least, tasks).select(F.col("word").alias("w"), "nearest"), "fixes")
    common = _frequent(counts, fixes, frequent)
    fate = spark.sparkContext.broadcast((pa.array(common.keys(), pa.string()), pa.array(common.values(), pa.string())))
    kind = texts.schema[key].dataType.simpleString()

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lists, words in _slices(batches, 1):
            d = words.dictionary
            open_words = pc.and_(pc.greater_equal(pc.utf8_length(d), skip_below), pc.invert(pc.is_in(d, fate.value[0])))
            left = np.asarray(open_words)[words.indices]
            pairs = np.unique(np.asarray(pc.list_parent_indices(lists), np.int64)[left] * len(d) + np.asarray(words.indices, np.int64)[left])
            rows, which = np.divmod(pairs, max(1, len(d)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), d.take(pa.array(which))], ["k", "w"])

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lists, words in _slices(batches, 1):
            d = words.dictionary
            # a word gives way to the same word in all texts
            own = part.column(2).flatten().dictionary_encode()
            other = part.column(3).flatten().take(pa.array(np.unique(own.indices, return_index=True)[1]))
            fresh = pc.coalesce(fate.value[1].take(pc.index_in(d, fate.value[0])), other.take(pc.index_in(d, own.dictionary)))
            before = np.concatenate([[0], np.cumsum(np.asarray(fresh.is_valid())[words.indices])])
            ends = np.asarray(lists.offsets)
            fixed = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, pc.coalesce(fresh, d).take(words.indices)), " ")
            yield pa.RecordBatch.from_arrays([part.column(0), pc.if_else(lists.is_valid(), fixed, pa.scalar(None, pa.string())), pa.array(before[ends[1:]] > before[ends[:-1]])], [key, "fixed", "changed"])

    each = texts.select(key, text).mapInArrow(rare, f"k {kind}, w string")
    own = each.join(fixes, "w").groupBy(F.col("k").alias(key)).agg(F.collect_list(F.struct("w", "nearest")).alias("_m"))
    rows = texts.select(key, text).join(own, key, "left")
    return rows.select(key, text, "_m.w", "_m.nearest").mapInArrow(replaced, f"`{key}` {kind}, fixed string, changed boolean")
