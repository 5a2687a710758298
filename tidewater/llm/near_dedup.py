"""MinHash near-duplicate detection with SuperMinHash signatures.

A document's set holds the hashes of its distinct word shingles. SuperMinHash gives each element one random
permutation of the slots instead of independent hashes: at step j an element offers the value j + u to the slot
its permutation names, a slot keeps the least value, and steps end once every slot holds a value below j. Slots
then are correlated in a way that lowers the variance of the estimate, and each slot still agrees for two
sets with a chance equal to their Jaccard similarity.

Bands of slots give bucket keys. Equal sets are one class first, so copies meet only once. A bucket never emits its
pairs: each member is paired with the bucket's smallest id; pairs that pass a wide margin on the signatures make clusters, by label
propagation with pointer jumping. Texts then move, packed, to where they are compared; sets are made there, of a text's words,
and never stored or shuffled:
- the members of a cluster come together once, and all their pairs are tested exactly inside the task, first with the smallest
  id, then, where several components are left, by the product of the matrix of members and elements with itself. Only links that
  join two components leave the task. Clusters of over BLOCK_ROWS members or BLOCK_ELEMENTS elements come in blocks, each with
  the cluster's smallest id.
- then the buckets are gone through that still hold several components and members that have not met. Members that agree
  with such a one up to the margin stay, by signature only; a forest of such agreements, as long as its members, tells which
  form a cluster, and these are tested the same way.
So what is emitted, candidates and links, grows with the members and not with their pairs, and no pair is left out.

A cluster of this second kind that is over these sizes is tested bucket by bucket instead. Buckets beyond them are dealt out in
blocks by a hash of id and bucket, and each block meets itself and each other block once; this is the only step that costs
a bucket's square over the block.

Missed links: at similarity s a pair shares no bucket with chance (1 - s^ROWS)^BANDS, 1e-7 at 0.8, and a linked pair
falls short of the signature margin with about the same.

Cases: null and empty texts, and texts without words, have an empty set and link with nothing; fewer words than a
shingle make one element of the whole sequence; rows without id are returned unlinked, with a null
component; of rows that share an id the text with the smallest hash stands for that id, never a null text or one without
words where there is another, and all of them get its component (n_shingles is each row's own); an empty table gives an
empty result; the input's own columns are not touched.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, frugal, prepare, stage

BANDS, ROWS = 30, 4
SLOTS = BANDS * ROWS
#: Signatures must agree in this share less than the threshold (over five standard deviations).
MARGIN = 0.2
#: The most members of a block, and about the most elements of their sets.
BLOCK_ROWS, BLOCK_ELEMENTS = 1024, 1 << 21
#: Bits a wanted document has in the filter that texts pass before they move, and the most bytes of that filter.
FILTER_BITS, FILTER_BYTES = 16, 64 << 20
#: Elements of which the matrix of a block is made at a time.
COLUMNS = 4096
#: What makes a task of comparisons: a bucket, a block of it, and the distance to the block that it is compared with.
TASK = ["key", "block", "gap"]
ELEMENTS_AT_ONCE = 8192
#: Words that a worker remembers, and the longest of them in bytes.
WORD_CACHE, CACHED_LENGTH = 250_000, 128

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles, sorted and distinct."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.cache, self.digest = width, {}, xxhash.xxh64_intdigest

    def __call__(self, text: str | None) -> np.ndarray:
        return self.of_bytes((text or "").encode())

    def of_bytes(self, text: bytes) -> np.ndarray:
        # on bytes, lower() and split() know ASCII only, which is the definition asked for
        tokens = text.lower().split()
        if not tokens:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > WORD_CACHE:
            cache.clear()
        try:
            hashes = [cache[t] for t in tokens]
        except KeyError:
            hashes = []
            for t in tokens:
                h = cache.get(t)
                if h is None:
                    h = self.digest(t)
                    if len(t) <= CACHED_LENGTH:
                        cache[t] = h
                hashes.append(h)
        h = np.array(hashes, dtype=np.uint64)
        width = min(self.width, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = mix(out ^ h[k : k + n])
        return np.unique(out)


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of a set of hashes: per slot, step << 32 | 32 random bits."""
    signature = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(elements), ELEMENTS_AT_ONCE):
        state = elements[start : start + ELEMENTS_AT_ONCE]
        row = np.arange(len(state))
        order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(state), 1))
        for j in range(slots):
            if int(signature.max()) >> 32 < j:
                break
            state = mix(state)
            swap = j + ((state >> np.uint64(32)) % np.uint64(slots - j)).astype(np.intp)
            slot = order[row, swap]
            order[row, swap] = order[:, j]
            value = np.uint64(j << 32) | (state & np.uint64(0xFFFFFFFF))
            np.minimum.at(signature, slot.astype(np.intp), value)
    return signature


def signatures(docs: DataFrame, width: int, id_column: str, text: str) -> DataFrame:
    """_id, _n (size of the set), _d (digest of the set), _t (hash of the text), _sig (16 bits a slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle = Shingler(width)
        for batch in batches:
            n, digest, sig = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle(t)
                n.append(len(s))
                digest.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                sig.append(mix(superminhash(s)).astype(np.uint16).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), batch.column(2), pa.array(sig, pa.binary())], names=["_id", "_n", "_d", "_t", "_sig"])

    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_t"))
    return rows.mapInArrow(frugal("near_dedup", run), "_id long, _n long, _d binary, _t long, _sig binary")


def banded(reps: DataFrame) -> DataFrame:
    """id, _n and key for each band of a representative: the hash of the band's number and slots."""
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("_band")
    slots = F.substring("_sig", F.col("_band") * 2 * ROWS + 1, F.lit(2 * ROWS))
    return reps.select(F.col("_id").alias("id"), "_n", "_sig", band).select("id", "_n", F.xxhash64("_band", slots).alias("key"))


def _alike(pairs: DataFrame, sigs: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose signatures come near it."""
    need = int((threshold / 100 - MARGIN) * SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= need))

    a = sigs.select(F.col("_id").alias("a"), F.col("_n").alias("na"), F.col("_sig").alias("sa"))
    b = sigs.select(F.col("_id").alias("b"), F.col("_n").alias("nb"), F.col("_sig").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold))
    return both.select("a", "b", "sa", "sb").mapInArrow(frugal("near_dedup", run), "a long, b long")


def within(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows whose _id is among the staged ids, or looks so: what a bitmap of the ids' hashes lets through.

    The bitmap is broadcast while FILTER_BITS for each id stay within FILTER_BYTES; beyond that all rows pass.
    """
    n, chunk = wanted.count(), 8 * 4096
    chunks = max(1, -(-n * FILTER_BITS // chunk))
    if chunks * 4096 > FILTER_BYTES:
        return rows
    slot = F.pmod(F.xxhash64("_id"), F.lit(chunks * chunk))
    split = lambda df: df.withColumns({"_k": F.floor(slot / chunk), "_at": slot % chunk})
    bits = split(wanted.select("_id")).groupBy("_k").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    # chunks rows of 4 KB
    passed = split(rows).join(F.broadcast(bits), "_k")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return passed.where(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1).select(*rows.columns)


class Texts:
    """Texts of representatives, brought packed to the tasks that compare them."""

    def __init__(self, docs: DataFrame, reps: DataFrame, width: int, id_column: str, text: str):
        self.rows = docs.where(F.col(text).isNotNull()).select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_t"))
        self.reps, self.width = reps, width

    def at(self, tasks: DataFrame) -> DataFrame:
        """TASK, id and comp of the staged tasks' members, then _size and _packed: the bytes of the member's text and its packed form."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = pa.Codec("zstd", compression_level=1)
            for batch in batches:
                texts = [t.encode() for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, texts)), pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())], names=["_id", "_t", "_size", "_packed"])

        # no semi-join, which the optimizer would move below the filter; merged, so that texts move alike at every size
        wanted = stage(self.reps.join(tasks.select(F.col("id").alias("_id")).distinct(), "_id", "left_semi").select("_id", "_t"), "wanted")
        packed = within(self.rows, wanted).select("_id", "_t", "_text").mapInArrow(frugal("near_dedup", pack), "_id long, _t long, _size long, _packed binary")
        where = tasks.join(wanted, F.col("id") == F.col("_id")).select(*TASK, "id", "comp", "_t").hint("merge")
        return packed.join(where, (F.col("_id") == F.col("id")) & (packed["_t"] == where["_t"])).select(*TASK, "id", "comp", "_size", "_packed")

    def links(self, tasks: DataFrame, threshold: int) -> DataFrame:
        """Links (a, b), staged, that join components of the members of each of the staged tasks (TASK, id, comp)."""
        width = self.width

        def link(own: pa.RecordBatch, shingle: Shingler) -> pa.RecordBatch | None:
            ids, comp = own.column(3).to_numpy(), own.column(4).to_numpy()
            # rows come by id; one that is there twice counts once
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            ids, comp = ids[first], comp[first]
            codec = pa.Codec("zstd")
            sizes, packed = own.column(5), own.column(6)
            sets = [shingle.of_bytes(codec.decompress(packed[k].as_buffer(), sizes[k].as_py(), asbytes=True)) for k in first.tolist()]
            found = block_links(comp, sets, threshold)
            if not found:
                return None
            x, y = (ids[[p[k] for p in found]] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        def work() -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
            shingle = Shingler(width)
            return lambda own: link(own, shingle)

        return stage(_walk(self.at(tasks), work, "a long, b long").distinct(), "links")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and comp (its component's smallest node) of every node of the edges (a, b): label propagation with pointer jumping.

    The result is staged; its column _old is of no use.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("_m"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("_old"), F.least("comp", "_m").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("_next"))
        new = stage(step.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("_next", "comp")).alias("comp"), "_old"), "labels")
        ended = new.where(F.col("comp") != F.col("_old")).isEmpty()
        discard(labels)
        labels = new
        if ended:
            discard(both)
            return labels


def alike_members(comp: np.ndarray, n: np.ndarray, sig: np.ndarray, side: np.ndarray | None, met: np.ndarray, threshold: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which members agree up to the margin with one of another component (and block, if two blocks are compared) that they have
    not met (met: rows of two numbers, alike for members that have), and a forest of the pairs of components that such members
    join; the largest components come first in it."""
    need = max(1, math.floor((threshold / 100 - MARGIN) * SLOTS))
    _, which, sizes = np.unique(comp, return_inverse=True, return_counts=True)
    order = np.argsort(-sizes[which], kind="stable")
    comp, n, sig, met, side = comp[order], n[order], sig[order], met[order], None if side is None else side[order]
    slots, m = np.ascontiguousarray(sig.T), len(n)
    found, label, forest = np.zeros(m, bool), comp.copy(), []
    for start in range(0, m, 128):
        some = slice(start, min(start + 128, m))
        same = np.zeros((some.stop - start, m), np.uint8)
        for slot in slots:
            same += (slot[some][:, None] == slot[None, :]).view(np.uint8)
        fits = (same >= need) & (comp[some][:, None] != comp[None, :]) & (np.minimum(n[some][:, None], n[None, :]) * 100 >= np.maximum(n[some][:, None], n[None, :]) * threshold)
        fits &= (met[some][:, None] != met[None, :]).any(2)
        if side is not None:
            fits &= side[some][:, None] != side[None, :]
        some_fit = fits.any(1)
        found[order[some]] |= some_fit
        for k in np.flatnonzero(some_fit):
            i = start + int(k)
            others = np.flatnonzero(fits[k] & (label != label[i]))
            while len(others):
                forest.append((int(comp[i]), int(comp[others[0]])))
                label[label == label[others[0]]] = label[i]
                others = others[label[others] != label[i]]
    return found, forest


def block_links(comp: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Pairs of members whose sets reach the threshold, as many as join the components that such pairs join."""
    m, n = len(sets), np.array([len(x) for x in sets])
    label, out = comp.copy(), []

    def join(i: int, others: np.ndarray) -> None:
        others = others[label[others] != label[i]]
        while len(others):
            out.append((i, int(others[0])))
            label[label == label[others[0]]] = label[i]
            others = others[label[others] != label[i]]

    # the first member with all others
    common = np.array([len(np.intersect1d(sets[0], x, assume_unique=True)) if c != label[0] else 0 for x, c in zip(sets, label)])
    join(0, np.flatnonzero((100 * common >= threshold * (n[0] + n - common)) & (common > 0)))
    if (label == label[0]).all():
        return out
    elements, row = np.concatenate(sets), np.repeat(np.arange(m, dtype=np.int32), n)
    order = np.argsort(elements, kind="stable")
    elements, row = elements[order], row[order]
    del order
    first = np.r_[True, elements[1:] != elements[:-1]]
    # what one member alone has is in no intersection
    keep = ~(first & np.r_[first[1:], True])
    row, column = row[keep], np.cumsum(first[keep], dtype=np.int32) - 1
    del elements, first, keep
    common = np.zeros((m, m), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        part = np.zeros((m, COLUMNS), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        # exact: a product of two rows is COLUMNS at most
        common += (part @ part.T).astype(np.int64)
    for i in range(m):
        join(i, np.flatnonzero(100 * common[i] >= threshold * (n[i] + n - common[i])))
    return out


def _walk(rows: DataFrame, work, out: str) -> DataFrame:
    """work()(columns of one task) for each task of the rows, which begin with TASK; a Spark task walks its tasks one after another."""
    width = len(TASK)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = work()
        held: pa.RecordBatch | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = batch if held is None else pa.concat_batches([held, batch])
            if held is None or not held.num_rows:
                continue
            task = [held.column(c).to_numpy() for c in range(width)]
            new = np.any([t[1:] != t[:-1] for t in task], axis=0)
            starts = np.r_[0, np.flatnonzero(new) + 1, held.num_rows]
            # the last task may go on in the next batch
            done = len(starts) - 1 if batch is None else len(starts) - 2
            for k in range(done):
                got = do(held.slice(int(starts[k]), int(starts[k + 1] - starts[k])))
                if got is not None and got.num_rows:
                    yield got
            held = held.slice(int(starts[done]))

    return rows.repartition(*TASK).sortWithinPartitions(*TASK, "id").mapInArrow(frugal("near_dedup", walk), out)


def cluster_tasks(near: DataFrame, reps: DataFrame) -> DataFrame:
    """TASK, id and comp (the id itself), staged: members of the clusters that the staged pairs make, in blocks, and each cluster's smallest id in all of them."""
    clusters = connected_components(near)
    each = clusters.select(F.col("node").alias("id"), F.col("comp").alias("key")).join(reps.select(F.col("_id").alias("id"), "_n"), "id")
    size = each.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.least(F.sum("_n") / BLOCK_ELEMENTS, F.count(F.lit(1))))).alias("blocks"))
    gap = F.lit(-1).cast("long")
    dealt = each.join(size, "key").select("key", F.pmod(F.xxhash64("id"), "blocks").alias("block"), gap.alias("gap"), "id", "blocks")
    heads = dealt.where((F.col("id") == F.col("key")) & (F.col("blocks") > 1))
    heads = heads.select("key", "id", F.col("block").alias("_own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).where("block != _own")
    rows = dealt.select(*TASK, "id").unionByName(heads.select("key", "block", gap.alias("gap"), "id"))
    out = stage(rows.select(*TASK, "id", F.col("id").alias("comp")), "clusters")
    discard(clusters)
    return out


def bucket_links(multi: DataFrame, reps: DataFrame, labels: DataFrame, tasks: DataFrame, texts: Texts, threshold: int) -> DataFrame:
    """Links (a, b) that join components, from the buckets that hold several of them and members that did not meet in the tasks."""
    comps = labels.select(F.col("node").alias("id"), "comp")
    met = tasks.groupBy("id").agg(F.min(F.struct("key", "block")).alias("_x")).select("id", F.col("_x.key").alias("_mk"), F.col("_x.block").alias("_mb"))
    rows = _tasks(multi).join(comps, "id", "left").join(met, "id", "left")
    # who met nobody is by itself
    rows = rows.select(*TASK, "side", "id", F.coalesce("comp", "id").alias("comp"), F.coalesce("_mk", "id").alias("met"), F.coalesce("_mb", F.lit(-1)).alias("part"))
    bounds = [f(c).alias(f"{n}_{c}") for c in ("comp", "met", "part") for n, f in (("lo", F.min), ("hi", F.max))]
    mixed = rows.groupBy(*TASK).agg(*bounds).where("lo_comp < hi_comp AND (lo_met < hi_met OR lo_part < hi_part)").select(*TASK)
    rows = rows.join(mixed, TASK).join(reps.select(F.col("_id").alias("id"), F.col("_n").alias("n"), "_sig"), "id")

    def alike(own: pa.RecordBatch) -> pa.RecordBatch | None:
        side, comp, n = (own.column(c).to_numpy() for c in (4, 5, 6))
        met = np.stack([own.column(c).to_numpy() for c in (7, 8)], 1)
        sig = np.frombuffer(b"".join(own.column(9).to_pylist()), np.uint16).reshape(-1, SLOTS)
        found, forest = alike_members(comp, n, sig, side if own.column(2)[0].as_py() else None, met, threshold)
        if not forest:
            return None
        # members, then pairs of components
        ids, joins = own.column(3).to_numpy(), np.array(forest, np.int64)
        task = [pa.array(np.full(int(found.sum()) + len(joins), own.column(c)[0].as_py(), np.int64)) for c in range(3)]
        rest = [pa.array(x) for x in (np.r_[ids[found], joins[:, 0]], np.r_[comp[found], joins[:, 1]], np.r_[n[found], np.zeros(len(joins), np.int64)])]
        return pa.RecordBatch.from_arrays([*task, *rest], names=[*TASK, "id", "comp", "n"])

    shape = ", ".join(f"{c} long" for c in [*TASK, "id", "comp", "n"])
    near = stage(_walk(rows.select(*TASK, "id", "side", "comp", "n", "met", "part", "_sig"), lambda: alike, shape), "alike")
    # pairs of components have no size; members that agree lie in components of one cluster
    clusters = connected_components(near.where("n = 0").select(F.col("id").alias("a"), F.col("comp").alias("b")))
    members = near.where("n > 0")
    each = members.select("id", "comp", "n").distinct().join(clusters.select(F.col("node").alias("comp"), F.col("comp").alias("cluster")), "comp")
    small = each.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("e")).where((F.col("c") <= BLOCK_ROWS) & (F.col("e") <= BLOCK_ELEMENTS)).select("cluster")
    none = F.lit(-1).cast("long")
    once = each.join(small, "cluster").select(F.col("cluster").alias("key"), none.alias("block"), none.alias("gap"), "id", "comp")
    large = each.join(small, "cluster", "left_anti").select("id")
    tested = stage(once.unionByName(members.join(large, "id", "left_semi").select(*TASK, "id", "comp")), "tested")
    out = texts.links(tested, threshold)
    discard(near, clusters, tested)
    return out


def _tasks(multi: DataFrame) -> DataFrame:
    """TASK, side and id: every block of a bucket meets itself (gap 0) and every other once."""
    furthest = F.floor(F.col("blocks") / 2)
    rows = multi.select("key", "blocks", "id", F.col("block").alias("_own"), F.explode(F.sequence(F.lit(0).cast("long"), furthest)).alias("gap"))
    rows = rows.select("key", "blocks", "id", "_own", "gap", F.explode(F.sequence(F.lit(0).cast("long"), F.least("gap", F.lit(1).cast("long")))).alias("side"))
    rows = rows.withColumn("block", F.pmod(F.col("_own") - F.col("side") * F.col("gap"), "blocks"))
    # at half of an even number of blocks both directions are the same pair
    return rows.where((F.col("gap") * 2 != F.col("blocks")) | (F.col("block") < F.col("gap"))).select(*TASK, "side", "id")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, id_column: str = "doc_id", text: str = "text", marks: bool = False) -> DataFrame:
    """id, n_shingles, component_id and kept of every row; threshold in hundredths.

    With marks, also text_hash (xxhash64 of the row's text) and stands: whether the row's text is the one that stands for its id.
    """
    prepare(docs.sparkSession)
    base = stage(signatures(docs, width, id_column, text), "signatures")
    narrow = base.where(F.col("_id").isNotNull() & (F.col("_n") > 0)).groupBy("_id").agg(F.min(F.struct("_t", "_n", "_d")).alias("_x"))
    nodes = narrow.select("_id", "_x.*")
    # equal sets are one class, named by its smallest id
    classes = stage(nodes.groupBy("_n", "_d").agg(F.min(F.struct("_id", "_t")).alias("_x")).select("_n", "_d", F.col("_x._id").alias("_rep"), F.col("_x._t").alias("_u")), "classes")
    own = base.join(classes.select(F.col("_rep").alias("_id"), "_u"), "_id").where((F.col("_t") == F.col("_u")) & (F.col("_n") > 0))
    reps = stage(own.select("_id", "_t", "_n", "_sig").dropDuplicates(["_id"]), "representatives")
    bands = banded(reps)
    buckets = bands.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("c"), F.sum("_n").alias("e")).where("c > 1")
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK_ROWS, F.least(F.col("e") / BLOCK_ELEMENTS, F.col("c"))))
    multi = stage(bands.join(buckets, "key").select("key", blocks.alias("blocks"), F.pmod(F.xxhash64("id", "key"), blocks).alias("block"), "id", "hub"), "buckets")
    pairs = multi.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    near, texts = stage(_alike(pairs, reps, threshold), "alike"), Texts(docs, reps, width, id_column, text)
    tasks = cluster_tasks(near, reps)
    discard(near)
    links = texts.links(tasks, threshold)
    labels = connected_components(links)
    found = bucket_links(multi, reps, labels, tasks, texts, threshold)
    if not found.isEmpty():
        discard(labels)
        labels = connected_components(links.unionByName(found))
    discard(multi, tasks, links, found, reps)
    # the class of each id, then the component of its class; rows of an id get what its text has
    of = nodes.select("_id", "_n", "_d", F.col("_t").alias("_s")).join(classes, ["_n", "_d"]).select(F.col("_id").alias("_own"), "_rep", "_s")
    of = of.join(labels.select(F.col("node").alias("_rep"), F.col("comp").alias("_found")), "_rep", "left").select("_own", F.coalesce("_found", "_rep").alias("_comp"), "_s")
    rows = base.select("_id", "_n", "_t").join(of, F.col("_id") == F.col("_own"), "left").select("_id", "_n", F.coalesce("_comp", "_id").alias("_comp"), "_t", F.coalesce(F.col("_t") == F.col("_s"), F.lit(False)).alias("_stands"))
    comp = F.when(F.col("_id").isNull(), F.lit(None).cast("long")).otherwise(F.col("_comp"))
    kept = F.col("_id").isNull() | (F.col("_id") == F.col("_comp"))
    more = [F.col("_t").alias("text_hash"), F.col("_stands").alias("stands")] if marks else []
    return rows.select(F.col("_id").alias(id_column), F.col("_n").alias("n_shingles"), comp.alias("component_id"), kept.alias("kept"), *more)
