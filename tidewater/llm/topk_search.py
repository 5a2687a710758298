"""Exact top-k inner-product search with a KD-tree for each shard.

Shards are the leaves of median splits of a bounded sample, so that a shard's vectors lie close together; a leaf that holds
more than a shard's rows, as where one vector is very common, is cut further by a hash of the id. A shard's tree splits
its distinct vectors at the median of the widest coordinate down to leaves, each with a tight box and the smallest id in it.
Search is best-first: a query takes the leaves in the order of the greatest inner product that their boxes allow, and
ends once that bound is below its kth best score (or equals it with no smaller id). Queries go together, a step
at a time: those that are at one leaf are scored by one product of matrices.

A tree is built, and searched by the shard's own queries, in one task. The kth scores found there travel with the queries to the
other shards: in blocks of at most QUERY_ROWS queries (and QUERY_BYTES), each broadcast by itself, to tasks that go through
their trees one after another and carry the kth scores on from tree to tree. Vectors are shuffled once, to their shards;
after that only results are. Results are exact: scores are integers, ties go to the smaller id.

What boxes can prune depends on the vectors. Where all lie about as far from each other (as random ones in 64 dimensions do),
nothing can be, and an exact search scores all pairs of queries and vectors; `Counts` tells the share.

Cases: vectors that are null, empty, or that hold null, NaN or infinite components take no part; vectors of one length
meet only each other; fewer than k others give all; equal vectors are kept once with all their ids; a query's own row is
left out by id; ids must be unique and not null (rows without id take no part); an empty table gives an empty result;
scores beyond 2^53 are computed with integers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import discard, prepare, stage

LEAF = 128
SHARD_ROWS, SHARD_BYTES = 8192, 32 << 20
#: Queries that are broadcast at once, and the most bytes of their vectors.
QUERY_ROWS, QUERY_BYTES = 65_536, 32 << 20
#: Queries that go through a tree together.
TOGETHER = 2048
#: Vectors of the sample whose median splits place the shards.
SAMPLE_ROWS = 32_768


@dataclass
class Counts:
    """Pairs of queries and leaves, and those of them that were scored."""

    pairs: int = 0
    opened: int = 0


def _workable(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which inner products of rows of a and b are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


class Top:
    """The k best (score, id) of each of n queries, best first; `fresh` marks those that came after the start."""

    def __init__(self, n: int, k: int, scores: np.ndarray | None = None, ids: np.ndarray | None = None):
        self.k = k
        self.scores = np.full((n, k), -(1 << 63), np.int64) if scores is None else scores.copy()
        self.ids = np.full((n, k), (1 << 63) - 1, np.int64) if ids is None else ids.copy()
        self.fresh = np.zeros((n, k), bool)

    def merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.unique(rows)
        have = self.ids[at] < (1 << 63) - 1
        all_rows = np.r_[np.repeat(at, self.k)[have.ravel()], rows]
        all_scores, all_ids = np.r_[self.scores[at][have], scores], np.r_[self.ids[at][have], ids]
        fresh = np.r_[self.fresh[at][have], np.ones(len(rows), bool)]
        order = np.lexsort((all_ids, -all_scores, all_rows))
        group = all_rows[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        order, group, rank = (x[rank < self.k] for x in (order, group, rank))
        self.scores[group, rank], self.ids[group, rank], self.fresh[group, rank] = all_scores[order], all_ids[order], fresh[order]


class Tree:
    """A KD-tree over distinct integer vectors; ids of equal vectors are sorted lists. rows: leaf by leaf."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        distinct, first = np.unique(points, axis=0, return_inverse=True)
        first = first.reshape(-1)
        by = np.argsort(first, kind="stable")
        span = np.r_[np.flatnonzero(np.r_[True, np.diff(first[by]) > 0]), len(ids)] if len(ids) else np.zeros(1, int)
        ids = ids[by]
        open_, leaves = [np.arange(len(distinct))] if len(distinct) else [], []
        while open_:
            rows = open_.pop()
            if len(rows) <= leaf:
                leaves.append(rows)
                continue
            own = distinct[rows]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            rows = rows[np.argsort(own[:, axis], kind="stable")]
            open_ += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
        self.low, self.high = (np.array([f(distinct[r], axis=0) for r in leaves], np.int64).reshape(len(leaves), points.shape[1]) for f in (np.min, np.max))
        self.least = np.array([min(ids[span[r]]) for r in leaves], np.int64)
        self.cut = np.r_[0, np.cumsum([len(r) for r in leaves])].astype(int)
        placed = np.concatenate(leaves) if leaves else np.zeros(0, int)
        self.points = distinct[placed]
        counts = np.diff(span)[placed]
        self.span = np.r_[0, np.cumsum(counts)].astype(int)
        self.ids = np.concatenate([ids[span[r] : span[r + 1]] for r in placed]) if len(placed) else np.zeros(0, np.int64)
        for name in ("points", "low", "high"):
            values = getattr(self, name)
            small = next(t for t in (np.int16, np.int32, np.int64) if np.abs(values).max(initial=0) <= np.iinfo(t).max)
            setattr(self, name, values.astype(small))

    def search(self, queries: np.ndarray, own: np.ndarray, top: Top, at: np.ndarray, counts: Counts | None = None) -> None:
        """Better `top` at the rows `at` by the tree's vectors, for the queries with the ids own."""
        if not len(self.ids) or not len(queries):
            return
        kind = _workable(queries, self.points)
        q, points = queries.astype(kind), self.points.astype(kind)
        f = queries.astype(np.float64)
        bounds = np.maximum(f, 0) @ self.high.T.astype(np.float64) + np.minimum(f, 0) @ self.low.T.astype(np.float64)
        if kind is not np.float64:
            # room for what the bounds may have been rounded down
            bounds += 1 + 1e-9 * (np.abs(f) @ np.maximum(np.abs(self.low.astype(np.float64)), np.abs(self.high.astype(np.float64))).T)
        order = np.argsort(-bounds, axis=1, kind="stable")
        if counts:
            counts.pairs += bounds.size
        rows = np.arange(len(q))
        for step in range(order.shape[1]):
            leaf = order[rows, step]
            bound, floor, last = bounds[rows, leaf], top.scores[at[rows], -1], top.ids[at[rows], -1]
            # leaves come by their bounds: below its kth score a query has ended
            ended = bound < floor
            open_ = ~ended & ((bound > floor) | (self.least[leaf] < last))
            if counts:
                counts.opened += int(open_.sum())
            for k in np.unique(leaf[open_]):
                here = rows[open_ & (leaf == k)]
                a, b = self.cut[k], self.cut[k + 1]
                scores = q[here] @ points[a:b].T
                n, m = np.nonzero(scores >= top.scores[at[here], -1][:, None])
                if len(n):
                    self._take(here[n], a + m, scores[n, m].astype(np.int64), own, top, at)
            rows = rows[~ended]
            if not len(rows):
                return

    def _take(self, rows: np.ndarray, points: np.ndarray, scores: np.ndarray, own: np.ndarray, top: Top, at: np.ndarray) -> None:
        # one more than k ids of a vector at most: the query's own may be among them
        count = np.minimum(np.diff(self.span)[points], top.k + 1)
        each = np.repeat(np.arange(len(points)), count)
        ids = self.ids[self.span[points][each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)]
        keep = ids != own[rows[each]]
        if keep.any():
            top.merge(at[rows[each][keep]], scores[each][keep], ids[keep])


def quantised(vectors: DataFrame, scale: int, id_column: str, vector: str) -> DataFrame:
    """_id and _v (floor(scale * x) as longs) of the vectors that take part."""
    x = F.col("_raw")
    good = F.col("_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_raw")).where(F.coalesce(good, F.lit(False)))
    return rows.select("_id", F.transform(x, lambda e: F.floor(e * scale)).alias("_v"))


class Splits:
    """Median splits of sample points at the widest coordinate, down to about `leaves` parts."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.axis, self.cut, self.kids = [], [], []
        self.leaves = 0
        self._split(points.astype(np.float64), leaves)

    def _split(self, points: np.ndarray, leaves: int) -> int:
        k = len(self.axis)
        self.axis.append(0)
        self.cut.append(0.0)
        self.kids.append(None)
        left = np.zeros(len(points), bool)
        if leaves > 1 and len(points) > 1:
            axis = int(np.argmax(points.max(0) - points.min(0)))
            cut = np.median(points[:, axis])
            left = points[:, axis] < cut
            self.axis[k], self.cut[k] = axis, float(cut)
        if left.any() and not left.all():
            self.kids[k] = (self._split(points[left], leaves // 2), self._split(points[~left], leaves - leaves // 2))
        else:
            self.axis[k] = -1 - self.leaves
            self.leaves += 1
        return k

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        axis, cut = np.array(self.axis), np.array(self.cut)
        kids = np.array([k or (0, 0) for k in self.kids])
        node, rows = np.zeros(len(points), int), np.arange(len(points))
        while len(open_ := rows[axis[node] >= 0]):
            at = node[open_]
            node[open_] = kids[at, (points[open_, axis[at]] >= cut[at]).astype(int)]
        return -1 - axis[node]


def sharded(rows: DataFrame, total: int, shard_rows: int, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """rows, staged, with _shard: the leaf of the vector _v, and a hash part where a leaf holds too many."""
    shards = max(1, -(-total // shard_rows))
    if shards == 1:
        return stage(rows.withColumn("_shard", F.lit(0).cast("long")), "vectors")
    # the driver gathers the sample and keeps its splits, which are fewer
    some = rows.select("_v").sample(min(1.0, sample_rows / total), seed=11).limit(2 * sample_rows).toArrow().column("_v").combine_chunks()
    points = some.flatten().to_numpy().reshape(len(some), -1)
    splits = Splits(points, min(shards, max(1, len(points) // 16)))
    shared = rows.sparkSession.sparkContext.broadcast(splits)

    @F.pandas_udf("long")
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.place(np.stack(v.to_numpy())) if len(v) else np.zeros(0, int))

    placed = stage(rows.withColumn("_leaf", leaf_of("_v")), "placed")
    parts = placed.groupBy("_leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * shard_rows)).alias("_parts"))
    shard = (F.col("_leaf") * (1 << 24) + F.pmod(F.xxhash64("_id"), "_parts")).alias("_shard")
    out = stage(placed.join(parts, "_leaf").select(*rows.columns, shard), "vectors")
    discard(placed)
    return out


_TREE = "_shard long, _tree binary, _n long, _own binary, _vectors binary, _scores binary, _ids binary"


def build_trees(rows: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """A row a shard of rows (_shard, _id, _v, _is_query): its tree, its n queries and their k best in it."""

    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        ids, points = own["_id"].to_numpy(np.int64), np.stack(own["_v"].to_numpy()).astype(np.int64)
        tree, asks = Tree(ids, points, leaf), own["_is_query"].to_numpy(bool)
        top = Top(int(asks.sum()), k)
        for at in np.array_split(np.arange(len(top.ids)), max(1, -(-len(top.ids) // TOGETHER))):
            tree.search(points[asks][at], ids[asks][at], top, at)
        packed = [x.tobytes() for x in (ids[asks], points[asks], top.scores, top.ids)]
        return pd.DataFrame([(key[0], pickle.dumps(tree, protocol=pickle.HIGHEST_PROTOCOL), len(top.ids), *packed)], columns=["_shard", "_tree", "_n", "_own", "_vectors", "_scores", "_ids"])

    return rows.groupBy("_shard").applyInPandas(build, _TREE)


def _unpacked(row: dict, k: int) -> tuple[np.ndarray, ...]:
    own, scores, ids = (np.frombuffer(row[c], np.int64) for c in ("_own", "_scores", "_ids"))
    return own, np.frombuffer(row["_vectors"], np.int64).reshape(len(own), -1), scores.reshape(-1, k), ids.reshape(-1, k)


_FOUND = pa.schema([("_query", pa.int64()), ("_id", pa.int64()), ("_s", pa.int64())])


def at_home(trees: DataFrame, k: int) -> DataFrame:
    """_query, _id and _s of what the queries found in their own shards."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, _, scores, ids = _unpacked(row, k)
                have = ids < (1 << 63) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)[have.ravel()]), pa.array(ids[have]), pa.array(scores[have])], schema=_FOUND)

    return trees.where("_n > 0").select("_own", "_vectors", "_scores", "_ids").mapInArrow(unpack, "_query long, _id long, _s long")


def away(trees: DataFrame, first: int, last: int, k: int) -> DataFrame:
    """_query, _id and _s of the better ones that the queries of the shards first to last find in other shards."""
    spark = trees.sparkSession
    block = trees.where(F.col("_shard").between(first, last) & (F.col("_n") > 0)).drop("_tree").collect()
    parts = [_unpacked(r.asDict(), k) for r in block]
    homes = np.repeat([r["_shard"] for r in block], [len(p[0]) for p in parts])
    shared = spark.sparkContext.broadcast((homes, *[np.concatenate(x) for x in zip(*parts)]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, own, vectors, scores, ids = shared.value
        top = Top(len(own), k, scores, ids)
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                tree, asks = pickle.loads(blob.as_buffer()), np.flatnonzero(homes != shard)
                for at in np.array_split(asks, max(1, -(-len(asks) // TOGETHER))):
                    tree.search(vectors[at], own[at], top, at)
        n, m = np.nonzero(top.fresh)
        yield pa.RecordBatch.from_arrays([pa.array(own[n]), pa.array(top.ids[n, m]), pa.array(top.scores[n, m])], schema=_FOUND)

    return trees.select("_shard", "_tree").mapInArrow(meet, "_query long, _id long, _s long")


def _of_one_length(rows: DataFrame, width: int, total: int, k: int, shard_rows: int, query_rows: int, leaf: int) -> DataFrame:
    spark = rows.sparkSession
    shard_rows = max(1, min(shard_rows, SHARD_BYTES // (8 * width)))
    query_rows = max(1, min(query_rows, QUERY_BYTES // (8 * (width + 2 * k))))
    vectors = sharded(rows, total, shard_rows)
    trees = stage(build_trees(vectors, k, leaf), "kd-trees")
    discard(vectors)
    # a number or two a shard
    sizes = [(r["_shard"], r["_n"]) for r in trees.select("_shard", "_n").orderBy("_shard").collect()]
    found = [at_home(trees, k)]
    if len(sizes) > 1:
        tasks = 4 * spark.sparkContext.defaultParallelism
        # a few trees lie in a few files: they are dealt out to all tasks
        dealt = trees.repartition(len(sizes), "_shard") if len(sizes) <= tasks else trees
        first, held = 0, 0
        for n, (_, own) in enumerate(sizes):
            held += own
            if held and (n + 1 == len(sizes) or held + sizes[n + 1][1] > query_rows):
                found.append(away(dealt, sizes[first][0], sizes[n][0], k))
                first, held = n + 1, 0
        if len(found) > 3:
            found = [found[0], *[stage(f, "kd-away") for f in found[1:]]]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_column: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for each row where is_query (a Column over `_id`) holds."""
    prepare(vectors.sparkSession)
    rows = quantised(vectors, scale, id_column, vector).withColumn("_is_query", F.coalesce(is_query, F.lit(False)))
    lengths = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").collect()
    parts = [_of_one_length(rows.where(F.size("_v") == r["n"]), r["n"], r["count"], k, shard_rows, query_rows, leaf) for r in lengths]
    found = parts[0] if parts else rows.select(F.col("_id").alias("_query"), "_id", F.lit(0).cast("long").alias("_s"))
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(W.partitionBy("_query").orderBy(F.desc("_s"), F.asc("_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("_query").alias("query_id"), "rank", F.col("_id").alias("vec_id"), F.col("_s").alias("score"))
