"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits space level by level along random directions between two vectors of a sample; all nodes of a
level share the direction, and each node has its own offset, the median of its sample (deeper than the sample
reaches, that of the level). So a forest is small whatever its depth, and is broadcast: depth grows with the
logarithm of the rows, and leaves keep about `LEAF` of them. Every vector is put into its leaf of each tree. A query
walks all trees through one priority queue, ordered by the sum of squares of how far it is on the wrong side of the planes
on the way, until that passes a bound; all rows of the leaves on the way are scored exactly, in double
precision.

The bound is fitted to the data: for `FIT` of the queries the true neighbours are found by a scan of all rows, and
the bound is the least one under which `RECALL` of them lie in leaves on the way. Queries that find fewer than
they could walk on with a wider bound, at last through every leaf. Leaves of over `CHUNK` vectors are cut into chunks by hashes,
so that no leaf is capped and none meets in one task.

Nearness is the largest inner product. For vectors of unequal length the trees see each vector with one more
component that brings all of them to the same length, and queries stretched to that length; scores are of the
original vectors. Vectors are compared with those of the same number of components; each such number has a forest.

Vectors that are null, zero, or hold null or non-finite components take no part, as queries or candidates; nor
do rows without an id. Ties go to the smaller id. Rows that agree in id and vector are one row; rows with one id
and different vectors are rows of their own, each a candidate and each a query. An empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import bounded_batches, grouped, stored, table

SAMPLE = 8192
TREES = 10
LEAF = 400
#: Queries that the bound is fitted on, and the share of their neighbours to be found.
FIT = 128
RECALL = 0.93
CHUNK = 4096
NEAREST = 20
#: Queries whose lists a task joins before it sends them on.
HELD = 20_000


@dataclass
class Forest:
    """Directions by tree and level, and offsets by tree and node (heap order: the children of k are 2k + 1 and 2k + 2)."""

    normals: np.ndarray  # (trees, depth, dim)
    offsets: np.ndarray  # (trees, nodes of the upper levels)
    levels: np.ndarray  # (trees, depth): offsets of deeper nodes
    depth: int

    @classmethod
    def grow(cls, sample: np.ndarray, trees: int, depth: int, seed: int = 5) -> Forest:
        g = np.random.default_rng(seed)
        upper = min(depth, max(int(math.log2(max(len(sample) // 16, 1))), 0))
        w, b, mid = np.zeros((trees, depth, sample.shape[1])), np.zeros((trees, 2**upper - 1)), np.zeros((trees, depth))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                i, j = g.integers(len(sample), size=2)
                n = sample[i] - sample[j]
                n = n if n.any() else g.normal(size=sample.shape[1])
                w[t, level] = n / np.linalg.norm(n)
                side = sample @ w[t, level]
                mid[t, level] = np.median(side)
                if level < upper:
                    for k in range(2**level - 1, 2 ** (level + 1) - 1):
                        own = side[node == k]
                        b[t, k] = np.median(own) if len(own) else mid[t, level]
                node = 2 * node + 1 + (side > cls._offset(b[t], mid[t, level], node))
        return cls(w, b, mid, depth)

    @staticmethod
    def _offset(nodes: np.ndarray, level: float, k: np.ndarray) -> np.ndarray:
        return np.where(k < len(nodes), nodes[np.minimum(k, max(len(nodes) - 1, 0))], level) if len(nodes) else np.full(len(k), level)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree; leaves of all trees are numbered through."""
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t in range(len(self.normals)):
            k = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = 2 * k + 1 + (x @ self.normals[t, level] > self._offset(self.offsets[t], self.levels[t, level], k))
            out[:, t] = k - (2**self.depth - 1) + t * 2**self.depth
        return out

    def reach(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How wide a bound has to be for a query to come to a leaf of each of the vectors."""
        best = np.full(len(x), np.inf)
        for t in range(len(self.normals)):
            k, p = np.zeros(len(x), np.int64), np.zeros(len(x))
            for level in range(self.depth):
                off = self._offset(self.offsets[t], self.levels[t, level], k)
                right, ahead = x @ self.normals[t, level] > off, self.normals[t, level] @ q - off
                p += np.where(right == (ahead > 0), 0.0, ahead**2)
                k = 2 * k + 1 + right
            best = np.minimum(best, p)
        return best

    def walk(self, q: np.ndarray, bound: float) -> list[int]:
        """The leaves that a shared priority queue reaches within the bound; at least one of each tree."""
        inner = 2**self.depth - 1
        ahead = self.normals @ q
        queue = [(0.0, t, 0, 0) for t in range(len(self.normals))]
        found: list[int] = []
        while queue:
            p, t, level, k = heapq.heappop(queue)
            if p > bound:
                break
            if level == self.depth:
                found.append(k - inner + t * 2**self.depth)
                continue
            m = ahead[t, level] - (self.offsets[t, k] if k < self.offsets.shape[1] else self.levels[t, level])
            near, far = (2 * k + 2, 2 * k + 1) if m > 0 else (2 * k + 1, 2 * k + 2)
            heapq.heappush(queue, (p, t, level + 1, near))
            heapq.heappush(queue, (p + m * m, t, level + 1, far))
        return found


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _level(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component, so that all have the same length."""
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))[:, None]], 1)


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with one query, summed in an order that depends on nothing else."""
    return np.ascontiguousarray(x * q).sum(1)


def _stretched(q: np.ndarray, longest: float) -> np.ndarray:
    """A query at the length that the trees see."""
    return np.concatenate([q * (longest / math.sqrt((q * q).sum())), [0.0]])


@dataclass
class Found:
    """Candidates of one query: row keys, ids and scores."""

    key: np.ndarray
    id: np.ndarray
    score: np.ndarray

    def best(self, k: int) -> Found:
        """The k nearest, each row once; ties by id."""
        _, first = np.unique(self.key, return_index=True)
        order = first[np.lexsort((self.key[first], self.id[first], -self.score[first]))[:k]]
        return Found(self.key[order], self.id[order], self.score[order])

    def __add__(self, other: Found) -> Found:
        return Found(*(np.concatenate([a, b]) for a, b in zip((self.key, self.id, self.score), (other.key, other.id, other.score), strict=True)))


def nearest_of(x: np.ndarray, keys: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, rough: np.ndarray, k: int) -> Found:
    """The k nearest rows by exact score; rough scores only shut out what is clearly further."""
    at = np.arange(len(rough))
    if len(rough) > 2 * k:
        edge = -np.partition(-rough, k)[k]  # one more than k, for the query itself
        at = np.flatnonzero(rough >= edge - 1e-9 * max(1.0, abs(edge)))
    at = at[keys[at] != own]
    return Found(keys[at], ids[at], scores(x[at], q)).best(k)


_LISTS = T.StructType().add("query", "long").add("query_id", "long").add("keys", T.ArrayType(T.LongType())).add("ids", T.ArrayType(T.LongType())).add("s", T.ArrayType(T.DoubleType()))


def _lists(found: dict[int, tuple[int, Found]]) -> pa.RecordBatch:
    each = [f for _, f in found.values()]
    cuts = pa.array(np.concatenate([[0], np.cumsum([len(f.id) for f in each])]).astype(np.int32))
    flat = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([getattr(f, c) for f in each]))) for c in ("key", "id", "score")]
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([i for i, _ in found.values()], pa.int64()), *flat], names=_LISTS.names)


def _joined_lists(lists: DataFrame, k: int) -> DataFrame:
    """One list for each query."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 1):
            key, ids, s = (np.concatenate([np.asarray(x, dtype=kind) for x in t.column(c).to_pylist()]) for c, kind in (("keys", np.int64), ("ids", np.int64), ("s", np.float64)))
            yield _lists({t.column("query")[0].as_py(): (t.column("query_id")[0].as_py(), Found(key, ids, s).best(k))})

    return lists.repartition("query").sortWithinPartitions("query").mapInArrow(merge, _LISTS)


def exact(rows: DataFrame, some: list, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For a bounded number of queries (key, id, v): the query and its true nearest vectors, by a scan of all rows."""
    ask = rows.sparkSession.sparkContext.broadcast([(r.key, r.id, np.array(r.v, float)) for r in some])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, Found]] = {}
        for b in batches:
            if b.num_rows:
                x, keys, ids = _matrix(b.column("v")), b.column("key").to_numpy(), b.column("id").to_numpy()
                for own, i, q in ask.value:
                    got = nearest_of(x, keys, ids, q, own, x @ q, k)
                    best[own] = (i, (best[own][1] + got).best(k) if own in best else got)
        if best:
            yield _lists(best)

    lists = _joined_lists(rows.select("key", "id", "v").mapInArrow(scan, _LISTS), k).select("query", F.explode("keys").alias("key"))
    pairs = lists.join(rows.select("key", "v").dropDuplicates(["key"]), "key").collect()
    near: dict[int, list] = {}
    for r in pairs:
        near.setdefault(r.query, []).append(r.v)
    return {r.key: (np.array(r.v, float), np.array(near[r.key], float)) for r in some if r.key in near}


def search(rows: DataFrame, forest: Forest, longest: float, bound: float, k: int) -> DataFrame:
    """The lists of all rows that ask, from the leaves within the bound."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    kind = rows.schema["v"].dataType
    layout = T.StructType().add("leaf", "long").add("asks", "boolean").add("key", "long").add("id", "long").add("v", kind)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            if b.num_rows:
                at = f.leaves(_level(_matrix(b.column("v")), longest))
                take = pa.array(np.repeat(np.arange(b.num_rows), at.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(np.zeros(len(take), bool)), *[b.column(c).take(take) for c in ("key", "id", "v")]], names=layout.names)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            x = _matrix(b.column("v")) if b.num_rows else []
            for i in range(len(x)):
                leaf = f.walk(_stretched(x[i], longest), bound)
                take = pa.array(np.full(len(leaf), i))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(np.ones(len(leaf), bool)), *[b.column(c).take(take) for c in ("key", "id", "v")]], names=layout.names)

    held = rows.select("key", "id", "v").mapInArrow(place, layout)
    asked = rows.filter("asks").select("key", "id", "v").repartition("key").mapInArrow(route, layout)
    # large leaves only; a query goes to every chunk of its leaf
    sizes = rows.select("key", "id", "v").mapInArrow(place, layout).groupBy("leaf").count().filter(F.col("count") > CHUNK).select("leaf", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    chunks = F.coalesce("chunks", F.lit(1))
    held = held.join(sizes, "leaf", "left").select("leaf", F.pmod(F.xxhash64("key"), chunks.cast("long")).cast("int").alias("chunk"), "asks", "key", "id", "v")
    asked = asked.join(sizes, "leaf", "left").select("leaf", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "asks", "key", "id", "v")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, Found]] = {}
        for t in grouped(batches, 2):
            asks = t.column("asks").to_numpy()
            x, keys, ids = _matrix(t.column("v")), t.column("key").to_numpy(), t.column("id").to_numpy()
            have, want = np.flatnonzero(~asks), np.flatnonzero(asks)
            if not len(have):
                continue
            hx, hk, hi = x[have], keys[have], ids[have]
            for a in range(0, len(want), 512):
                part = want[a : a + 512]
                for w, r in zip(part.tolist(), x[part] @ hx.T, strict=True):
                    got = nearest_of(hx, hk, hi, x[w], int(keys[w]), r, k)
                    q = int(keys[w])
                    best[q] = (int(ids[w]), (best[q][1] + got).best(k) if q in best else got)
            if len(best) >= HELD:
                yield _lists(best)
                best = {}
        if best:
            yield _lists(best)

    both = held.unionByName(asked).repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk")
    return _joined_lists(both.mapInArrow(score, _LISTS), k)


def _of_dimension(rows: DataFrame, k: int, trees: int, leaf: int, sample: int, recall: float) -> DataFrame:
    """Lists of all rows that ask, among rows with equally many components."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    seen = rows.agg(F.count_distinct("key").alias("n"), F.max(length).alias("longest")).first()
    longest, n = float(seen.longest or 0.0), int(seen.n)
    some = rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").collect()
    depth = max(round(math.log2(max(n, 1) / leaf)), 0)
    forest = Forest.grow(_level(np.array([r.v for r in some], float), longest), trees, depth)
    fit = exact(rows, rows.filter("asks").orderBy(F.xxhash64("key", F.lit(7)), "key").limit(FIT).select("key", "id", "v").dropDuplicates(["key"]).collect(), k)
    wide = [forest.reach(_stretched(q, longest), _level(near, longest)) for q, near in fit.values()]
    bound = float(np.quantile(np.concatenate(wide), recall, method="higher")) if wide else 0.0
    out, left = None, rows
    while True:
        got = stored(search(left, forest, longest, bound, k), "neighbours")
        full = got.filter((F.size("ids") >= min(k, n - 1)) | F.lit(math.isinf(bound)))
        out = full if out is None else out.unionByName(full)
        few = left.filter("asks").select("key").distinct().join(full.select(F.col("query").alias("key")), "key", "left_anti")
        if math.isinf(bound) or few.isEmpty():
            return out
        # the rest asks again, with a wider bound and then through all leaves
        again = few.withColumn("again", F.lit(True))
        left = rows.join(again, "key", "left").withColumn("asks", F.col("again").isNotNull() & F.col("asks")).drop("again")
        bound = 4 * bound if 0 < bound < 4 * longest**2 else math.inf


def nearest(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEAREST, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for rows under `queries` the k nearest found of all rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = F.col(embedding)
    if vectors.schema[embedding].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        v = v.cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    rows = rows.withColumn("key", F.xxhash64("id", "v"))
    out = None
    for (dim,) in sorted(rows.select(F.size("v")).distinct().collect()):
        got = _of_dimension(rows.filter(F.size("v") == dim), k, trees, leaf, sample, recall)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    each = out.select("query_id", F.posexplode(F.arrays_zip("ids", "s")).alias("at", "x"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.s").alias("score"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
