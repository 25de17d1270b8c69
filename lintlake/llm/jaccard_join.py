"""Jaccard join of documents on word shingles by chosen paths.

A text is the set of its five-word shingles (ASCII case folded; shorter texts are one shingle). Texts with
equal sets are one node. In each of `runs` repeats a node is put into the bucket of a token sampled from its
set by a hash that all sets share; buckets over `limit` are split again, on two sampled tokens of each
member, until they are small. Two sets of similarity s share a sampled token with chance s, and stay together at a
split with chance 1 - (1 - s)^2; the number of repeats follows from the target recall with every split that may come
(`runs_for`). Inside small buckets members are compared by brute force, on 128-value sketches first. Buckets that stay
large at `depth` are cut into blocks, and all pairs of blocks compared, so no bucket is capped.

A pair that meets in several buckets belongs to the one with the least path. Where sketches find a pair near in
its own bucket, both sets are brought there, and the link is decided on the whole sets: only pairs that have met
are compared. No pair is ever a row; links are counted where they are found, and only edges to the least member of
what a block joins are kept for the classes.

No text moves between machines: each pass reads the documents again and keeps the nodes that a bitmap lets through
(sized by the number of nodes, up to `MOST_BITS`; beyond that it only lets more through).

Null texts and texts without words have no shingles: they link to nothing and are their own class. Repeated
rows are copies of one node. Only the id and the text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import U64, bounded_batches, grouped, mix, pieces, span_hashes, stored, table, utf8, word_spans
from lintlake.llm.components import components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
LIMIT = 512
DEPTH = 4
BRANCHES = 2
SKETCH = 128
#: Sketches let pairs through down to so many standard deviations below the similarity.
SLACK = 4.0
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def runs_for(similarity: float, recall: float, depth: int = DEPTH, branches: int = BRANCHES) -> int:
    """Repeats after which a pair at the threshold was in one last bucket at least once, with the target chance."""
    once = similarity * (1 - (1 - similarity) ** branches) ** (depth - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - once))


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, flat, and the n+1 cuts."""
    starts, ends, before = word_spans(buf, off)
    h = span_hashes(buf, starts, ends)
    n = np.diff(before)
    size = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), size)
    first = before[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    last = np.minimum(first + words, before[1:][row])
    out = (last - first).astype(U64)
    for k in range(words):
        at = first + k
        out = np.where(at < last, mix(out * U64(3) + h[np.minimum(at, len(h) - 1)]), out) if len(h) else out
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    if len(out):
        new = np.concatenate([[True], (out[1:] != out[:-1]) | (row[1:] != row[:-1])])
        out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(len(n) + 1))


def fold(values: np.ndarray, cuts: np.ndarray, how: np.ufunc, empty: int = 0) -> np.ndarray:
    """One value for each run between cuts."""
    out = np.full(len(cuts) - 1, empty, dtype=values.dtype)
    full = cuts[1:] > cuts[:-1]
    if full.any():
        out[full] = how.reduceat(values, cuts[:-1][full])
    return out


def sample(values: np.ndarray, cuts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The token of each run that is least under the hash of the run's seed."""
    size = np.diff(cuts)
    h = mix(values ^ np.repeat(seeds, size))
    least = fold(h, cuts, np.minimum)
    return mix(least + seeds)


def sketches(values: np.ndarray, cuts: np.ndarray, count: int = SKETCH) -> np.ndarray:
    """(runs, count) 16-bit minhashes of non-empty runs."""
    a = mix(np.arange(1, count + 1, dtype=U64)) | U64(1)
    out = np.empty((len(cuts) - 1, count), np.uint16)
    for k in range(count):
        h = values * a[k]
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        out[:, k] = (mix(fold(h, cuts, np.minimum)) >> U64(48)).astype(np.uint16)
    return out


def node_ids(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A hash of each set; equal for equal sets."""
    return mix(fold(mix(values), cuts, np.add) + np.diff(cuts).astype(U64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)


def first_pass(docs: DataFrame, doc_id: str, text: str, runs: int, words: int) -> DataFrame:
    """(doc_id, text_key, node, roots): a hash of each text, its node (null without words) and the bucket in each run."""
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema.add("text_key", "long").add("node", "long").add("roots", T.ArrayType(T.LongType()))
    seeds = mix(np.arange(1, runs + 1, dtype=U64) * U64(7919))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = utf8(b.column(2))
            nodes, roots, none = [np.zeros(0, np.int64)], [np.zeros((0, runs), np.int64)], [np.zeros(0, bool)]
            for x, y in pieces(off):
                v, cuts = shingle_sets(buf[off[x] : off[y]], off[x : y + 1] - off[x], words)
                nodes.append(_signed(node_ids(v, cuts)))
                roots.append(np.stack([_signed(sample(v, cuts, np.full(y - x, s, U64))) for s in seeds], 1))
                none.append(cuts[1:] == cuts[:-1])
            n = b.num_rows
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * runs), pa.array(np.concatenate(roots).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(nodes), mask=np.concatenate(none)), flat], names=["doc_id", "text_key", "node", "roots"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("__text")).mapInArrow(run, schema)


def bitmap(nodes: DataFrame) -> np.ndarray:
    """Packed bits of all nodes, about eight for each, but MOST_BITS at the most."""
    bits = min(max(LEAST_BITS, 1 << (8 * nodes.count()).bit_length()), MOST_BITS)
    at = nodes.select(F.pmod("node", F.lit(bits).cast("long")).alias("at"))
    rows = at.selectExpr("cast(at div 64 as int) AS w", "shiftleft(1L, cast(at % 64 as int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


def reread(docs: DataFrame, text: str, words: int, wanted: DataFrame, what: str) -> DataFrame:
    """(node, data) of the nodes that the bitmap of `wanted` lets through, each once for a task: sets or sketches."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = bits.value
        seen: set[int] = set()
        for b in batches:
            buf, off = utf8(b.column(0))
            for x, y in pieces(off):
                v, cuts = shingle_sets(buf[off[x] : off[y]], off[x : y + 1] - off[x], words)
                ids = _signed(node_ids(v, cuts))
                rows = []
                at = np.mod(ids, len(mask) * 8)
                for k in np.flatnonzero((mask[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & (cuts[1:] > cuts[:-1])).tolist():
                    if (i := int(ids[k])) not in seen:
                        seen.add(i)
                        rows.append(k)
                if not rows:
                    continue
                sets = [v[cuts[k] : cuts[k + 1]] for k in rows]
                if what == "sets":
                    data = [s.tobytes() for s in sets]
                else:
                    got = sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
                    data = [s.tobytes() for s in got]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(data, pa.binary())], names=["node", "data"])

    return docs.select(F.col(text).alias("__text")).mapInArrow(run, "node long, data binary")


def _labels(near: np.ndarray) -> np.ndarray:
    """The least index that each index reaches over a symmetric boolean matrix."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _blocked(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Rows with (i, j): each row goes to all pairs of blocks of its group that its own block is in."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), n.cast("long")).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"))))
    return rows.withColumns({"__n": n, "own": own}).withColumn("p", pairs).select(group, F.col("p.i").alias("i"), F.col("p.j").alias("j"), "own", *[c for c in rows.columns if c not in (group, size)])


def _sorted_groups(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


@dataclass
class Block:
    """The members of a pair of blocks of one bucket, each once, and which pairs belong to it."""

    path: int
    ids: np.ndarray
    at: np.ndarray
    sketch: np.ndarray
    todo: np.ndarray

    @classmethod
    def read(cls, t: pa.Table) -> Block:
        ids, at = np.unique(t.column("node").to_numpy(), return_index=True)
        take = pa.array(at)
        path, i, j = (t.column(c)[0].as_py() for c in ("path", "i", "j"))
        own = t.column("own").to_numpy()[at]
        sketch = np.frombuffer(b"".join(t.column("sketch").combine_chunks().take(take).to_pylist()), np.uint16).reshape(len(ids), -1)
        lists = t.column("paths").combine_chunks().take(take)
        flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        todo = np.triu((own[:, None] != own[None, :]) | (i == j), 1)  # pairs inside one block belong to the pair (block, block)
        # not pairs that meet under a lesser path
        order = np.argsort(flat, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(flat[order])) + 1, [len(flat)]]) if len(flat) else np.zeros(1, np.int64)
        size = np.diff(cuts)
        for k in np.argsort(-size, kind="stable")[: int((size > 1).sum())].tolist():  # largest first: one is often enough
            members = row[order[cuts[k] : cuts[k + 1]]]
            todo[np.ix_(members, members)] = False
            if size[k] > 32 and not todo.any():
                break
        return cls(path, ids, at, sketch, todo)

    def near(self, floor: float) -> Iterator[tuple[int, np.ndarray]]:
        """For each member those after it that sketches find near, of the pairs that belong here."""
        for k in np.flatnonzero(self.todo.any(1)).tolist():
            others = np.flatnonzero(self.todo[k])
            others = others[(self.sketch[others] == self.sketch[k]).mean(1) >= floor]
            if len(others):
                yield k, others


_MEMBER = "path long, i int, j int, own int, node long, sketch binary, paths array<long>"


def meetings(buckets: DataFrame, floor: float) -> DataFrame:
    """Members of blocks that sketches find near to another one there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            b = Block.read(t)
            met = np.zeros(len(b.ids), bool)
            for k, others in b.near(floor):
                met[k] = met[others] = True
            if met.any():
                yield from t.take(pa.array(b.at[met])).to_batches()

    lesser = F.filter("paths", lambda p: p < F.col("path")).alias("paths")
    return _sorted_groups(buckets.select("path", "i", "j", "own", "node", "sketch", lesser), "path").mapInArrow(run, _MEMBER)


def links_of(members: DataFrame, similarity: float, floor: float) -> DataFrame:
    """(node, other, links): exact decisions on whole sets for the pairs that have met in a block.

    links: documents behind the nodes that a node links to there; other: the least node joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            b = Block.read(t)
            copies = t.column("copies").to_numpy()[b.at]
            sets = [np.frombuffer(x, U64) for x in t.column("data").combine_chunks().take(pa.array(b.at)).to_pylist()]
            size = np.array([len(x) for x in sets])
            near = np.eye(len(b.ids), dtype=bool)
            for k, others in b.near(floor):
                low, high = np.minimum(size[others], size[k]), np.maximum(size[others], size[k])
                for o in others[low >= similarity * high - 1e-9].tolist():
                    both = len(np.intersect1d(sets[k], sets[o], assume_unique=True))
                    if both >= similarity * (size[k] + size[o] - both) - 1e-9:
                        near[k, o] = near[o, k] = True
            label = _labels(near)
            count = near.astype(np.int64) @ copies - copies
            some = count > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[some]), pa.array(b.ids[label[some]]), pa.array(count[some])], names=["node", "other", "links"])

    return _sorted_groups(members, "path").mapInArrow(run, "node long, other long, links long")


def children(rows: DataFrame, branches: int) -> DataFrame:
    """(path, node): the next buckets of nodes in large ones, from their sets and paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for node, data, paths in zip(b.column("node").to_pylist(), b.column("data").to_pylist(), b.column("paths").to_pylist(), strict=True):
                v = np.frombuffer(data, U64)
                for p in np.array(paths, np.int64).view(U64).tolist():
                    seeds = mix(np.full(branches, p, U64) + np.arange(1, branches + 1, dtype=U64))
                    got = np.array([sample(v, np.array([0, len(v)]), seeds[k : k + 1])[0] for k in range(branches)], U64)
                    out.append(_signed(got))
                    ids.append(np.full(branches, node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(ids))], names=["path", "node"])

    return rows.mapInArrow(run, "path long, node long")


def counted(assigned: DataFrame, name: str) -> DataFrame:
    """(path, node, n) of the buckets with two members or more."""
    n = assigned.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
    return stored(assigned.join(n, "path"), name)


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """doc_id, class_id (least id of the documents that links connect), copy_of (least id with equal shingles), n_links,
    text_key (a hash of the text), and stays: whether (doc_id, text_key) is the least of its class, or has no class."""
    bounded_batches(docs.sparkSession)
    floor = similarity - SLACK * math.sqrt(similarity * (1 - similarity) / SKETCH)
    base = stored(first_pass(docs, doc_id, text, runs_for(similarity, recall, depth), words), "shingles")
    nodes = stored(base.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key")).alias("copy"), F.first("roots").alias("roots")), "nodes")

    small = []
    found = counted(nodes.select(F.explode("roots").alias("path"), "node").distinct(), "buckets")
    for level in range(1, depth + 1):
        small.append(found.filter(F.col("n") <= limit))
        large = found.filter(F.col("n") > limit)
        if large.isEmpty():
            break
        if level == depth:
            small.append(large)
            break
        paths = large.groupBy("node").agg(F.collect_set("path").alias("paths"))
        sets = reread(docs, text, words, large.select("node").distinct(), "sets").groupBy("node").agg(F.first("data").alias("data"))
        found = counted(children(sets.join(paths, "node"), BRANCHES).distinct(), "buckets")
    buckets = small[0]
    for s in small[1:]:
        buckets = buckets.unionByName(s)

    met = buckets.select("node").distinct()
    sketched = reread(docs, text, words, met, "sketches").groupBy("node").agg(F.first("data").alias("sketch"))
    paths = buckets.groupBy("node").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    known = stored(sketched.join(paths, "node"), "sketches")
    members = stored(meetings(_blocked(buckets.join(known, "node"), "path", "n", limit), floor), "meetings")
    sets = reread(docs, text, words, members.select("node").distinct(), "sets").groupBy("node").agg(F.first("data").alias("data"))
    decided = members.join(nodes.select("node", "copies"), "node").join(sets, "node")
    linked = stored(links_of(decided.select("path", "i", "j", "own", "node", "sketch", "paths", "copies", "data"), similarity, floor), "links")

    joined = components(linked.select(F.col("node").alias("u"), F.col("other").alias("v")))
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    least = joined.join(nodes.select("node", "copy"), "node").groupBy("component").agg(F.min("copy").alias("class"))
    of_node = nodes.select("node", "copies", "copy").join(joined.join(least, "component").select("node", "class"), "node", "left").join(counts, "node", "left")
    of_node = of_node.select(F.col("node").alias("__node"), F.coalesce("class", "copy").alias("class"), "copy", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = base.join(of_node, base["node"] == of_node["__node"], "left")
    alone = F.col("node").isNull()
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("class.doc_id")) & (F.col("text_key") == F.col("class.text_key")))
    of = lambda c: F.when(alone, F.col("doc_id")).otherwise(F.col(f"{c}.doc_id"))
    return out.select("doc_id", of("class").alias("class_id"), of("copy").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_key", stays.alias("stays"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate class and number of links."""
    return jaccard_join(table(spark, sf_dir, "documents")).drop("stays")
