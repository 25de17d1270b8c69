"""Near-duplicate classes by b-bit minhash.

A text is the set of its `words`-word shingles (ASCII case folded; shorter texts are one shingle). Texts with equal sets
are one node. A node has `HASHES` minima. Bands of `ROWS` of them name candidates; as many bands are used as the target
recall asks for at the similarity (`bands_for`). Of each minimum only the low `BITS` bits are retained, packed as bit
planes of 64-bit words: the bits in which no plane of two signatures differs are counted, and the estimate is freed from
the share of minima that agree by chance in so few bits, (m - 2^-b) / (1 - 2^-b).

Links are confirmed on whole sets, in two steps, so that large groups of near copies cost what their size is:

1. In each band each node meets the least node there. Pairs that the estimate lets through are confirmed.
2. Only buckets whose nodes are not all of one class by then are left. They are cut into blocks, and blocks meet
   each other; within them only pairs of different classes are estimated, and confirmed until they are one.

No pair in a bucket is passed over but those that have a class in common already, so classes are what all links give.
No text moves: sets are read again from the texts for the nodes that a bitmap lets through.

Null texts and texts without words have an empty set and link to nothing: each row is a class of its own. Repeated rows
are copies of one node. A null id names no class if another id does, and its row is kept only where its class has no id at
all. A long text is held as its bytes and its set. Of the table only id, text and `keep` are read; of clashing names the
result's own win. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lintlake.llm.common import U64, bounded_batches, grouped, mix, pieces, stored, table, utf8
from lintlake.llm.components import components
from lintlake.llm.jaccard_join import bitmap, fold, node_ids, shingle_sets

WORDS = 3
PERCENT = 85
HASHES = 128
ROWS = 5
BITS = 4
RECALL = 0.999999
#: The estimate lets pairs through down to so many standard deviations below the similarity.
SLACK = 4.5
#: Nodes of a block.
BLOCK = 512
RESULT = ("n_shingles", "component_id", "kept")


def bands_for(similarity: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of `rows` minima of which a pair at the similarity shares one with the target chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def minima(values: np.ndarray, cuts: np.ndarray, hashes: int) -> np.ndarray:
    """(runs, hashes) 64-bit minima of each run of shingle hashes; empty runs have zeros."""
    a, b = mix(np.arange(1, hashes + 1, dtype=U64)) | U64(1), mix(np.arange(1, hashes + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    out, h, high = np.zeros((len(cuts) - 1, hashes), U64), np.empty_like(values), np.empty_like(values)
    for k in range(hashes):
        np.multiply(values, a[k], out=h)
        np.bitwise_xor(h, b[k], out=h)
        np.right_shift(h, U64(32), out=high)
        np.bitwise_xor(h, high, out=h)
        np.multiply(h, U64(0xBF58476D1CE4E5B9), out=h)
        out[:, k] = fold(h, cuts, np.minimum)
    return mix(out)


def packed(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Signatures of minima: for each of the low bits a plane of one bit a minimum, in 64-bit words (rows, bits * hashes / 64)."""
    planes = [np.packbits((least >> U64(k)).astype(np.uint8) & 1, axis=1, bitorder="little") for k in range(bits)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view("<u8")


def band_keys(least: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """(nodes, bands) hashes of the whole minima of each band."""
    out = np.tile(mix(np.arange(1, bands + 1, dtype=U64) * U64(7919)), (len(least), 1))
    for k in range(rows):
        out = mix(out * U64(3) + least[:, k : bands * rows : rows])
    return out


def agreement(mismatches: np.ndarray | Column, hashes: int, bits: int) -> np.ndarray | Column:
    """The similarity that so many different minima of b bits stand for, without agreement by chance."""
    chance = 0.5**bits
    return ((1 - mismatches / hashes) - chance) / (1 - chance)


def mismatches(one: np.ndarray, others: np.ndarray, bits: int) -> np.ndarray:
    """How many minima of a signature differ from those of others: a bit of any plane differs."""
    planes = (one ^ others).reshape(len(others), bits, -1)
    return np.bitwise_count(np.bitwise_or.reduce(planes, axis=1)).sum(axis=1)


def mismatches_of(a: str, b: str, hashes: int, bits: int) -> Column:
    """The same for two array columns."""
    words = hashes // 64
    planes = [[F.get(a, F.lit(p * words + w)).bitwiseXOR(F.get(b, F.lit(p * words + w))) for p in range(bits)] for w in range(words)]
    return sum((F.bit_count(reduce(Column.bitwiseOR, each)) for each in planes), F.lit(0))


def floor_of(similarity: float, hashes: int, bits: int) -> float:
    """The estimate below which a pair of the similarity falls with a chance of SLACK standard deviations."""
    chance = 0.5**bits
    p = chance + (1 - chance) * similarity
    return similarity - SLACK * math.sqrt(p * (1 - p) / hashes) / (1 - chance)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).astype(U64).view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(_signed(x).ravel()))


def signatures(docs: DataFrame, doc_id: str, text: str, keep: tuple[str, ...], words: int, bands: int, hashes: int = HASHES, bits: int = BITS) -> DataFrame:
    """`keep` columns as __keep0, __keep1 ..., with __id, n_shingles, node (null for an empty set), and, for its first row in a task, the node's bands and signature."""
    own_names = [F.col(c).alias(f"__keep{k}") for k, c in enumerate(keep)]
    schema = docs.select(*own_names, F.col(doc_id).alias("__id")).schema.add("n_shingles", "long", False).add("node", "long").add("bands", T.ArrayType(T.LongType())).add("signature", T.ArrayType(T.LongType()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for b in batches:
            buf, off = utf8(b.column(0))
            for x, y in pieces(off):
                v, cuts = shingle_sets(buf[off[x] : off[y]], off[x : y + 1] - off[x], words)
                size, ids = np.diff(cuts), _signed(node_ids(v, cuts))
                _, new = np.unique(ids, return_index=True)
                new = new[(size[new] > 0) & ~np.isin(ids[new], seen)]
                seen = np.union1d(seen, ids[new])
                order = np.sort(new)
                own = np.repeat(np.isin(np.arange(len(size)), order), size)
                least = minima(v[own], np.concatenate([[0], np.cumsum(size[order])]), hashes)
                at = np.full(len(size), -1)
                at[order] = np.arange(len(order))
                take = pa.array(at, mask=at < 0)
                told = [_lists(m).take(take) if len(m) else pa.nulls(len(size), pa.list_(pa.int64())) for m in (band_keys(least, bands), packed(least, bits))]
                rest = [b.column(k).slice(x, y - x) for k in range(1, b.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(size), pa.array(ids, mask=size == 0), *told], schema=arrow)

    return docs.select(F.col(text).alias("__text"), *own_names, F.col(doc_id).alias("__id")).mapInArrow(run, schema)


def sets_of(docs: DataFrame, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(node, data): the sets of the wanted nodes, each once, read again from the texts that a bitmap lets through."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, seen = bits.value, np.zeros(0, np.int64)
        for b in batches:
            buf, off = utf8(b.column(0))
            for x, y in pieces(off):
                v, cuts = shingle_sets(buf[off[x] : off[y]], off[x : y + 1] - off[x], words)
                ids = _signed(node_ids(v, cuts))
                at = np.mod(ids, len(mask) * 8)
                _, new = np.unique(ids, return_index=True)
                new = new[(mask[at[new] >> 3] >> (at[new] & 7).astype(np.uint8) & 1).astype(bool) & (cuts[1:] > cuts[:-1])[new] & ~np.isin(ids[new], seen)]
                if len(new):
                    seen = np.union1d(seen, ids[new])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array([v[cuts[k] : cuts[k + 1]].tobytes() for k in new.tolist()], pa.binary())], names=["node", "data"])

    return docs.select(F.col(text).alias("__text")).mapInArrow(run, "node long, data binary").groupBy("node").agg(F.first("data").alias("data"))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are alike: 100 x intersection >= percent x union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def star_links(buckets: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, words: int, percent: int, floor: float, hashes: int, bits: int) -> DataFrame:
    """(u, v): confirmed links of nodes with the least node of one of their buckets."""
    pairs = buckets.filter("node != least").select("node", F.col("least").alias("other")).distinct()
    signed = nodes.select("node", "signature")
    near = pairs.join(signed, "node").join(signed.select(F.col("node").alias("other"), F.col("signature").alias("theirs")), "other")
    near = stored(near.filter(agreement(mismatches_of("signature", "theirs", hashes, bits), hashes, bits) >= floor).select("node", "other"), "bbit-pairs")
    sets = stored(sets_of(docs, text, words, near.select("node").unionByName(near.select(F.col("other").alias("node"))).distinct()), "bbit-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yes = [linked(np.frombuffer(x, U64), np.frombuffer(y, U64), percent) for x, y in zip(b.column(2), b.column(3), strict=True) for x, y in [(x.as_buffer(), y.as_buffer())]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(yes, pa.bool_()))

    both = near.join(sets, "node").join(sets.select(F.col("node").alias("other"), F.col("data").alias("theirs")), "other")
    return both.select("node", "other", "data", "theirs").mapInArrow(run, "u long, v long")


_MEMBER = "path long, i int, j int, own int, node long, class long, signature array<long>"


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows of buckets of `n` nodes, each for all pairs of blocks that its own block is in."""
    count = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks").cast("long")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"))))
    out = rows.withColumn("blocks", count).withColumn("own", own).withColumn("p", pair)
    return out.select("path", F.col("p.i").alias("i"), F.col("p.j").alias("j"), *[c for c in rows.columns if c not in ("path", "n")], "own")


def _near(t: pa.Table, floor: float, bits: int, labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of a pair of blocks, for each member those after it, of another label, that the estimate finds near; labels may change meanwhile."""
    own, same = t.column("own").to_numpy(), t.column("i")[0].as_py() == t.column("j")[0].as_py()
    sig = t.column("signature").combine_chunks().flatten().to_numpy().view(U64).reshape(t.num_rows, -1)
    hashes = sig.shape[1] * 64 // bits
    for k in range(t.num_rows - 1):
        others = np.flatnonzero(labels[k + 1 :] != labels[k]) + k + 1
        if not same:
            others = others[own[others] != own[k]]
        if len(others):
            others = others[agreement(mismatches(sig[k], sig[others], bits), hashes, bits) >= floor]
        if len(others):
            yield k, others


def meetings(blocks: DataFrame, floor: float, bits: int) -> DataFrame:
    """Members of pairs of blocks that the estimate finds near to one of another class there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            met = np.zeros(t.num_rows, bool)
            for k, others in _near(t, floor, bits, t.column("class").to_numpy()):
                met[k] = met[others] = True
            if met.any():
                yield from t.filter(pa.array(met)).to_batches()

    return blocks.select(*[x.split()[0] for x in _MEMBER.split(", ")]).repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(run, _MEMBER)


def block_links(members: DataFrame, percent: int, floor: float, bits: int) -> DataFrame:
    """(u, v): confirmed links between classes that meet in a block; a pair is passed over once links join its classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            nodes, labels = t.column("node").to_numpy(), t.column("class").to_numpy().copy()
            data = t.column("data").combine_chunks()
            out = []
            for k, others in _near(t, floor, bits, labels):
                mine = np.frombuffer(data[k].as_buffer(), U64)
                for o in others.tolist():
                    if labels[o] != labels[k] and linked(mine, np.frombuffer(data[o].as_buffer(), U64), percent):
                        out.append((nodes[k], nodes[o]))
                        labels[labels == labels[o]] = labels[k]
            if out:
                u, v = np.array(out).T
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    members = members.select(*[x.split()[0] for x in _MEMBER.split(", ")], "data")
    return members.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(run, "u long, v long")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), percent: int = PERCENT, words: int = WORDS, recall: float = RECALL, hashes: int = HASHES, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """`keep` columns of every row with n_shingles, component_id (the least id that links reach) and kept (the row's id is that)."""
    if hashes % 64:
        raise ValueError("hashes fill words of 64 bits")
    bounded_batches(docs.sparkSession)
    bands, floor = min(bands_for(percent / 100, recall), hashes // ROWS), floor_of(percent / 100, hashes, bits)
    kept = tuple(c for c in keep if c not in RESULT)
    base = stored(signatures(docs, doc_id, text, kept, words, bands, hashes, bits), "bbit-signatures")
    nodes = base.filter("node is not null").groupBy("node").agg(F.min("__id").alias("id"), F.max(F.struct("bands", "signature")).alias("s"))
    nodes = stored(nodes.select("node", "id", "s.bands", "s.signature"), "bbit-nodes")

    each = nodes.select(F.explode("bands").alias("path"), "node")
    shared = each.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    buckets = stored(each.join(shared, "path"), "bbit-buckets")
    links = stored(star_links(buckets, nodes, docs, text, words, percent, floor, hashes, bits), "bbit-links")
    joined = stored(components(links), "bbit-classes")

    classed = buckets.join(joined, "node", "left").select("path", "node", "n", F.coalesce("component", "node").alias("class"))
    mixed = classed.groupBy("path").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a != b").select("path")
    left = stored(classed.join(mixed, "path", "left_semi"), "bbit-left")
    if not left.isEmpty():
        signed = nodes.select("node", "signature")
        met = stored(meetings(_blocks(left.join(signed, "node"), block), floor, bits), "bbit-meetings")
        sets = sets_of(docs, text, words, met.select("node").distinct())
        more = stored(block_links(met.join(sets, "node"), percent, floor, bits), "bbit-more-links")
        joined = components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    of_class = joined.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("class_id"))
    named = nodes.select("node", "id").join(joined.join(of_class, "component").select("node", "class_id"), "node", "left").select(F.col("node").alias("__node"), F.coalesce("class_id", "id").alias("class_id"))
    # rows without a set have no node, and stay out of the join
    rows = base.filter("node is not null").join(named, F.col("node") == F.col("__node")).withColumn("component_id", F.col("class_id"))
    rows = rows.select(*base.columns, "component_id").unionByName(base.filter("node is null").withColumn("component_id", F.col("__id")))
    return rows.select(*[F.col(f"__keep{k}").alias(c) for k, c in enumerate(kept)], "n_shingles", "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate class."""
    return dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
-- sets that are equal are one node, by their sorted shingles
sets AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list(s ORDER BY s)) AS node FROM shingles GROUP BY doc_id),
single AS (SELECT doc_id AS node, s, n FROM shingles JOIN sizes USING (doc_id) JOIN sets USING (doc_id) WHERE doc_id = node),
links AS (
  SELECT a.node AS u, b.node AS v FROM single a JOIN single b ON a.s = b.s AND a.node <> b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (SELECT u AS node, u AS other FROM links UNION SELECT node, v FROM reached JOIN links ON other = u),
least_of AS (SELECT node, min(other) AS least FROM reached GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, node, doc_id) AS component_id, doc_id = coalesce(least, node, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN least_of USING (node)
"""
