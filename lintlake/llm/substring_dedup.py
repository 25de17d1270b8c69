"""Substring dedup over sliding spans of sentences.

Texts are cut into sentences: after a word that ends in . ! or ?, and at line breaks. Long sentences are cut on at
words with the least hash of all words of the sentence up to `NEAR` away (and after `LONG` words without
one), so that a passage lines up wherever it is pasted, also in mid-sentence, and equal sentences are cut alike. Every
run of `SENTENCES` consecutive sentences is hashed, without regard to case and white space. A hash that comes
twice in the corpus is a repeated span; its first place, by document id and then position, stays, and every
sentence that any other place covers is removed with the white space after it.

The first scan shuffles 64-bit hashes only, counted map-side. The second one re-reads the texts and emits
places only of spans that a bitmap lets through (sized by the count of repeated hashes, up to `MOST_BITS`; what
collides is a span with one place, which is its first). First places are found in two steps, first among
shares of documents, so that a span which a third of all documents hold is dealt over many tasks; and places
meet their hash's first one by hash and share.

Null texts stay null and texts without words stay as they are; both have no sentences. Runs shorter than
`SENTENCES` sentences are never removed. Rows that agree in id and text count as one document. Equal ids with
different texts are told apart by a hash of the text; null ids come first. The columns n_sentences, n_removed and
removed_spans of the result replace columns of those names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import U64, _power_tables, mix, pieces, bounded_batches, span_hashes, stored, table, utf8, word_spans

SENTENCES = 3
NEAR = 3
LONG = 24
#: Least and most bits of the map of repeated hashes (up to 16 MB), and places that a share of documents has about.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
SHARE = 20_000
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


@dataclass
class Sentences:
    """Sentences of some rows: byte starts, numbers of words before (n+1), sentences before each row, word hashes."""

    starts: np.ndarray
    words: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray


def sentences(buf: np.ndarray, off: np.ndarray) -> Sentences:
    starts, ends, before = word_spans(buf, off)
    n = len(starts)
    if not n:
        return Sentences(starts, np.zeros(1, np.int64), np.zeros(len(off), np.int64), np.zeros(0, U64))
    h = span_hashes(buf, starts, ends)
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    last = _ENDS[buf[ends - 1]]
    last[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    edge = before[1:]
    last[edge[edge > 0] - 1] = True
    of = np.cumsum(last) - last
    least = np.ones(n, bool)
    for k in range(1, NEAR + 1):
        apart = of[k:] != of[:-k]
        least[k:] &= apart | (h[k:] < h[:-k])
        least[:-k] &= apart | (h[:-k] <= h[k:])
    last |= least
    since = np.arange(n) - np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]).repeat(np.diff(np.concatenate([[0], np.flatnonzero(last) + 1])))
    last |= since % LONG == LONG - 1
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    return Sentences(starts[first], np.concatenate([first, [n]]), np.searchsorted(first, before), h)


def spans(s: Sentences) -> tuple[np.ndarray, np.ndarray]:
    """All runs of SENTENCES sentences, as the first one of each and a hash."""
    a = np.arange(max(len(s.starts) - SENTENCES + 1, 0))
    row = np.searchsorted(s.rows, a, side="right") - 1
    a = a[a + SENTENCES <= s.rows[row + 1]]
    up, down = _power_tables(len(s.hashes) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(s.hashes * up[: len(s.hashes)])])
    i, j = s.words[a], s.words[a + SENTENCES]
    return a, mix((sums[j] - sums[i]) * down[i] + (j - i).astype(U64))


def _count(docs: DataFrame) -> DataFrame:
    """(hash, n) of the spans that come twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = utf8(b.column(0))
            for x, y in pieces(off):
                _, h = spans(sentences(buf[off[x] : off[y]], off[x : y + 1] - off[x]))
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["hash", "n"])

    return docs.select("__t").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits of all hashes, in bytes; about eight bits for each hash, but MOST_BITS at the most."""
    bits = min(max(LEAST_BITS, 1 << (8 * hashes.count()).bit_length()), MOST_BITS)
    at = hashes.select(F.pmod("hash", F.lit(bits).cast("long")).alias("at"))
    rows = at.selectExpr("cast(at div 64 as int) AS w", "shiftleft(1L, cast(at % 64 as int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


def _places(docs: DataFrame, repeated: DataFrame, id_type: T.DataType) -> DataFrame:
    """(hash, __id, __key, a): places of the spans whose bit is set."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(repeated))
    schema = T.StructType().add("hash", "long").add("__id", id_type).add("__key", "long").add("a", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = bits.value
        for b in batches:
            buf, off = utf8(b.column(2))
            for x, y in pieces(off):
                s = sentences(buf[off[x] : off[y]], off[x : y + 1] - off[x])
                a, h = spans(s)
                at = np.mod(h.view(np.int64), len(mask) * 8)
                hit = ((mask[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                a, h = a[hit], h[hit]
                if len(a):
                    row = np.searchsorted(s.rows, a, side="right") - 1
                    take = pa.array(x + row)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array((a - s.rows[row]).astype(np.int32))], names=schema.names)

    return docs.select("__id", "__key", "__t").mapInArrow(run, schema)


def _later(places: DataFrame) -> DataFrame:
    """(__id, __key, __first): documents with the sentences where spans start that have an earlier place."""
    shares = max(1, places.count() // SHARE)
    dealt = places.withColumn("share", F.pmod(F.xxhash64("__id", "__key"), F.lit(shares)))
    order = F.struct(F.col("__id").isNotNull().alias("some"), "__id", "__key", "a")
    own = stored(dealt.groupBy("hash", "share").agg(F.min(order).alias("own")), "shares")
    first = own.groupBy("hash").agg(F.min("own").alias("first"), F.count("*").alias("n"))
    first = stored(own.join(first, "hash").select("hash", "share", "first"), "firsts")
    met = dealt.join(first, ["hash", "share"])
    same = F.col("__id").eqNullSafe(F.col("first.__id")) & (F.col("__key") == F.col("first.__key")) & (F.col("a") == F.col("first.a"))
    return met.filter(~same).groupBy("__id", "__key").agg(F.collect_set("a").alias("__first"))


def cover(n: int, first: list[int]) -> np.ndarray:
    """True for the sentences in spans that start at the given ones."""
    out = np.zeros(n + SENTENCES, bool)
    for k in range(SENTENCES):
        out[np.asarray(first, np.int64) + k] = True
    return out[:n]


def _remove(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`keep` columns with the text without its covered sentences, and what was removed."""
    schema = T.StructType([df.schema[c] for c in keep]).add(text, "string").add("n_sentences", "long").add("n_removed", "long").add("removed_spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(b.num_columns - 2)
            later = b.column(b.num_columns - 1).to_pylist()
            buf, off = utf8(raw)
            texts, total, gone, where = [], [], [], []
            for x, y in pieces(off):
                part, cut = buf[off[x] : off[y]], off[x : y + 1] - off[x]
                s = sentences(part, cut)
                for k in range(y - x):
                    first, n = s.rows[k], int(s.rows[k + 1] - s.rows[k])
                    total.append(n)
                    if not later[x + k]:
                        texts.append(raw[x + k].as_py())
                        gone.append(0)
                        where.append("")
                        continue
                    covered = cover(n, later[x + k])
                    edges = np.concatenate([s.starts[first : first + n], [cut[k + 1]]])
                    kept = [part[cut[k] : edges[0]].tobytes()] + [part[edges[i] : edges[i + 1]].tobytes() for i in np.flatnonzero(~covered)]
                    texts.append(b"".join(kept).decode("utf-8", "replace"))
                    gone.append(int(covered.sum()))
                    change = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                    at = [len(part[cut[k] : edges[i]].tobytes().decode("utf-8", "replace")) for i in change]
                    where.append(",".join(f"{p}:{q}" for p, q in zip(at[::2], at[1::2], strict=True)))
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(where, pa.string())], names=schema.names)

    return df.select(*keep, text, "__first").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs`, `text` without repeated sentences, n_sentences, n_removed, and removed_spans
    (start:end of removed stretches in code points of the old text, end exclusive, comma-joined)."""
    bounded_batches(docs.sparkSession)
    own = docs.withColumns({"__id": F.col(doc_id), "__key": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    slim = own.select("__id", "__key", F.col(text).alias("__t"))
    repeated = stored(_count(slim).select("hash"), "repeated")
    places = stored(_places(slim, repeated, docs.schema[doc_id].dataType), "places")
    later = _later(places).withColumnsRenamed({"__id": "__pid", "__key": "__pkey"})
    marked = own.join(later, F.col("__id").eqNullSafe(F.col("__pid")) & (F.col("__key") == F.col("__pkey")), "left")
    keep = [c for c in docs.columns if c not in (text, "n_sentences", "n_removed", "removed_spans")]
    return _remove(marked, text, keep)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat an earlier place."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
