"""Quality rules on n-gram perplexity.

A text is read as its UTF-8 bytes, with ORDER - 1 spaces before it. Spark counts all n-grams of the whole corpus by
language and makes a modified Kneser-Ney model of them with joins on contexts and suffixes: the counts grow with
what the corpus holds and are nowhere in one place. The model is stored in buckets, each with the sorted hashes of its
n-grams, their interpolated log probabilities, and their backoff weights as contexts.

Documents are dealt into parts of about `PART` bytes by a hash of what they hold, and worked off in `ROUNDS` rounds so that
only a part of the texts is on its way at once. (Rows that agree in the text and all columns kept share a part.) A part asks for its distinct n-grams only (a few hundredths of its bytes); buckets
hold one row of arrays, search it for one ask after the other, and answer in the order asked; then each byte's
probability is evaluated recursively: that of the longest n-gram stored, after the backoff weights of the longer
contexts; that is done once for each distinct n-gram of a stretch. Texts are read in stretches of `STRETCH` bytes, a long one by itself with the bytes before each stretch, so
what a task holds besides the texts of a part does not grow with them.

A text has two perplexities, that of a byte and that of a word (all of the text's probability, by words): marks glued
to words are cheap by the byte, but dear by the word. Both scatter less the longer a text is, so each language has its own
lower and upper band of each for each class of lengths (powers of two of bytes; classes of under `ENOUGH` texts
look at their neighbours too): the median less `WIDTH` times its distance from the lower quartile, and plus `WIDTH`
times that from the upper one, each side by its own spread. Texts outside either band are rejected, as are those that
fail the base rules: under 50 words, or over half of the words in 3-word windows that come twice or more.

Quartiles are taken from histograms of at most `BINS` x `SPAN` bins a language and class: perplexities beyond 10^SPAN
share the last bin.

Null texts have no words and fail. Null languages share one model. Rows are judged one by one, so repeated
ids are no matter. Of clashing names the result's own win. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import U64, bounded_batches, discard, grouped, mix, pack, pack_sorted, pieces, release, span_hashes, stored, table, unpack, unpack_sorted, utf8, word_spans

ORDER = 5
SIZE = 256
WIDTH = 4.5
#: Bytes of a part, rounds, and n-grams in a bucket of the model; a bucket is asked by so many parts' worth of n-grams.
PART = 2 << 20
STRETCH = 1 << 20
#: Bytes whose n-grams are added up before they are sent, and whose base figures are taken at once.
COUNT = 2 << 20
FIGURES = 1 << 18
ROUNDS = 4
BUCKET = 1_000_000
ASKING = 24
#: Bytes of answers that leave together.
ANSWER = 4 << 20
#: Languages up to which their discounts are broadcast (a row of about 50 bytes each); beyond it they are joined.
MOST_LANGUAGES = 50_000
#: Cells of a table that numbers n-grams; beyond that they are hashed and sorted.
CELLS = 1 << 16
#: The least spread of a side (in log10 perplexity), and of texts to take it from.
LEAST = 0.001
ENOUGH = 30
BINS = 4000  # of one unit of log10 perplexity
SPAN = 10
MIN_WORDS, MAX_REPEAT = 50, 50


# ------------------------------------------------------------------ n-grams of some texts


def padded(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of rows with ORDER - 1 spaces before each, where the rows' own bytes stand, and where the spaces begin."""
    size = np.diff(off)
    at = np.arange(len(buf)) + np.repeat(np.arange(1, len(size) + 1) * (ORDER - 1), size)
    out = np.full(len(buf) + len(size) * (ORDER - 1), 32, np.uint8)
    out[at] = buf
    return out, at, off[:-1] + np.arange(len(size)) * (ORDER - 1)


def windows(text: np.ndarray) -> np.ndarray:
    """The codes of the ORDER bytes that end at each byte, first one highest; before the first byte stand zeros."""
    raw = np.concatenate([np.zeros(ORDER - 1, np.uint8), text, np.zeros(8 - ORDER, np.uint8)])
    # eight bytes from each byte on, of which the first ORDER count
    return (np.ndarray(len(text), ">u8", raw.data, strides=(1,)).astype(U64) >> U64(8 * (8 - ORDER))).astype(np.int64)


def numbered(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes (each below `most`), and the number of each given one among them."""
    if most <= CELLS:
        kept = np.flatnonzero(np.bincount(codes, minlength=1))
        number = np.zeros(most, np.int32)
        number[kept] = np.arange(len(kept))
        return kept, number[codes]
    d = pa.array(codes).dictionary_encode()  # by hashing, which is quicker than sorting all
    kept = d.dictionary.to_numpy()
    order = np.argsort(kept)
    rank = np.empty(len(kept), np.int32)
    rank[order] = np.arange(len(kept), dtype=np.int32)
    return kept[order], rank[d.indices.to_numpy()]


@dataclass
class Grams:
    """Numbered n-grams of each length: the sorted codes (bytes, first one highest), and which of the next shorter ones each ends in.

    Only the longest are read off the bytes (`last`: their numbers there); shorter ones are what those end in. Before
    the first byte of all, and of what starts anew, zeros stand, so that what is numbered does not depend on the order of rows.
    """

    codes: list[np.ndarray]
    suffix: list[np.ndarray]
    last: np.ndarray

    @classmethod
    def read(cls, text: np.ndarray, starts: np.ndarray) -> Grams:
        """starts: where texts begin."""
        own = windows(text)
        for k in range(ORDER - 1):
            at = starts[starts + k < len(text)] + k
            own[at] &= SIZE ** (k + 1) - 1
        codes, last = numbered(own, SIZE**ORDER)
        found, suffix = [codes], []
        for n in range(ORDER - 1, -1, -1):
            kept, of = numbered(found[-1] % SIZE**n, SIZE**n)
            found.append(kept)
            suffix.append(of)
        return cls(found[::-1], [np.zeros(0, np.int32), *suffix[::-1]], last)

    @property
    def at(self) -> list[np.ndarray]:
        """For each length the numbers at the bytes."""
        out = [self.last]
        for n in range(ORDER, 0, -1):
            out.append(self.suffix[n][out[-1]])
        return out[::-1]

    def contexts(self, n: int, of: np.ndarray) -> np.ndarray:
        """The numbers of what stands before the last byte of these n-grams (any number, where that is at no byte)."""
        return np.minimum(np.searchsorted(self.codes[n - 1], self.codes[n][of] // SIZE), len(self.codes[n - 1]) - 1)


def _lang(lang: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit(""))


def gram_hashes(lang: str, n: int, codes: np.ndarray) -> np.ndarray:
    """Hashes of n-grams of a language."""
    raw = np.frombuffer(lang.encode(), np.uint8)
    own = span_hashes(raw, np.array([0]), np.array([len(raw)]), folded=False)[0] if len(raw) else U64(0)
    return mix(mix(codes.astype(U64) * U64(8) + U64(n)) + own)


# ------------------------------------------------------------------ the model


def count_ngrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, code, n): all n-grams of ORDER bytes of all texts; each task adds up before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        release()

        def sent() -> Iterator[pa.RecordBatch]:
            for k, texts in held.items():
                starts = np.cumsum([0, *map(len, texts)])[:-1]
                ends = np.concatenate([np.arange(ORDER - 1, len(t)) + a for t, a in zip(texts, starts, strict=True)])
                found = pa.array(windows(np.concatenate(texts))[ends]).value_counts()
                for i in range(0, len(found), 100_000):
                    own = found.slice(i, 100_000).flatten()
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(own[0]), pa.string()), *own], names=["lang", "code", "n"])
            held.clear()

        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            for k in dict.fromkeys(langs):
                own = pa.array(np.flatnonzero(langs == k))
                for t in _texts(b.column(1).take(own)):
                    held.setdefault(k, []).append(t)
                    size += len(t)
            if size >= COUNT:
                yield from sent()
                size = 0
        yield from sent()
        release()

    each = docs.select(_lang(lang).alias("lang"), F.col(text).alias("__text")).mapInArrow(run, "lang string, code long, n long")
    return each.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Texts, each by itself with the ORDER - 1 bytes before it (spaces at its start), long ones in stretches; empty ones are left out."""
    buf, off = utf8(column)
    for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        for k in range(a, z, STRETCH):
            yield np.concatenate([_before(buf, a, k), buf[k : min(k + STRETCH, z)]])


def _before(buf: np.ndarray, start: int, at: int) -> np.ndarray:
    return np.full(ORDER - 1, 32, np.uint8) if at == start else buf[at - ORDER + 1 : at]


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts about STRETCH bytes at a time: padded bytes, where the texts' own bytes stand, where padding begins, rows and their sizes here."""
    buf, off = utf8(texts)
    for x, y in pieces(off, STRETCH):
        a, z = int(off[x]), int(off[y])
        if z - a <= STRETCH:
            text, own, starts = padded(buf[a:z], off[x : y + 1] - a)
            yield text, own, starts, np.arange(x, y), np.diff(off[x : y + 1])
            continue
        for k in range(a, z, STRETCH):  # one long text
            here = buf[k : min(k + STRETCH, z)]
            yield np.concatenate([_before(buf, a, k), here]), np.arange(ORDER - 1, ORDER - 1 + len(here)), np.zeros(1, np.int64), np.array([x]), np.array([len(here)])


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of modified Kneser-Ney from counts of counts; half the count where they do not tell."""
    few = counts.groupBy("lang").agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    n = [None, *[F.col(f"n{k}") for k in (1, 2, 3, 4)]]
    y = F.when((n[1] > 0) & (n[2] > 0), n[1] / (n[1] + 2 * n[2])).otherwise(0.5)
    d = [F.least(F.greatest(F.when((n[k] > 0) & (n[k + 1] > 0), k - (k + 1) * y * n[k + 1] / n[k]).otherwise(0.5 * k), F.lit(0.1 * k)), F.lit(0.9 * k)) for k in (1, 2, 3)]
    return few.select("lang", *[x.alias(f"d{k}") for k, x in enumerate(d, 1)])


def kneser_ney(counted: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n, code, p, back), and the stored tables that it reads: interpolated probabilities of n-grams, and their backoff weights as contexts.

    n = 0 stands for the empty context. Lower orders count the different bytes before an n-gram. A context has
    at most SIZE n-grams, and as many have a common suffix, so no key of the joins is hot.
    """
    counts = {ORDER: counted.withColumnRenamed("n", "c")}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = stored(counts[n + 1].groupBy("lang", (F.col("code") % SIZE**n).alias("code")).agg(F.count("*").alias("c")), f"continuations-{n}")
    # discounts are one row a language: broadcast where that is checked to be little, for a language may have most rows
    few = counts[1].select("lang").distinct().count() <= MOST_LANGUAGES
    lower = counts[1].select("lang").distinct().select("lang", F.lit(0).cast("long").alias("suffix"), F.lit(1 / SIZE).alias("lower"))
    parts, contexts = [lower.select("lang", F.lit(0).alias("n"), F.col("suffix").alias("code"), F.col("lower").alias("p"))], []
    for n in range(1, ORDER + 1):
        c = F.col("c")
        cut = F.when(c >= 3, F.col("d3")).when(c == 2, F.col("d2")).otherwise(F.col("d1"))
        own = counts[n].join(F.broadcast(_discounts(counts[n])) if few else _discounts(counts[n]), "lang").select("lang", "code", "c", cut.alias("cut"), F.expr(f"code div {SIZE}").alias("context"), (F.col("code") % SIZE ** (n - 1)).alias("suffix"))
        around = own.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("cut").alias("held")).select("lang", "context", "total", (F.col("held") / F.col("total")).alias("back"))
        p = own.join(around, ["lang", "context"]).join(lower, ["lang", "suffix"]).select("lang", F.lit(n).alias("n"), "code", ((c - F.col("cut")) / F.col("total") + F.col("back") * F.col("lower")).alias("p"))
        p = stored(p, f"kneser-ney-{n}")
        parts.append(p)
        contexts.append(around.select("lang", F.lit(n - 1).alias("n"), F.col("context").alias("code"), "back"))
        lower = p.select("lang", F.col("code").alias("suffix"), F.col("p").alias("lower"))
    grams, backs = parts[0], contexts[0]
    for a in parts[1:]:
        grams = grams.unionByName(a)
    for a in contexts[1:]:
        backs = backs.unionByName(a)
    return grams.join(backs, ["lang", "n", "code"], "full"), [*[counts[n] for n in range(1, ORDER)], *parts[1:]]


def _parts(docs: DataFrame, text: str) -> int:
    return max(1, math.ceil(int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) / PART))


@dataclass
class Model:
    """Rows (bucket `dest`; sorted hashes, log10 probabilities and log10 backoff weights as arrays) and their number of buckets."""

    rows: DataFrame
    buckets: int

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
        counted = stored(count_ngrams(docs, text, lang), "ngrams")
        smoothed, read = kneser_ney(counted)
        grams = stored(smoothed, "grams")
        discard(counted, *read)
        buckets = max(1, math.ceil(grams.count() / BUCKET), _parts(docs, text) // ASKING)

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                langs, n, code = np.array(b.column("lang").to_pylist(), dtype=object), b.column("n").to_numpy(), b.column("code").to_numpy()
                h = np.zeros(len(n), U64)
                for k in dict.fromkeys(langs):
                    for m in np.unique(n[langs == k]).tolist():
                        own = (langs == k) & (n == m)
                        h[own] = gram_hashes(k, m, code[own])
                yield pa.RecordBatch.from_arrays([pa.array(_bucket_of(h, buckets)), pa.array(h.view(np.int64)), *[b.column(c) for c in ("p", "back")]], names=["dest", "h", "p", "back"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in grouped(batches, 1):
                h, p, back = (t.column(c).to_numpy() for c in ("h", "p", "back"))
                order = np.argsort(h.view(U64))
                with np.errstate(invalid="ignore", divide="ignore"):
                    cells = [pack_sorted(h.view(U64)[order]), *[np.log10(x.astype(float))[order].astype(np.float32).tobytes() for x in (p, back)]]
                yield from _rows([(t.column("dest")[0].as_py(), -1, *cells)]).to_batches()
                release()

        flat = grams.select("lang", "n", "code", "p", "back").mapInArrow(hashed, "dest long, h long, p double, back double")
        rows = stored(flat.repartition("dest").sortWithinPartitions("dest").mapInArrow(packed, _ROW), "sorted-arrays")
        discard(grams)
        return cls(rows, buckets)


_ROW = "dest long, part long, a binary, b binary, c binary"


def _rows(rows: list[tuple]) -> pa.Table:
    """Rows of a bucket, a part and three cells."""
    kinds = {"dest": pa.int64(), "part": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets have equal ranges of hashes."""
    bounds = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=U64)
    return np.searchsorted(bounds, h, side="right").astype(np.int64)


def search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether the wanted values stand there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


# ------------------------------------------------------------------ scores


def base_figures(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    rows = len(off) - 1
    starts, ends, before = word_spans(buf, off)
    n_words = np.diff(before)
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    sums = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
    symbols = np.concatenate([[0], np.cumsum(_MARKS[buf])])
    # lines: from after one break, or the row's start, to the next break or the row's end
    breaks = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate([off[:-1], breaks + 1]))
    begin = begin[begin < len(buf)]
    end = np.minimum(np.concatenate([breaks, [len(buf)]])[np.searchsorted(breaks, begin)], off[1:][np.searchsorted(off[1:], begin, side="right")]) if len(begin) else begin
    has = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[has], end[has]
    row = np.searchsorted(off, begin, side="right") - 1
    dup = _later(span_hashes(buf, begin, end, folded=False), row)
    # windows of three words
    h = span_hashes(buf, starts, ends, folded=False)
    owner = np.repeat(np.arange(rows), n_words)
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        w = mix(h[:-2] + mix(h[1:-1] + mix(h[2:])))
        ok = owner[:-2] == owner[2:]
        at = np.flatnonzero(ok)
        twice = at[_shared(w[at], owner[at])]
        for k in range(3):
            covered[twice + k] = True
    return [n_words, sums[before[1:]] - sums[before[:-1]], symbols[off[1:]] - symbols[off[:-1]], np.bincount(row[dup], minlength=rows), np.bincount(owner[covered], minlength=rows)]


_MARKS = np.zeros(256, bool)
_MARKS[list(b"#*$%&|<>")] = True


def _groups(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by (row, key), and where a new pair begins."""
    both = mix(key ^ mix(row.astype(U64) + U64(1)))
    order = np.argsort(both, kind="stable")
    return order, np.concatenate([[True], both[order][1:] != both[order][:-1]]) if len(order) else np.zeros(0, bool)


def _later(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True where the key came before in the row."""
    order, new = _groups(key, row)
    out = np.zeros(len(key), bool)
    out[order] = ~new
    return out


def _shared(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True where the key comes twice or more in the row."""
    order, new = _groups(key, row)
    out = np.zeros(len(key), bool)
    if len(order):
        size = np.bincount(np.cumsum(new) - 1)
        out[order] = np.repeat(size, size) > 1
    return out


def asked(langs: list[str], texts: pa.Array) -> np.ndarray:
    """Sorted distinct hashes of all n-grams of some texts."""
    found = [np.zeros(0, U64)]
    for k, _, g, *_ in _grams(langs, texts):
        found += [gram_hashes(k, n, g.codes[n]) for n in range(ORDER + 1)]
    h = np.sort(np.concatenate(found))
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _grams(langs: list[str], texts: pa.Array) -> Iterator[tuple[str, np.ndarray, Grams, np.ndarray, np.ndarray]]:
    """Language by language and stretch by stretch: the language, the rows, their n-grams, where their bytes stand, their sizes."""
    all_ = np.array(langs, dtype=object)
    for k in sorted(set(langs)):
        rows = np.flatnonzero(all_ == k)
        for text, own, starts, at, sizes in chunks(texts.take(pa.array(rows))):
            yield k, rows[at], Grams.read(text, starts), own, sizes


def log10_of(langs: list[str], texts: pa.Array, asks: np.ndarray, logs: np.ndarray, backs: np.ndarray) -> np.ndarray:
    """The sum of log10 probabilities of each text, from what is known of the asked hashes (NaN where nothing is)."""
    out = np.zeros(len(langs))
    for k, rows, g, own, sizes in _grams(langs, texts):
        p = None
        for n in range(ORDER + 1):
            here = np.searchsorted(asks, gram_hashes(k, n, g.codes[n]))
            found = logs[here]
            if p is not None:
                missing = np.flatnonzero(np.isnan(found))
                found[missing] = p[g.suffix[n][missing]] + back[g.contexts(n, missing)]
            p, back = found, np.nan_to_num(backs[here])
        sums = np.concatenate([[0.0], np.cumsum(np.nan_to_num(p, nan=-math.log10(SIZE))[g.last[own]])])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        out[rows] += sums[cuts[1:]] - sums[cuts[:-1]]  # a long text comes stretch by stretch
    return out


#: What `judge` adds to the base figures.
RESULT = ("log_ppl", "word_ppl", "base_failed", "ppl_low", "ppl_high", "word_low", "word_high", "kept")


def perplexities(docs: DataFrame, model: Model, text: str, lang: str, keep: tuple[str, ...]) -> DataFrame:
    """`keep` columns with the base figures, __lang, __class (of length), log_ppl and word_ppl (log10 perplexities of a byte and of a word; null without)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in keep if c not in (*names, *RESULT)]
    schema = docs.select(*kept).schema
    for n in names:
        schema = schema.add(n, "long")
    schema = schema.add("__lang", "string").add("__class", "long").add("log_ppl", "double").add("word_ppl", "double")
    parts, buckets = _parts(docs, text), model.buckets
    # by what a row holds, so that asking and scoring deal it alike however the table is read; a text travels once
    hashed = [f.name for f in docs.schema if f.name in (text, lang, *kept) and "map<" not in f.dataType.simpleString()]
    part = F.pmod(F.xxhash64(*hashed), F.lit(parts))
    dealt = docs.select(part.alias("__part"), _lang(lang).alias("__key"), F.col(text).alias("__text"), *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(kept) if c != text])

    def ask(t: pa.Table) -> pa.Table:
        h = asked(t.column("__key").to_pylist(), t.column("__text").combine_chunks())
        edge = np.searchsorted(_bucket_of(h, buckets), np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(edge)).tolist()
        release()
        return _rows([(k, t.column("__part")[0].as_py(), pack_sorted(h[edge[k] : edge[k + 1]]), b"", b"") for k in some])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket, the model's first; answers leave some megabytes at a time."""
        at, keys, known = -1, np.zeros(0, U64), [np.zeros(0, np.float32)] * 2
        out, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                dest, part, a, b, c = (batch.column(x)[k].as_py() for x in range(5))
                if dest != at:
                    at, keys, known = dest, np.zeros(0, U64), [np.zeros(0, np.float32)] * 2
                if part < 0:
                    keys, known = unpack_sorted(a), [np.frombuffer(x, np.float32) for x in (b, c)]
                    continue
                place, found = search(keys, unpack_sorted(a))
                told = [np.where(found, x[place], np.float32(np.nan)) if len(keys) else np.full(len(place), np.nan, np.float32) for x in known]
                out.append((dest, part, *[pack(x.astype(np.float32).view(np.uint32)) for x in told], b""))
                size += len(out[-1][2]) + len(out[-1][3])
                if size > ANSWER:
                    yield from _rows(out).to_batches()
                    out, size = [], 0
        if out:
            yield from _rows(out).to_batches()
        release()

    def score(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return pa.Table.from_batches([], schema=arrow)
        texts, keys = docs_.column("__text").combine_chunks(), docs_.column("__key").to_pylist()
        asks = asked(keys, texts)
        cells = sorted(zip(*[answers.column(x).to_pylist() for x in ("dest", "a", "b")], strict=True))
        logs, backs = (np.concatenate([unpack(c[k]).astype(np.uint32).view(np.float32) for c in cells]).astype(float) for k in (1, 2))
        total = log10_of(keys, texts, asks, logs, backs)
        del asks, logs, backs, cells
        release()
        buf, off = utf8(texts)
        figures: list[list[np.ndarray]] = [[] for _ in names]
        for x, y in pieces(off, FIGURES):
            for out, got in zip(figures, base_figures(buf[off[x] : off[y]], off[x : y + 1] - off[x]), strict=True):
                out.append(got)
        n = np.diff(off)
        ppl = pa.array(-total / np.maximum(n, 1), pa.float64(), mask=n == 0)
        cols = [pa.array(np.concatenate(v), pa.int64()) for v in figures]
        words = np.concatenate(figures[0]) if figures[0] else n
        by_word = pa.array(-total / np.maximum(words, 1), pa.float64(), mask=words == 0)
        kind = pa.array(np.log2(np.maximum(n, 1)).astype(np.int64))
        return pa.Table.from_arrays([*[docs_.column("__text" if c == text else f"__keep{i}") for i, c in enumerate(kept)], *cols, docs_.column("__key"), kind, ppl, by_word], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType(schema.fields))
    out = None
    for k in range(ROUNDS):
        rows = dealt.filter(F.col("__part") % ROUNDS == k).repartition(max(1, math.ceil(parts / ROUNDS)), "__part")
        asks = rows.groupBy("__part").applyInArrow(ask, _ROW).unionByName(model.rows)
        told = asks.repartition("dest").sortWithinPartitions("dest", "part").mapInArrow(answer, _ROW).withColumnRenamed("part", "__part")
        got = stored(rows.groupBy("__part").cogroup(told.groupBy("__part")).applyInArrow(score, schema), "perplexity")
        out = got if out is None else out.unionByName(got)
    return out


def _reach(sizes: DataFrame) -> DataFrame:
    """(__lang, __class, lo, hi): the classes of length whose texts a class looks at, itself and as few neighbours as make ENOUGH."""

    def run(t: pa.Table) -> pa.Table:
        kind, n = t.column("__class").to_numpy(), t.column("n").to_numpy()
        far = np.abs(kind[:, None] - kind[None, :])
        reach = [next((d for d in range(int(own.max())) if n[own <= d].sum() >= ENOUGH), own.max()) for own in far]
        return pa.table([t.column("__lang"), t.column("__class"), pa.array(kind - reach), pa.array(kind + reach)], names=["__lang", "__class", "lo", "hi"])

    return sizes.groupBy("__lang").applyInArrow(run, "__lang string, __class long, lo long, hi long")


def bands(scored: DataFrame, width: float = WIDTH, of: str = "log_ppl", low: str = "low", high: str = "high") -> DataFrame:
    """(__lang, __class, low, high): the bands of a log perplexity, from histograms with bins of 1 / BINS up to SPAN."""
    bins = F.least(F.floor(F.col(of) * BINS), F.lit(BINS * SPAN)).alias("bin")
    counted = stored(scored.filter(F.col(of).isNotNull() & ~F.col("base_failed")).groupBy("__lang", "__class", bins).agg(F.count("*").alias("n")), "bins")
    reach = _reach(counted.groupBy("__lang", "__class").agg(F.sum("n").alias("n")))
    # a class has at most 64 neighbours, and a pair of a language and a class BINS x SPAN bins
    near = counted.withColumnRenamed("__class", "__of").join(reach.select("__lang", F.explode(F.sequence("lo", "hi")).alias("__of"), "__class"), ["__lang", "__of"])
    spread = near.groupBy("__lang", "__class", "bin").agg(F.sum("n").alias("n"))
    up_to, all_ = Window.partitionBy("__lang", "__class").orderBy("bin"), Window.partitionBy("__lang", "__class")
    spread = spread.withColumns({"sum": F.sum("n").over(up_to), "total": F.sum("n").over(all_)})
    quartile = lambda q: F.min(F.when(F.col("sum") >= q * F.col("total"), F.col("bin"))) / BINS
    found = spread.groupBy("__lang", "__class").agg(*[quartile(q).alias(c) for q, c in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])
    side = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(LEAST)) * width
    return found.select("__lang", "__class", (F.col("q2") - side("q2", "q1")).alias(low), (F.col("q2") + side("q3", "q2")).alias(high))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",), width: float = WIDTH, model: Model | None = None) -> DataFrame:
    """`keep` columns, the base figures, base_failed, log_ppl, the bands, and kept; by the given model, or one of `docs`."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scored = perplexities(docs, model or Model.fit(docs, text, lang), text, lang, keep)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    for of, low, high in (("log_ppl", "ppl_low", "ppl_high"), ("word_ppl", "word_low", "word_high")):
        band = stored(bands(scored, width, of, low, high), "bands")
        few = band.count() <= MOST_LANGUAGES  # rows of about 50 bytes
        scored = scored.join(F.broadcast(band) if few else band, ["__lang", "__class"], "left").select(*scored.columns, low, high)
    inside = [F.coalesce(F.col(of).between(F.col(low), F.col(high)), F.lit(True)) for of, low, high in (("log_ppl", "ppl_low", "ppl_high"), ("word_ppl", "word_low", "word_high"))]
    return scored.withColumn("kept", ~F.col("base_failed") & inside[0] & inside[1]).drop("__lang", "__class")


def op4_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return judge(table(spark, sf_dir, "documents"))
