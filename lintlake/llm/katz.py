"""Language-model scores by Katz backoff over word n-grams (of order `ORDER`, or any other from 2).

A text is its words (A-Z read as a-z) and one end token; the first tokens follow start marks. The model is
learnt from all training rows: n-gram counts of every order, discounted after Good and Turing up to a count of
`CUT`, and backoff weights that make every context's probabilities sum to exactly one over the vocabulary
and one class of unknown words. A token's probability is evaluated recursively: its discounted share of the
context where the n-gram is kept, else the context's backoff weight times the probability of the next lower
order, down to the unigrams and the class of unknown words. N-grams of order 3 and up are counted in full, but
those seen once are discounted to nothing (`least`), as is usual for Katz models: their mass goes to backoff.

How it runs. Texts are read once and written as `parts` of about `PART` tokens: local word numbers, and the
hashes of the part's words. Each part asks for its **distinct** n-grams only, packed by hash range into buckets;
a bucket adds up the parts' training counts, answers every part in the order it asked, and stores the counts.
One part owns each n-gram: it adds the n-gram's discounted mass and lower-order probability to its context, whose
sums go to buckets in the same way; those store the context's backoff weight and answer. A frequent word or
n-gram is one entry a part wherever it occurs, so no key is hot, and nothing is broadcast or collected
but counts of counts. The counts and contexts of a `Katz` model are stored tables by order and bucket; given to
`fit_and_score` again, new texts are scored with them.

Null texts count as empty: they have one token, the end. A null training flag counts as true. Rows are scored
one by one, so repeated rows and ids are no matter. A text of over `PART` tokens is spread over several parts.
Other columns are not read. Where nothing can be learnt, the unknown class has all probability (score 0). An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import U64, bounded_batches, crc_mod, grouped, mix, pack, pack_sorted, span_hashes, stored, stretches, table, unpack, unpack_sorted, utf8, word_spans

#: Trigrams work too, but their tables and exchanges take more than four times the input on disk (see README).
ORDER = 2
CUT = 5
#: Tokens of a part, and keys that a bucket gets from all parts.
PART = 1_500_000
BUCKET = 2_000_000
#: Rounds in which parts are scored.
ROUNDS = 3
#: Bytes of texts that are cut into words at once, and of a text that comes in stretches.
STRETCH = (1 << 17, 1 << 22)
START, END = U64(0x5354415254), U64(0x454E44)
#: Kinds of rows on the way; answers have kinds from ANSWER on.
PAYLOAD, ASK, MODEL, STATS, ANSWER = range(5)
LAYOUT = "dest long, kind int, src long, a binary, b binary, c binary"
NAMES = ["dest", "kind", "src", "a", "b", "c"]


@dataclass(frozen=True)
class Discounts:
    """Factors for counts 1 .. CUT; larger counts are not discounted, those under `least` to nothing."""

    factors: tuple[float, ...]
    least: int = 1

    @classmethod
    def good_turing(cls, n: list[int], least: int = 1) -> Discounts:
        """From the numbers n[r - 1] of types with count r = 1 .. CUT + 1; absolute discounts where they fail."""
        common = (CUT + 1) * n[CUT] / n[0] if n[0] else 1.0
        found = []
        for r in range(1, CUT + 1):
            ratio = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
            d = (ratio - common) / (1 - common) if common < 1 else 0.0
            found.append(0.0 if r < least else d if 0 < d < 1 else (r - 0.5) / r)
        return cls(tuple(found), least)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.array([0.0, *self.factors, 1.0])[np.minimum(c, CUT + 1)] * c


@dataclass(frozen=True)
class Unigrams:
    """Total, vocabulary size and discounts; probabilities follow from counts."""

    total: int
    words: int
    discounts: Discounts
    scale: float
    unknown: float

    @classmethod
    def fit(cls, total: int, words: int, n: list[int]) -> Unigrams:
        d = Discounts.good_turing(n)
        taken = sum(r * n[r - 1] * (1 - f) for r, f in enumerate(d.factors, 1))
        left = taken / total if total else 1.0
        if total and left * (total + 1) < 1:  # next to nothing left: as if one unknown word had come once
            return cls(total, words, d, (total / (total + 1)) / (1 - left), 1 / (total + 1))
        return cls(total, words, d, 1.0, left)

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(c))
        return np.where(c > 0, self.scale * self.discounts(c) / self.total, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        """log10 of counts smoothed by half a count."""
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.words + 1)))


def context_weight(count: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts: the factor that makes a discounted count a probability, and the backoff weight.

    count: occurrences; mass: sum of discounted counts; lower: sum of lower-order probabilities of what is kept.
    """
    safe = np.maximum(count, 1)
    left = 1 - mass / safe
    floor = 0.5 / (safe + 0.5)
    # a context whose counts are all too large to be discounted leaves half a count to the unseen
    scale = np.where(left < floor, (1 - floor) / np.maximum(mass, 1e-300), 1 / safe)
    left = np.maximum(left, floor)
    kept = mass > 0
    return np.where(kept, scale, 0.0), np.where(kept, left / np.maximum(1 - lower, 1e-12), 1.0)


# ------------------------------------------------------------------ parts


def _row(dest: int, kind: int, src: int, *data: bytes) -> pa.RecordBatch:
    cells = [pa.array([x], pa.binary()) for x in [*data, b"", b"", b""][:3]]
    return pa.RecordBatch.from_arrays([pa.array([dest], pa.int64()), pa.array([kind], pa.int32()), pa.array([src], pa.int64()), *cells], names=NAMES)


def _cells(t: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes, bytes, bytes]]:
    return zip(*[t.column(n).to_pylist() for n in NAMES], strict=True)


def _joined(blobs: list[bytes]) -> bytes:
    return np.array([len(blobs), *map(len, blobs)], np.int64).tobytes() + b"".join(blobs)


def _split(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    edge = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(blob[8 : 8 * (n + 1)], np.int64))])
    return [blob[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]


@dataclass
class Gathered:
    """Tokens on their way into a part: hashes with start marks, stretches of texts, and the rows they belong to."""

    word: list[np.ndarray] = field(default_factory=list)
    starts: list[np.ndarray] = field(default_factory=list)
    text: list[np.ndarray] = field(default_factory=list)
    use: list[np.ndarray] = field(default_factory=list)
    ids: list[pa.Array] = field(default_factory=list)
    size: int = 0

    def row(self, part: int) -> pa.RecordBatch:
        """The part: words by local number, where frequent ones have small numbers; tokens, stretches and rows."""
        words, number, n = np.unique(np.concatenate(self.word), return_inverse=True, return_counts=True)
        rank = np.argsort(-n, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        ids = pa.concat_arrays(self.ids)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as w:
            w.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
        starts, text, use = (np.concatenate(x) for x in (self.starts, self.text, self.use))
        tokens = [pack(place[number]), pack(np.diff(starts, prepend=0)), pack(text), pack(use)]
        return _row(part, PAYLOAD, self.size, pack(words[rank]), _joined(tokens), sink.getvalue().to_pybytes())


def parts_of(rows: DataFrame, order: int) -> DataFrame:
    """The texts of rows (id, use, t) as parts; src is their number of tokens. Texts are read once and whole."""
    pads = np.full(order - 1, START)
    full, stretch = PART, STRETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, texts, g = TaskContext.get().partitionId(), 0, 0, Gathered()
        for b in batches:
            buf, off = utf8(b.column("t"))
            train = b.column("use").to_numpy(zero_copy_only=False)
            carry = pads
            for x, y, a, z, last in stretches(buf, off, *stretch):
                s, e, before = word_spans(buf[a:z], off[x : y + 1] - a if y - x > 1 else np.array([0, z - a]))
                h = span_hashes(buf[a:z], s, e)
                n = np.diff(before)
                length = len(pads) + n + last
                at = np.cumsum(length) - length
                word = np.full(int(length.sum()), END)
                word[np.arange(len(h)) + np.repeat(at + len(pads) - before[:-1], n)] = h
                for k in range(len(pads)):
                    word[at + k] = carry[k]
                carry = pads if last else np.concatenate([carry, h])[len(h) :]
                g.word.append(word)
                g.starts.append(at + g.size)
                g.text.append((task << 32) + texts + x + np.arange(y - x))
                g.use.append(train[x:y])
                g.ids.append(b.column("id").slice(x, y - x))
                g.size += len(word)
                if g.size >= full:
                    yield g.row((task << 24) + made)
                    made, g = made + 1, Gathered()
            texts += b.num_rows
        if g.size:
            yield g.row((task << 24) + made)

    return rows.select("id", "use", "t").mapInArrow(run, LAYOUT)


@dataclass
class Part:
    """The tokens of a part: hashes with start marks, which of them are scored, and the stretch of each of those."""

    hashes: np.ndarray
    at: np.ndarray
    row: np.ndarray
    text: np.ndarray
    use: np.ndarray
    ids: pa.Array
    known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def read(cls, a: bytes, b: bytes, c: bytes, order: int) -> Part:
        number, steps, text, use = (unpack(x).view(np.int64) for x in _split(b))
        starts = np.cumsum(steps)
        scored = np.ones(len(number), bool)
        for k in range(order - 1):
            scored[starts + k] = False
        at = np.flatnonzero(scored)
        row = np.searchsorted(starts, at, side="right") - 1
        return cls(unpack(a)[number], at, row, text, use.astype(bool), pa.ipc.open_stream(c).read_all().column(0).combine_chunks())

    def keys(self, n: int, back: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams that end `back` tokens before a scored token, by hash, and the one of each such token."""
        if (n, back) not in self.known:
            at = self.at - back
            h = mix(self.hashes[at - (n - 1)])
            for k in range(n - 2, -1, -1):
                h = mix(h * U64(0x9E3779B97F4A7C15) + self.hashes[at - k])
            keys, of = np.unique(h, return_inverse=True)
            self.known[n, back] = keys, of.astype(np.int32)
        return self.known[n, back]


def _asks(part: int, keys: np.ndarray, buckets: int, count: np.ndarray, sums: list[np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """The part's keys, cut into the ranges of hashes that buckets have, with a count and two sums of each."""
    bounds = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=U64)
    edge = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)
    for k in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
        cut = slice(edge[k], edge[k + 1])
        yield _row(k, ASK, part, pack_sorted(keys[cut]), pack(count[cut]), _joined([pack(s[cut].view(U64)) for s in sums]) if sums else b"")


# ------------------------------------------------------------------ buckets


@dataclass
class Bucket:
    """What parts and stored tables say of the keys of a bucket, one after the other, and the distinct keys."""

    rows: list[tuple[int, int, int, bytes, bytes, bytes]]
    cuts: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    of: np.ndarray

    @classmethod
    def read(cls, t: pa.Table) -> Bucket:
        rows = list(_cells(t))
        keys = [unpack_sorted(r[3]) for r in rows]
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
        of = np.empty(len(flat), np.int32)
        of[order] = np.cumsum(new) - 1
        return cls(rows, np.cumsum([0, *map(len, keys)]), flat[order[new]], order[new], of)

    def sums(self, values: list[np.ndarray]) -> np.ndarray:
        return np.bincount(self.of, weights=np.concatenate(values), minlength=len(self.keys))

    def counts(self) -> np.ndarray:
        return self.sums([unpack(r[4]).view(np.int64) for r in self.rows]).astype(np.int64)

    def answers(self, kind: int, *flat: np.ndarray) -> Iterator[pa.RecordBatch]:
        for r, i, j in zip(self.rows, self.cuts[:-1], self.cuts[1:], strict=True):
            if r[1] == ASK:
                yield _row(r[2], kind, r[0], *[pack(x[i:j]) for x in flat])


def count_bucket(batches: Iterator[pa.RecordBatch], n: int, least: int, learns: bool) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of each n-gram; answers each part twice the count, plus one for the n-gram's owner."""
    for t in grouped(batches, 1):
        b = Bucket.read(t)
        total, owner = b.counts(), np.zeros(len(b.of), np.int64)
        owner[b.first] = learns
        yield from b.answers(ANSWER + 2 * n, total[b.of] * 2 + owner)
        if learns:
            few = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 2)[1 : CUT + 2]
            for k, x in enumerate([total.sum(), (total > 0).sum(), *few]):
                yield _row(k, STATS, int(x))
            kept = total >= least
            yield _row(b.rows[0][0], MODEL, -1, pack_sorted(b.keys[kept]), pack(total[kept]))


def context_bucket(batches: Iterator[pa.RecordBatch], n: int, learns: bool) -> Iterator[pa.RecordBatch]:
    """Adds up what parts tell of each context of n-grams, or looks it up in a stored table; answers the factor of
    its n-grams and its backoff weight."""
    for t in grouped(batches, 1):
        b = Bucket.read(t)
        if learns:
            mass, lower = (b.sums([unpack(_split(r[5])[k]).view(np.float64) for r in b.rows]) for k in (0, 1))
            scale, back = context_weight(b.counts(), mass, lower)
        else:
            scale, back = np.zeros(len(b.keys)), np.ones(len(b.keys))
            for r, i, j in zip(b.rows, b.cuts[:-1], b.cuts[1:], strict=True):
                if r[1] == MODEL:
                    scale[b.of[i:j]], back[b.of[i:j]] = (unpack(x).view(np.float64) for x in _split(r[5]))
        yield from b.answers(ANSWER + 2 * n + 1, *[x[b.of].astype(np.float32).view(np.uint32) for x in (scale, back)])
        if learns:
            kept = scale > 0
            yield _row(b.rows[0][0], MODEL, -1, pack_sorted(b.keys[kept]), pack(b.counts()[kept]), _joined([pack(x[kept].view(U64)) for x in (scale, back)]))


# ------------------------------------------------------------------ the model


@dataclass
class Answers:
    """What buckets have told a part, in the order of its own keys."""

    cells: dict[int, list[tuple[bytes, bytes]]]

    def counts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([unpack(a).view(np.int64) for a, _ in self.cells[ANSWER + 2 * n]])
        return flat >> 1, (flat & 1).astype(bool)

    def asked(self, part: Part, n: int, least: int) -> np.ndarray:
        """Which contexts of n-grams a part asks about: a context seen fewer than `least` times keeps no n-gram."""
        keys, (have, _) = part.keys(n - 1, 1)[0], part.keys(n - 1)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return (have[at] != keys) | (self.counts(n - 1)[0][at] >= least)  # those that begin a text are no n-grams

    def weights(self, part: Part, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The factor and the backoff weight of each context of n-grams."""
        asked = self.asked(part, n, least)
        out = np.zeros(len(asked)), np.ones(len(asked))
        for k in (0, 1):
            if asked.any():
                out[k][asked] = np.concatenate([unpack(r[k]).astype(np.uint32).view(np.float32) for r in self.cells[ANSWER + 2 * n + 1]])
        return out


@dataclass
class Katz:
    """A learnt model: figures, and the stored tables of counts and contexts, rows (bucket `dest`, packed keys and values)."""

    order: int
    buckets: int
    unigrams: Unigrams
    discounts: dict[int, Discounts]
    counts: dict[int, DataFrame]
    contexts: dict[int, DataFrame]

    def probabilities(self, part: Part, told: Answers, n: int) -> np.ndarray:
        """The probability of each scored token by n-grams, recursively from the lower orders."""
        if n == 1:
            return self.unigrams.p(told.counts(1)[0])[part.keys(1)[1]]
        lower = self.probabilities(part, told, n - 1)
        d, c, of = self.discounts[n], told.counts(n)[0], part.keys(n)[1]
        scale, back = told.weights(part, n, d.least)
        context = part.keys(n - 1, 1)[1]
        share = d(np.where(c >= d.least, c, 0))[of]
        return np.where(share > 0, scale[context] * share, back[context] * lower)


def _beside(parts: DataFrame, told: list[DataFrame], order: int, f: Callable[[int, Part, Answers], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """f(part number, part, answers) in a task for each part, brought together with the answers to it."""
    both = parts
    for df in told:
        both = both.unionByName(df.filter(F.col("kind") >= ANSWER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 1):
            cells: dict[int, list[tuple[bytes, bytes]]] = {}
            for dest, kind, _, a, b, c in _cells(t):
                if kind == PAYLOAD:
                    part = Part.read(a, b, c, order)
                else:
                    cells.setdefault(kind, []).append((a, b))
            yield from f(dest, part, Answers(cells))

    return both.repartition("dest").sortWithinPartitions("dest", "kind", "src").mapInArrow(run, schema)


def fit_and_score(docs: DataFrame, train: Column | None, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, model: Katz | None = None) -> tuple[DataFrame, Katz]:
    """The scores of all rows, and the model: that learnt from rows under `train`, or the given one, from which nothing is relearnt."""
    spark = docs.sparkSession
    bounded_batches(spark)
    learns = model is None
    use = F.coalesce(train, F.lit(True)) if learns and train is not None else F.lit(learns)
    rows = docs.select(F.col(doc_id).alias("id"), use.alias("use"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if learns:
        model = Katz(order, 1, Unigrams.fit(0, 0, [0] * (CUT + 1)), {}, {}, {})
    order = model.order
    parts = stored(parts_of(rows, order), "katz-parts")
    if learns:
        model.buckets = max(1, math.ceil(int(parts.agg(F.sum("src")).first()[0] or 0) / BUCKET))
    buckets = model.buckets
    told: list[tuple[int, DataFrame]] = []

    def settle(asks: DataFrame, tables: dict[int, DataFrame], n: int, task) -> DataFrame:
        """Answers to the parts, and with learning the stored table of this order."""
        if not learns:
            asks = asks.unionByName(tables[n])
        got = stored(asks.repartition("dest").sortWithinPartitions("dest", "src").mapInArrow(task, LAYOUT), f"katz-{n}")
        told.append((n, got))
        if learns:
            tables[n] = got.filter(F.col("kind") == MODEL)
        return got

    for n in range(1, order + 1):
        least = 1 if n < 3 else 2

        def ask_counts(batches: Iterator[pa.RecordBatch], n: int = n) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for dest, _, _, a, t, c in _cells(b):
                    part = Part.read(a, t, c, order)
                    keys, of = part.keys(n)
                    yield from _asks(dest, keys, buckets, np.bincount(of, weights=part.use[part.row], minlength=len(keys)).astype(np.int64))

        got = settle(parts.mapInArrow(ask_counts, LAYOUT), model.counts, n, lambda batches, n=n, least=least: count_bucket(batches, n, least, learns))
        if learns:
            sums = {r[0]: int(r[1]) for r in got.filter(F.col("kind") == STATS).groupBy("dest").agg(F.sum("src")).collect()}
            few = [sums.get(k, 0) for k in range(2, CUT + 3)]
            if n == 1:
                model.unigrams = Unigrams.fit(sums.get(0, 0), sums.get(1, 0), few)
            else:
                model.discounts[n] = Discounts.good_turing(few, least)

    figures = Katz(order, buckets, model.unigrams, model.discounts, {}, {})  # what tasks get: no tables
    for n in range(2, order + 1):

        def ask_contexts(dest: int, part: Part, answers: Answers, n: int = n) -> Iterator[pa.RecordBatch]:
            keys, context = part.keys(n - 1, 1)
            of, d = part.keys(n)[1], figures.discounts[n]
            c, owner = answers.counts(n)
            lower = figures.probabilities(part, answers, n - 1)
            place = np.zeros(len(c), np.int64)
            place[of] = np.arange(len(of))  # any place of an n-gram: its context and lower probability are the same at all
            own = owner & (c > 0)
            at, c = place[own], c[own]
            kept = c >= d.least
            count, mass, low = (np.bincount(context[at], weights=x, minlength=len(keys)) for x in (c, np.where(kept, d(c), 0), np.where(kept, lower[at], 0)))
            ask = answers.asked(part, n, d.least)
            yield from _asks(dest, keys[ask], buckets, count[ask].astype(np.int64), [mass[ask], low[ask]])

        settle(_beside(parts, [df for m, df in told if m <= n], order, ask_contexts, LAYOUT), model.contexts, n, lambda batches, n=n: context_bucket(batches, n, learns))

    schema = docs.select(F.col(doc_id).alias("doc_id")).schema.add("trained", "boolean").add("text", "long").add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")

    def score(dest: int, part: Part, answers: Answers) -> Iterator[pa.RecordBatch]:
        n, of = len(part.use), part.row
        c = answers.counts(1)[0][part.keys(1)[1]]
        p = np.log10(np.maximum(figures.probabilities(part, answers, order), 1e-300))
        known, tokens, base, sums = (np.bincount(of, weights=x, minlength=n) for x in (c > 0, np.ones(len(of)), figures.unigrams.base(c), p))
        yield pa.RecordBatch.from_arrays([part.ids, pa.array(part.use), pa.array(part.text), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(sums)], names=schema.names)

    # a part of the parts at a time, so that only that is on its way at once
    each = None
    for k in range(ROUNDS):
        turn = lambda df, k=k: df.filter(F.pmod(F.xxhash64("dest"), F.lit(ROUNDS)) == k)
        got = stored(_beside(turn(parts), [turn(df) for _, df in told], order, score, schema), "katz-scores")
        each = got if each is None else each.unionByName(got)
    figures_of = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    out = each.groupBy("text").agg(F.first("doc_id").alias("doc_id"), F.first("trained").alias("trained"), *figures_of)
    total = F.lit(model.unigrams.total).cast("long").alias("train_tokens")
    return out.select("doc_id", "trained", "n_tokens", "n_known", total, "base_score", "score"), model


def katz_scores(docs: DataFrame, train: Column | None = None, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, trained boolean, n_tokens, n_known, train_tokens, base_score, score of each row."""
    return fit_and_score(docs, train, doc_id, text, order)[0]


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learnt from those whose crc32(doc_id) mod 5 is not 1."""
    out = katz_scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
