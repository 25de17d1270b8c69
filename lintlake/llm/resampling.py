"""Importance resampling towards a target distribution, on hashed n-gram features.

Features are the runs of `shortest` to `longest` consecutive words, joined by one space; a feature's bucket is its crc32
modulo `buckets`. One pass over the corpus and one over the target texts count occurrences by bucket; each task interns
the n-grams of a batch in an open-addressed table (`NgramTable`) and sends its sums of buckets once. A bucket's gain is
the smoothed log ratio of target to corpus, in thousandths. Gains are broadcast: one number for each of `buckets`,
which is a parameter. A second pass interns each batch again, gathers the gains of its occurrences by slot, and adds
them up by document. The document's weight plus Gumbel noise of its id is its score; of the documents with enough words
the given percentage with the highest scores is drawn, which is a draw without replacement in proportion to the weights'
exponents. Ranks are numbered over all documents by ranges of scores (`global_row_number`).

Words are runs of a-z, 0-9 and characters beyond ASCII, after A-Z are lower-cased. Null and empty texts have no
words, no features and weight 0. Ties go to the smaller id, then to the smaller hash of the text (null texts have the least);
a null id counts as an empty one for the noise, and comes first in ties. Repeated rows are drawn one by one.
Texts are cut before white space into stretches of some megabytes, so one of any length is read in bounded memory; a word
is never cut. `keep` columns come through under their own names; of clashing names the result's own win. An empty table
gives an empty result, and an empty target gives gains from the corpus alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lintlake.llm.common import bounded_batches, stretches, table, utf8
from lintlake.llm.ngram_table import NgramTable
from lintlake.operators.ranking import global_row_number

BUCKETS = 10_000
SHORTEST = LONGEST = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
RESULT = ("n_features", "n_words", "weight", "score", "rank")

_WORD = np.ones(256, bool)
_WORD[:0x80] = False
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_PADDING = np.zeros(8, np.uint8)


def _words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of folded bytes, each followed by one space: the bytes, n+1 starts, and the row of each word."""
    word = _WORD[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    gap = np.ones(len(out), bool)
    gap[at[1:] - 1] = False
    out[gap] = buf[word]
    return out, at, np.searchsorted(off, starts, side="right") - 1


def features(buf: np.ndarray, at: np.ndarray, row: np.ndarray, shortest: int, longest: int, known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of words of one row that end after the first `known` words."""
    n, found = len(row), []
    for k in range(shortest, longest + 1):
        i = np.arange(max(0, known - k + 1), max(0, n - k + 1))
        i = i[row[i] == row[i + k - 1]]
        found.append((at[i], at[i + k] - 1, row[i]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def interned(column: pa.Array, buckets: int, shortest: int, longest: int) -> Iterator[tuple[NgramTable, np.ndarray, np.ndarray]]:
    """Tables of n-grams of some texts, with the row of each occurrence, and of each word.

    A text that comes in stretches brings its last words along, so that runs across a cut are features too.
    """
    raw, off = utf8(column)
    carried = np.zeros(0, np.uint8)
    for x, y, a, z, done in stretches(raw, off):
        own = np.clip(off[x : y + 1], a, z) - a
        buf, at, row = _words_of(_FOLD[raw[a:z]], own)
        held = int((carried == 0x20).sum())
        if held:
            buf, at, row = np.concatenate([carried, buf]), np.concatenate([np.flatnonzero(np.concatenate([[0x20], carried]) == 0x20)[:-1], at + len(carried)]), np.concatenate([np.zeros(held, np.int64), row])
        starts, ends, of = features(buf, at, row, shortest, longest, held)
        yield NgramTable(np.concatenate([buf, _PADDING]), starts, ends, buckets), of + x, row[held:] + x
        keep = min(longest - 1, len(row))
        carried = buf[at[len(row) - keep] :] if keep and not done else np.zeros(0, np.uint8)


def bucket_counts(texts: DataFrame, text: str, buckets: int, shortest: int, longest: int) -> DataFrame:
    """(bucket, n): occurrences of features by bucket; each task sends at most `buckets` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t, _, _ in interned(b.column(0), buckets, shortest, longest):
                total += t.bucket_counts(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    each = texts.select(F.col(text).alias("__text")).mapInArrow(run, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(counts: DataFrame, buckets: int) -> np.ndarray:
    rows = counts.toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, for each bucket."""
    s, t, n = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str, keep: tuple[str, ...], shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """`keep` columns with n_features, n_words and weight of each row."""
    kept = [c for c in keep if c not in RESULT]
    schema = docs.select(*kept).schema
    for n in ("n_features", "n_words", "weight"):
        schema = schema.add(n, "long", False)
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = shared.value
        for b in batches:
            out = np.zeros((3, b.num_rows), np.int64)
            for t, of, words in interned(b.column(0), len(by_bucket), shortest, longest):
                lo = int(min(of[0] if len(of) else b.num_rows, words[0] if len(words) else b.num_rows))
                hi = int(max(of.max(initial=-1), words.max(initial=-1))) + 1
                if hi <= lo:
                    continue
                out[0, lo:hi] += np.bincount(of - lo, minlength=hi - lo)
                out[1, lo:hi] += np.bincount(words - lo, minlength=hi - lo)
                np.add.at(out[2], of, t.gather(by_bucket))
            yield pa.RecordBatch.from_arrays([*[b.column(k + 1) for k in range(len(kept))], *[pa.array(x) for x in out]], schema=arrow)

    return docs.select(F.col(text).alias("__text"), *[F.col(c).alias(f"__keep{k}") for k, c in enumerate(kept)]).mapInArrow(run, schema)


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", keep: tuple[str, ...] = ("doc_id",), buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """`keep` columns of every row with n_features, n_words, weight, score, and rank: 1, 2, 3 ... of those drawn, null for the others."""
    bounded_batches(docs.sparkSession)
    corpus = _vector(bucket_counts(docs, text, buckets, shortest, longest), buckets)
    wanted = _vector(bucket_counts(target, target_text, buckets, shortest, longest), buckets)
    named = docs.withColumns({"__id": F.col(doc_id), "__tie": F.xxhash64(F.col(text))})
    rows = weigh(named, gains(corpus, wanted), text, (*[c for c in keep if c not in ("__id", "__tie")], "__id", "__tie"), shortest, longest)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = rows.withColumn("score", (F.col("weight") + noise).cast("long"))
    ranked = global_row_number(rows, [(F.col("n_words") >= min_words).desc(), F.col("score").desc(), F.col("__id").asc_nulls_first(), F.col("__tie")], "rank")
    eligible = ranked.filter(F.col("n_words") >= min_words).count()
    drawn = percent * eligible // 100
    return ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*[c for c in keep if c not in RESULT], *RESULT)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's texts."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
doc_words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
target_words AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
vocabulary AS (SELECT w FROM doc_words UNION SELECT w FROM target_words),
hexed AS (SELECT w, hex(encode(w)) AS x FROM vocabulary),
buckets AS (
  SELECT w, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(len(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::UBIGINT),
    lambda c, b: xor(t[(xor(c, b) & 255)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT) % 10000 AS bucket
  FROM hexed, crc_table),
s AS (SELECT bucket, count(*) AS n FROM doc_words JOIN buckets USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_words JOIN buckets USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n, sum(g) AS weight FROM doc_words JOIN buckets USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * eligible // 100 THEN r END AS rank FROM ranked
"""
