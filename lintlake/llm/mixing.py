"""Mixing sources to target weights by temperature.

The token share p of each source is raised to an exponent and normalised; smaller exponents even the
sources out and repeat the small ones more. The exponent is bisected: it is the largest one in [0, 1] that
reaches the target entropy, or if that would repeat a source more often than `max_repeat`, the smallest one
that keeps to that limit. A source then gets weight * budget tokens: whole passes over all its documents,
and a last pass of the first blocks of a permutation of its blocks, and within the block where the budget
ends, the first documents of a permutation of its documents. All orders come from hashes of ids, so any
executor recomputes them. What is kept for each source is two numbers (the block and document hashes where
its last pass ends); documents are picked by comparing with these, without a shuffle of texts.

Null sources form one source. Texts without words have no tokens; a source without tokens is never picked.
Documents with the same id share their place in the permutations and are picked together. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.llm.common import table

BLOCK_DOCS = 256
ENTROPY = 0.5  # of the way from the entropy of the shares to that of equal weights
MAX_REPEAT = 4.0
#: Sources up to which their decisions are broadcast (a row of about 100 bytes each); beyond it they are joined.
BROADCAST_SOURCES = 50_000
SEED = 20


def n_words(text: str) -> Column:
    """The measure of budgets: words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Weights:
    exponent: float
    weights: np.ndarray
    repeats: np.ndarray


#: Upper bits of a block key that name its share of the range.
SHARE_BITS = 10


def temper(tokens: np.ndarray, exponent: float) -> np.ndarray:
    p = tokens / tokens.sum()
    w = np.where(p > 0, np.power(np.where(p > 0, p, 1.0), exponent), 0.0)
    return w / w.sum()


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def solve(tokens: np.ndarray, budget: float, target_entropy: float | None = None, max_repeat: float = MAX_REPEAT) -> Weights:
    """Bisect the exponent for the target entropy (default: ENTROPY of the way to equal weights) under the repetition limit."""
    tokens = np.asarray(tokens, float)
    natural, most = entropy(temper(tokens, 1.0)), np.log((tokens > 0).sum())
    target = natural + ENTROPY * (most - natural) if target_entropy is None else target_entropy

    def repeats(a: float) -> np.ndarray:
        return temper(tokens, a) * budget / np.where(tokens > 0, tokens, np.inf)

    def bisect(holds) -> float:
        """The edge between exponents where `holds` (from 0 up) and those where it does not."""
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    by_entropy = 1.0 if natural >= target else bisect(lambda a: entropy(temper(tokens, a)) >= target)
    over = lambda a: repeats(a).max() > max_repeat
    by_limit = 0.0 if not over(0.0) else 1.0 if over(1.0) else min(1.0, bisect(over) + 2.0**-59)
    a = max(by_entropy, by_limit)
    return Weights(a, temper(tokens, a), repeats(a))


def mix_sources(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", budget: int | None = None, target_entropy: float | None = None, max_repeat: float = MAX_REPEAT, seed: int = SEED, tokens: Column | None = None) -> DataFrame:
    """`docs` with mix_tokens, mix_epoch, mix_block and mix_weight: one row for each time that a document is used.

    tokens: what a document counts for, such as the n_tokens of `token_counts`; its words where that is None. A budget
    of None is the tokens of all documents. Sort by (mix_epoch, mix_block_key, mix_doc_key) for the mix.
    """
    spark = docs.sparkSession
    key = F.col("__src")
    rows = docs.withColumn("__src", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))).withColumn("mix_tokens", n_words(text) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long"))
    slim = rows.select("__src", F.col(doc_id).alias("__id"), "mix_tokens")
    totals = slim.groupBy("__src").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("n")).collect()
    names, sums_ = [r[0] for r in totals], np.array([r.tokens for r in totals], float)
    if not sums_.sum():
        return _with_picks(rows.filter(F.lit(False)), F.lit(None), F.lit(0).cast("long"), F.lit(None).cast("double"), doc_id, 1, seed)
    got = solve(sums_, float(budget if budget is not None else sums_.sum()), target_entropy, max_repeat)
    quota = np.floor(got.repeats * sums_ + 1e-6).astype(np.int64)
    passes = [(k, int(q // t) if t else 0, int(q % t) if t else 0, float(w)) for k, q, t, w in zip(names, quota.tolist(), sums_.astype(np.int64).tolist(), got.weights.tolist(), strict=True)]
    blocks = max(1, -(-sum(r.n for r in totals) // BLOCK_DOCS))
    plan = spark.createDataFrame(passes, "__src string, __full long, __rest long, __weight double")
    small = len(names) <= BROADCAST_SOURCES
    hint = (lambda d: F.broadcast(d)) if small else (lambda d: d)

    # where the last pass of each source ends: among shares of the range of block keys, among the blocks of that share, then
    # inside the one block; so no source is sorted in one task
    block, block_key, doc_key = _keys(F.col("__id"), F.col("__full"), blocks, seed)
    placed = slim.join(hint(plan), "__src").select("__src", F.col("__rest").alias("rest"), block.alias("b"), block_key.alias("bk"), doc_key.alias("dk"), "mix_tokens")
    sums = placed.groupBy("__src", "b").agg(F.first("rest").alias("rest"), F.first("bk").alias("bk"), F.sum("mix_tokens").alias("t"))
    sums = sums.withColumn("share", F.shiftright("bk", 64 - SHARE_BITS))
    shares = sums.groupBy("__src", "share").agg(F.first("rest").alias("rest"), F.sum("t").alias("t"))
    shares = shares.withColumn("run", F.sum("t").over(Window.partitionBy("__src").orderBy("share")))
    shares = shares.filter("run > rest").groupBy("__src").agg(F.min(F.struct("share", (F.col("run") - F.col("t")).alias("before"))).alias("s"))
    near = sums.join(hint(shares), "__src").filter(F.col("share") == F.col("s.share"))
    run = F.col("s.before") + F.sum("t").over(Window.partitionBy("__src").orderBy("bk", "b").rowsBetween(Window.unboundedPreceding, 0))
    ends = near.withColumn("run", run).filter("run > rest").groupBy("__src").agg(F.min(F.struct("bk", "b", (F.col("rest") - F.col("run") + F.col("t")).alias("room"))).alias("e"))
    ends = ends.select("__src", F.col("e.bk").alias("end_bk"), F.col("e.b").alias("end_b"), F.col("e.room").alias("room"))
    last = placed.join(hint(ends), "__src").filter(F.col("b") == F.col("end_b")).select("__src", "end_bk", "end_b", "room", "dk", "mix_tokens")
    run = F.sum("mix_tokens").over(Window.partitionBy("__src").orderBy("dk"))  # of equal keys all or none
    stops = last.withColumn("run", run).groupBy("__src", "end_bk", "end_b").agg(F.max(F.when(F.col("run") <= F.col("room"), F.col("dk"))).alias("end_dk"))
    stopped = spark.createDataFrame([tuple(r) for r in stops.collect()], "__src string, __end_bk long, __end_b long, __end_dk long")

    out = rows.join(hint(plan.join(hint(stopped), "__src", "left")), "__src")
    block, block_key, doc_key = _keys(F.col(doc_id), F.col("__full"), blocks, seed)
    before = F.struct(block_key, block) < F.struct("__end_bk", "__end_b")
    inside = (block == F.col("__end_b")) & (doc_key <= F.col("__end_dk"))
    partly = F.when(F.col("__rest") == 0, F.lit(False)).when(F.col("__end_b").isNull(), F.lit(True)).otherwise(before | F.coalesce(inside, F.lit(False)))
    copies = F.col("__full") + partly.cast("long")
    out = out.filter(copies > 0)
    return _with_picks(out, F.sequence(F.lit(0).cast("long"), copies - 1), None, F.col("__weight"), doc_id, blocks, seed).drop("__full", "__rest", "__weight", "__end_bk", "__end_b", "__end_dk")


def _keys(doc_id: Column, epoch: Column, blocks: int, seed: int) -> tuple[Column, Column, Column]:
    """The block of a document, and the keys that order blocks, and documents within them, in an epoch."""
    block = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(blocks).cast("long"))
    return block, F.xxhash64(F.lit(seed), epoch, block), F.xxhash64(F.lit(seed + 1), epoch, doc_id)


def _with_picks(rows: DataFrame, epochs: Column, epoch: Column | None, weight: Column, doc_id: str, blocks: int, seed: int) -> DataFrame:
    out = rows.withColumn("mix_epoch", epoch if epoch is not None else F.explode(epochs))
    block, block_key, doc_key = _keys(F.col(doc_id), F.col("mix_epoch"), blocks, seed)
    return out.withColumns({"mix_block": block, "mix_block_key": block_key, "mix_doc_key": doc_key, "mix_weight": weight}).drop("__src")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents within a budget of their own tokens."""
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.drop("text")
