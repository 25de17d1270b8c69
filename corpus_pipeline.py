"""A corpus pipeline of five stages: quality, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import bpe, jaccard_join, mixing, quality, secrets
from lintlake.llm.common import stored, table

#: What words are made of.
WORD = r"[^\x20\x09-\x0D]"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity rules keep.

    Rows are judged one by one: repeated rows stay or go together. Null and empty texts have no words and go. Null languages
    share one model. An empty table stays empty.
    """
    return quality.judge(docs, keep=tuple(COLUMNS)).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least id, of rows with that id the least text.

    Rows are told apart by id and text, so a row goes only if its own text is a copy. Documents without words have
    no class and stay; of rows that agree in id and text, and have words, one stays.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    classes = jaccard_join.jaccard_join(docs)
    # only ids and hashes move
    gone = classes.filter(~F.col("stays")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    out = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left_anti")
    twice = classes.filter("stays").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("twice_id"), F.col("text_key").alias("twice_key"))
    same = F.col("doc_id").eqNullSafe(F.col("twice_id")) & (F.col("text_key") == F.col("twice_key"))
    once = out.join(twice, same, "left_semi").filter(F.col("text").rlike(WORD)).groupBy("doc_id", "text_key").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    rest = out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").filter(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))))
    return rest.select(*COLUMNS).unionByName(once.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with values that look like live credentials masked; n_chars follows the text.

    Null texts stay null with the n_chars they had; repeated rows are masked alike. A null source is one further owner.
    """
    out = secrets.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document as often as its source's weight asks.

    A null source is a source of its own. Null and empty texts count no words, so a source that has no others is not drawn.
    Rows that repeat are drawn one by one; where a source's last pass ends inside equal ids, all of them or none are in it.
    """
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, and digests of the ids and of the text they decode to.

    Null texts count as empty and have no ids. Each row is encoded for itself, also where rows repeat.
    """
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: Perplexity, minhash and byte-pair merging are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again.

    What a stage has written goes when the session ends.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}-{name}")
    return docs
