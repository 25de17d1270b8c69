"""Token counts with a whole-token shortcut.

A byte-pair model with a space marker never merges across the start of a run of markers, nor across
a character that is in no longer piece. Both are proved from the vocabulary before any text is read
(`prove`). Texts then fall into pre-tokens whose counts add up. The same proof lists the vocabulary
strings that encode alone as one token: pre-tokens in that list count 1 without any merging; only
the rest is merged, once for each distinct string that a worker meets.

Null texts count as empty (0 tokens). Special strings inside a text are ordinary text, as the
library's default has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import REMEMBERED, bounded_batches, table

MARK = "▁"
#: Distinct pre-tokens that a worker remembers; beyond it the memory starts anew, with the same results.
MEMORY = 400_000
TOKEN_LIMIT = 4096


@dataclass(frozen=True)
class Proof:
    """What the vocabulary alone guarantees. spaced: strings that are one token after a marker; bare: without."""

    safe: bool
    spaced: frozenset[str] = field(default_factory=frozenset)
    bare: frozenset[str] = field(default_factory=frozenset)


def prove(model_path: str) -> Proof:
    """Read the vocabulary and prove the cuts and the whole tokens; `safe` is false where a proof fails."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names = {i: sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    cut = sp.encode("\n")
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in names.values()) or len(cut) != 2 or sp.encode("") or sp.id_to_piece(cut[0]) != MARK:
        return Proof(False)
    spaced, bare = {""}, set()
    for i, p in names.items():
        if p.startswith(MARK):
            if len(p) > 1 and sp.encode(p[1:].replace(MARK, " ")) == [i]:
                spaced.add(p[1:].replace(MARK, " "))
        elif sp.encode("\n" + p) == [*cut, i]:
            bare.add(p)
    return Proof(True, frozenset(spaced), frozenset(bare))


class _Counts(dict):
    """Tokens of a pre-token, worked out where it is first met."""

    def __init__(self, whole: frozenset[str], merge):
        super().__init__()
        self.whole, self.merge = whole, merge

    def __missing__(self, s: str) -> int:
        n = 1 if s in self.whole else self.merge(s)
        if len(self) >= MEMORY:
            self.clear()
        self[s] = n
        return n


class Counter:
    """Counts of single texts; exact by the proof, or by whole encoding where there is none."""

    def __init__(self, model_path: str, proof: Proof):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.encode, self.safe = sp.encode, proof.safe
        self.spaced = _Counts(proof.spaced, lambda s: len(sp.encode(s)))
        # after the cut character no marker is put before the string; that prefix is two tokens
        self.bare = _Counts(proof.bare, lambda s: len(sp.encode("\n" + s)) - 2 if s else 0)
        self.runs = re.compile(" +[^ ]*")

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.safe:
            return len(self.encode(text))
        if MARK in text:
            text = text.replace(MARK, " ")
        spaced, bare = self.spaced, self.bare
        lines = text.split("\n")
        total = len(lines) - 1
        for k, line in enumerate(lines):
            if "  " in line or (k == 0 and line.startswith(" ")):
                if k == 0:
                    line = " " + line
                head = line.split(" ", 1)[0]
                total += bare[head] if k else 0
                total += sum(spaced[s[1:]] for s in self.runs.findall(line[len(head):]))
            else:
                parts = line.split(" ")
                if k:
                    total += bare[parts[0]]
                    del parts[0]
                total += sum(map(spaced.__getitem__, parts))
        return total


_workers: dict[str, Counter] = {}
REMEMBERED.append(_workers)


def _counter(model_path: str, proof: Proof) -> Counter:
    """One counter a worker process, so that tasks share what it remembers."""
    if model_path not in _workers:
        _workers[model_path] = Counter(model_path, proof)
    return _workers[model_path]


def token_counts(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of `docs` with n_tokens, the library's number of tokens of each whole text."""
    bounded_batches(docs.sparkSession)
    proof = prove(model_path)
    schema = docs.select(*keep).schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path, proof)
        for b in batches:
            n = pa.array([counter(x) for x in b.column(b.num_columns - 1).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(count, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under piece_bpe_32k.model."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "n_bytes"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
