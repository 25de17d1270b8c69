"""Katz scores against a brute-force model, over every order, with stored tables, and through the registered query."""

import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from lintlake.llm import katz
from lintlake.llm.queries import QUERIES

from .test_operators import ASCII_LOWER, TEXTS, WORD, by_id, docs, empty


class Brute:
    """The model of the docstring, with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.grams = order, [collections.Counter() for _ in range(order + 1)]
        self.followers = [collections.defaultdict(dict) for _ in range(order + 1)]
        for t in texts:
            w = ["<s>"] * (order - 1) + tokens(t)
            for i in range(order - 1, len(w)):
                for n in range(1, order + 1):
                    self.grams[n][tuple(w[i - n + 1 : i + 1])] += 1
        for n in range(1, order + 1):
            for g, c in self.grams[n].items():
                self.followers[n][g[:-1]][g[-1]] = c
        self.d = [None, *[katz.Discounts.good_turing([sum(c == r for c in self.grams[n].values()) for r in range(1, katz.CUT + 2)], 2 if n > 2 else 1) for n in range(1, order + 1)]]
        self.total = sum(self.grams[1].values())
        self.unknown = 1 - sum(self.cut(1, c) for c in self.grams[1].values()) / self.total

    def cut(self, n, c):
        return c * (self.d[n].factors[c - 1] if c <= katz.CUT else 1)

    def p(self, context, w):
        n = len(context) + 1
        if n == 1:
            return self.cut(1, self.grams[1][(w,)]) / self.total if (w,) in self.grams[1] else self.unknown
        seen = self.followers[n][context]
        kept = {v: self.cut(n, c) for v, c in seen.items() if c >= self.d[n].least}
        if not kept:
            return self.p(context[1:], w)
        count = sum(seen.values())
        left, floor, factor = 1 - sum(kept.values()) / count, 0.5 / (count + 0.5), 1
        if left < floor:
            factor, left = (1 - floor) / (1 - left), floor
        if w in kept:
            return factor * kept[w] / count
        return left / (1 - sum(self.p(context[1:], v) for v in kept)) * self.p(context[1:], w)

    def score(self, t):
        w = ["<s>"] * (self.order - 1) + tokens(t)
        return sum(math.log10(self.p(tuple(w[i - self.order + 1 : i]), w[i])) for i in range(self.order - 1, len(w)))


def tokens(t):
    return [*WORD.findall((t or "").translate(ASCII_LOWER)), "</s>"]


ALL = [*TEXTS[:9], *[" ".join(f"the {chr(97 + (k * j) % 7)}" for j in range(60)) for k in range(12)]]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "BUCKET", 300)
    monkeypatch.setattr(katz, "PART", 150)
    df = docs(spark, ALL)
    out, model = katz.fit_and_score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, order=order)
    got = by_id(out)
    brute = Brute([ALL[k] for k in [*range(len(ALL)), 0] if zlib.crc32(str(k).encode()) % 5 != 1], order)
    vocabulary = len(brute.grams[1])
    for k, t in enumerate(ALL):
        r, w = got[k], tokens(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum((x,) in brute.grams[1] for x in w), brute.total)
        assert math.isclose(r.base_score, sum(math.log10((brute.grams[1][(x,)] + 0.5) / (brute.total + 0.5 * (vocabulary + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, brute.score(t), rel_tol=1e-6)
    for context in (("the",), ("<s>",), ("a", "the"), ("<s>", "<s>")):
        if len(context) < order:
            assert math.isclose(sum(brute.p(context, w) for (w,) in brute.grams[1]) + brute.p(context, "never seen"), 1, rel_tol=1e-9)
    # the stored tables score other texts, and are not changed by them
    new = ["the a the b never seen", None, "the", ALL[10]]
    again = by_id(katz.fit_and_score(docs(spark, new), None, model=model)[0])
    assert all(math.isclose(again[k].score, brute.score(t), rel_tol=1e-6) and not again[k].trained for k, t in enumerate(new))
    assert again[0].train_tokens == brute.total
    assert katz.katz_scores(empty(spark), F.lit(True), order=order).count() == 0


def test_no_training_rows(spark):
    assert {r.score for r in katz.katz_scores(docs(spark), F.lit(False)).collect()} == {0.0}


def test_long_texts_in_stretches(spark, monkeypatch):
    df = docs(spark, ["a b c " * 3000 + "end", "a b c", "x" * 5000 + " a b", None])
    want = by_id(katz.katz_scores(df))
    monkeypatch.setattr(katz, "STRETCH", (64, 500))
    monkeypatch.setattr(katz, "PART", 700)
    got = by_id(katz.katz_scores(df))
    assert all(got[k].n_tokens == r.n_tokens and math.isclose(got[k].score, r.score, rel_tol=1e-6) for k, r in want.items())


def test_query(spark, tmp_path):
    docs(spark, ALL).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op9_katz_scores"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    rows = out.collect()
    assert len(rows) == len(ALL) + 1
    brute = Brute([ALL[k] for k in [*range(len(ALL)), 0] if zlib.crc32(str(k).encode()) % 5 != 1], katz.ORDER)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert math.isclose(r.score, brute.score(ALL[r.doc_id]), rel_tol=1e-6)
