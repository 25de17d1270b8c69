"""Quality rules: base figures, perplexities and verdicts against brute force."""

import collections
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import quality
from lintlake.llm.queries import QUERIES

from .test_operators import TEXTS, WORD, by_id, docs, empty


def test_quality(spark):
    got = by_id(quality.judge(docs(spark)))
    for k, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(empty(spark)).count() == 0


def test_quality_bands_by_language_and_length(spark):
    rng = np.random.default_rng(4)
    parts = {"en": ["th", "er", "on", "an", "re", "he", "in", "ed"], "es": ["ci", "de", "qu", "os", "ar", "na", "ll", "mi"]}
    word = lambda lang: "".join(rng.choice(parts[lang], rng.integers(1, 4)))
    rows = []
    for lang in parts:
        for k in range(300):
            rows.append((len(rows), " ".join(word(lang) for _ in range([60, 150, 400][k % 3])), lang, "clean"))
        for k in range(8):
            rows.append((len(rows), " ".join(word(lang) + "#$%&"[rng.integers(4)] * 3 for _ in range(400)), lang, "marks"))
            rows.append((len(rows), " | ".join(word(lang) for _ in range(400)), lang, "menu"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string")
    share = {(r.lang, r.kind): r.kept for r in quality.judge(df, keep=("lang", "kind")).groupBy("lang", "kind").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    for lang in parts:
        assert share[lang, "clean"] >= 0.95 and share[lang, "marks"] == share[lang, "menu"] == 0
    # the tails have their own spreads, and long texts narrower bands than short ones
    scored = [("x", 8, 0.6 + (0.04 if k > 0 else 0.01) * k / 50, False) for k in range(-50, 51)] + [("x", 12, 0.6 + 0.002 * k / 50, False) for k in range(-50, 51)]
    got = {r["__class"]: (r.low, r.high) for r in quality.bands(spark.createDataFrame(scored, "__lang string, __class long, log_ppl double, base_failed boolean"), 4.0).collect()}
    assert np.allclose([*got[8], *got[12]], [0.58, 0.68, 0.596, 0.604], atol=0.003)


class Brute:
    """Modified Kneser-Ney over bytes, with dictionaries."""

    def __init__(self, texts):
        n = quality.ORDER
        self.c = {n: collections.Counter(x[i : i + n] for t in texts for x in [b" " * (n - 1) + t] for i in range(len(t)))}
        for k in range(n - 1, 0, -1):
            self.c[k] = collections.Counter(g[1:] for g in self.c[k + 1])
        self.d, self.total, self.held = {}, {}, {}
        for k, counts in self.c.items():
            n1, n2, n3, n4 = (sum(c == r for c in counts.values()) for r in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            self.d[k] = [min(max(r - (r + 1) * y * b / a if a and b else 0.5 * r, 0.1 * r), 0.9 * r) for r, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            self.total[k], self.held[k] = collections.Counter(), collections.Counter()
            for g, c in counts.items():
                self.total[k][g[:-1]] += c
                self.held[k][g[:-1]] += self.d[k][min(c, 3) - 1]

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / 256
        lower = self.p(g[1:])
        if not self.total[k][g[:-1]]:
            return lower
        c = self.c[k][g]
        cut = self.d[k][min(c, 3) - 1] if c else 0
        return (c - cut + self.held[k][g[:-1]] * lower) / self.total[k][g[:-1]]

    def log10(self, t):
        n = quality.ORDER
        x = b" " * (n - 1) + t
        return sum(math.log10(self.p(x[i : i + n])) for i in range(len(t)))


LANGS = ["en", "fr", None]


def prose(n, seed=8):
    rng = np.random.default_rng(seed)
    return [" ".join("".join(rng.choice(["ab", "é", "cd", "#", "x", "日本"]) for _ in range(rng.integers(1, 5))) for _ in range(rng.integers(1, 120))) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_perplexities_against_brute_force(spark, monkeypatch, small):
    if small:  # many parts and buckets, and n-grams numbered by sorting
        monkeypatch.setattr(quality, "PART", 3000)
        monkeypatch.setattr(quality, "BUCKET", 500)
    texts = [*TEXTS[:9], *prose(60)]
    got = by_id(quality.judge(docs(spark, texts)))
    for k in range(3):
        own = [(i, (texts[i] or "").encode()) for i in range(k, len(texts), 3)]
        brute = Brute([t for _, t in own] + ([(texts[0] or "").encode()] if k == 0 else []))
        for i, t in own:
            if t:
                assert math.isclose(got[i].log_ppl, -brute.log10(t) / len(t), rel_tol=1e-5)
                words = len(WORD.findall(t.decode()))
                assert (got[i].word_ppl is None) if not words else math.isclose(got[i].word_ppl, -brute.log10(t) / words, rel_tol=1e-5)
            else:
                assert got[i].log_ppl is None and not got[i].kept
        for context in (b"    ", b" abc", "é".encode() + b"ab", b"zzzz"):
            assert math.isclose(sum(brute.p(context + bytes([w])) for w in range(256)), 1, rel_tol=1e-9)


def test_numbers_by_sorting(monkeypatch):
    text = np.frombuffer("abc abd aéc".encode() * 3, np.uint8)
    a = quality.Grams.read(text, np.array([0]))
    monkeypatch.setattr(quality, "CELLS", 0)
    b = quality.Grams.read(text, np.array([0]))
    for n in range(1, quality.ORDER + 1):
        assert (a.codes[n] == b.codes[n]).all() and (a.at[n] == b.at[n]).all()
        for i in range(n - 1, len(text)):
            assert int(a.codes[n][a.at[n][i]]) == int.from_bytes(text[i - n + 1 : i + 1].tobytes(), "big")


def test_what_is_asked_does_not_depend_on_the_order_of_rows():
    import pyarrow as pa

    texts = ["abc", "", "é xyz", "zz"] * 3 + ["q" * 50]
    langs = ["=en", "=fr"] * (len(texts) // 2) + ["=en"]
    one, two = quality.asked(langs, pa.array(texts)), quality.asked(langs[::-1], pa.array(texts[::-1]))
    assert (one == two).all() and (np.diff(one.astype(object)) > 0).all()


def counts_of(texts):
    """n-grams of ORDER bytes as counting cuts the texts."""
    import pyarrow as pa

    return Counter(t[i : i + quality.ORDER].tobytes() for t in quality._texts(pa.array(texts)) for i in range(len(t) - quality.ORDER + 1))


@pytest.mark.parametrize("stretch", [5, 16, 1000])
def test_stretches_of_long_texts(monkeypatch, stretch):
    """What a text asks for, and its score, are the same however it is cut into stretches."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("ab é\n"), n)) for n in (0, 3, 200, 17, 400)] + [None, "abab"]
    langs = ["=en", "=fr", "=en", "=fr", "=fr", "=en", "=en"]
    whole = quality.asked(langs, pa.array(texts))
    logs, backs = -rng.random((2, len(whole)))
    logs[rng.random(len(logs)) < 0.4] = backs[rng.random(len(backs)) < 0.2] = np.nan
    want = quality.log10_of(langs, pa.array(texts), whole, logs, backs)
    counted = counts_of(texts)
    monkeypatch.setattr(quality, "STRETCH", stretch)
    cut = quality.asked(langs, pa.array(texts))
    at, known = quality.search(whole, cut)  # what stands at the first bytes of a stretch is asked too, and never looked at
    told = [np.where(known, x[at], np.nan) for x in (logs, backs)]
    assert np.allclose(quality.log10_of(langs, pa.array(texts), cut, *told), want) and (want[[1, 2, 3, 4, 6]] < 0).all() and want[0] == want[5] == 0
    assert counts_of(texts) == counted


def test_other_texts_with_a_stored_model(spark):
    texts, new = prose(40), ["zzz never seen ÿ", "ab cd", None, "ab"]
    model = quality.Model.fit(docs(spark, texts).withColumn("lang", F.lit("en")))
    got = by_id(quality.judge(docs(spark, new).withColumn("lang", F.lit("en")), model=model))
    brute = Brute([t.encode() for t in [*texts, texts[0]]])
    for k, t in enumerate(new):
        assert got[k].log_ppl is None if t is None else math.isclose(got[k].log_ppl, -brute.log10(t.encode()) / len(t.encode()), rel_tol=1e-5)


def test_verdicts(spark):
    """What is kept follows from the perplexities by the documented bands."""
    texts = prose(300, seed=3)
    rows = quality.judge(docs(spark, texts).dropDuplicates(["doc_id"]), keep=("doc_id", "lang")).toPandas()
    rows["kind"] = [int(math.log2(len(texts[k].encode()))) for k in rows.doc_id]
    fine = rows[~rows.base_failed]
    kept = ~rows.base_failed
    for of in ("log_ppl", "word_ppl"):
        for lang, own in fine.groupby(fine.lang.fillna("")):
            for kind in set(rows.kind):
                far = (own.kind - kind).abs()
                reach = next((d for d in range(int(far.max()) + 1) if (far <= d).sum() >= quality.ENOUGH), far.max())
                v = sorted(math.floor(x * quality.BINS) / quality.BINS for x in own[far <= reach][of])
                low, mid, high = (v[max(math.ceil(q * len(v)) - 1, 0)] for q in (0.25, 0.5, 0.75))
                here = (rows.lang.fillna("") == lang) & (rows.kind == kind) & (rows.kind.isin(own.kind))
                kept &= ~here | rows[of].between(mid - quality.WIDTH * max(mid - low, quality.LEAST), mid + quality.WIDTH * max(high - mid, quality.LEAST))
    assert (kept == rows.kept).mean() > 0.99 and 0 < rows.kept.sum() < len(rows)


def test_query(spark, tmp_path):
    docs(spark, [*TEXTS, *prose(20)]).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op4_quality_perplexity"](spark, str(tmp_path))
    kinds = dict(out.dtypes)
    assert all(kinds[c] == "bigint" for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) and kinds["base_failed"] == kinds["kept"] == "boolean"
    assert out.count() == len(TEXTS) + 21
