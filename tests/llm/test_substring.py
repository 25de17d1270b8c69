"""Substring dedup against a brute-force version, on passages in mid-sentence, and through the registered query."""

import collections

import numpy as np

from lintlake.llm import substring_dedup
from lintlake.llm.common import span_hashes
from lintlake.llm.queries import QUERIES

from .test_operators import ASCII_LOWER, PASSAGE, TEXTS, WORD, by_id, docs, empty, sentence


def cut(text):
    """Sentences as (start, end of the last word, words), by the rules of the docstring, word by word."""
    words = [(m.start(), m.end(), m[0].translate(ASCII_LOWER)) for m in WORD.finditer(text)]
    value = {}
    for _, _, w in words:
        raw = np.frombuffer(w.encode(), np.uint8)
        value[w] = int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
    marked = [k for k, (_, e, w) in enumerate(words) if k == len(words) - 1 or w[-1] in ".!?" or "\n" in text[e : words[k + 1][0]]]
    out, first = [], 0
    for end in marked:
        own, since = words[first : end + 1], 0
        for k in range(len(own)):
            h = value[own[k][2]]
            before = [value[own[j][2]] for j in range(max(0, k - 3), k)]
            after = [value[own[j][2]] for j in range(k + 1, min(len(own), k + 4))]
            if k == len(own) - 1 or (all(h < x for x in before) and all(h <= x for x in after)):
                pieces = range(since, k + 1, 24)
                out += [own[j : min(j + 24, k + 1)] for j in pieces]
                since = k + 1
        first = end + 1
    return out


def brute(texts):
    """Removed sentences of each text, by its place in the list; equal texts have different ids."""
    runs, cuts = collections.defaultdict(list), [cut(t or "") for t in texts]
    for d, s in enumerate(cuts):
        for a in range(len(s) - 2):
            runs[tuple(w for x in s[a : a + 3] for _, _, w in x)].append((d, a))
    gone = [set() for _ in texts]
    for places in runs.values():
        for d, a in sorted(places)[1:]:
            gone[d] |= {a, a + 1, a + 2}
    return [len(s) for s in cuts], gone


def texts(n):
    rng = np.random.default_rng(11)
    pool = [" ".join(f"{'abcdefgh'[rng.integers(8)]}{rng.integers(40)}" for _ in range(rng.integers(1, 30))) + rng.choice([".", "!", "?", ""]) for _ in range(60)]
    return [rng.choice([" ", "\n", "  "]).join(rng.choice(pool, rng.integers(0, 14))) for _ in range(n)] + [*TEXTS, "same " * 400, "x " + "same " * 300, "One. Two. Three.", "Zero. One. Two. Three.", "Ünï. Ço. Dé. Ê.", "a Ünï. Ço. Dé. Ê. b"]


def test_against_brute_force(spark, monkeypatch):
    all_ = texts(150)
    sizes, gone = brute(all_)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(all_)], "doc_id long, text string")
    for share in (20_000, 7):  # the second one deals hot spans over many shares
        monkeypatch.setattr(substring_dedup, "SHARE", share)
        got = by_id(substring_dedup.remove_repeats(rows))
        assert {k: (r.n_sentences, r.n_removed) for k, r in got.items()} == {k: (n, len(g)) for k, (n, g) in enumerate(zip(sizes, gone, strict=True))}
    for k, t in enumerate(all_):
        kept = [w for j, s in enumerate(cut(t or "")) if j not in gone[k] for _, _, w in s]
        assert WORD.findall((got[k].text or "").translate(ASCII_LOWER)) == kept
        spans = [tuple(map(int, x.split(":"))) for x in got[k].removed_spans.split(",") if x]
        left = list(t or "")
        for a, z in reversed(spans):
            del left[a:z]
        assert "".join(left) == (got[k].text or "")


def test_clashing_columns_and_ids(spark):
    df = spark.createDataFrame([(1, PASSAGE, 7, "a", 1), (1, PASSAGE, 7, "a", 1), (1, "w " + PASSAGE, 8, "b", 2), (None, PASSAGE, 9, "c", 3)], "doc_id long, text string, n_removed long, hash string, share int")
    out = substring_dedup.remove_repeats(df)
    assert sorted(out.columns) == sorted(["doc_id", "text", "hash", "share", "n_sentences", "n_removed", "removed_spans"])
    got = {(r.doc_id, r.hash): r for r in out.collect()}
    assert got[None, "c"].n_removed == 0 and got[1, "a"].text == "" and len(got[1, "b"].text) < len(PASSAGE) / 2


def test_query(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op1_substring_dedup"](spark, str(tmp_path))
    _, gone = brute(TEXTS)
    assert {r.doc_id: r.n_removed for r in out.collect()} == {k: len(g) for k, g in enumerate(gone)}


def test_substring_dedup(spark):
    got = by_id(substring_dedup.remove_repeats(docs(spark)))
    assert got[0].text == TEXTS[0] and got[0].n_removed == 0
    assert "w" in got[1].text and sentence(1003) not in got[1].text and sentence(21) in got[1].text
    assert got[2].text == "" and got[3].text is None and got[6].text == "Hi"
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_short_passages_in_mid_sentence(spark):
    rng = np.random.default_rng(6)
    prose = lambda n, size: " ".join(f"v{rng.integers(10**6)}" + "." * (j % size == size - 1) for j in range(n))
    rows, runs = [], {}
    for k in range(60):
        n, size = 51 + k % 10, [9, 14, 20, 200][k % 4]
        source, host = prose(200, size).split(), prose(150, size).split()
        at, to = int(rng.integers(10, 130)), int(rng.integers(10, 130))
        rows += [(k, " ".join(source)), (1000 + k, " ".join(host[:to] + source[at : at + n] + host[to:]))]
        runs[1000 + k] = (source[at : at + n], host)
    got = by_id(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    left = [len(set(passage) & set(got[k].text.split())) / len(passage) for k, (passage, _) in runs.items()]
    assert max(left) < 1 and np.mean(left) < 0.35
    assert all(set(host) <= set(got[k].text.split()) for k, (_, host) in runs.items())
