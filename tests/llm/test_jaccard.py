"""The Jaccard join against all pairs, repeated ids, and the pipeline stage that it decides."""

import numpy as np
import pytest

from lintlake.llm import jaccard_join
from lintlake.llm.queries import QUERIES

from .test_operators import ASCII_LOWER, TEXTS, WORD, by_id, docs, empty


def brute_links(texts):
    sets = {}
    for k, t in enumerate(texts):
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_jaccard_join(spark, monkeypatch):
    base = [f"t{k}" for k in range(60)]
    group = [" ".join(base[:k] + [f"z{k}"] + base[k:]) for k in range(0, 60, 3)]
    texts = [*TEXTS, *group]
    links = brute_links(texts)
    df = docs(spark, texts).limit(len(texts))
    for limit in (512, 4):  # the second one splits every bucket to the last level
        got = by_id(jaccard_join.jaccard_join(df, limit=limit))
        assert {k: r.n_links for k, r in got.items()} == {k: sum(k in p for p in links) for k in range(len(texts))}
        assert all(got[a].class_id == got[b].class_id for a, b in links)
    assert got[3].class_id == 3 and got[2].copy_of == 0
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0


def near_copies(n, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        base = [f"u{rng.integers(10**6)}" for _ in range(rng.integers(8, 120))]
        out.append(" ".join(base))
        for _ in range(rng.integers(0, 4)):
            own = list(base)
            for _ in range(rng.integers(1, 6)):
                own[rng.integers(len(own))] = f"v{rng.integers(10**6)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("limit", [512, 3])
def test_every_link_is_found(spark, limit):
    texts = near_copies(150)
    links = brute_links(texts)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = by_id(jaccard_join.jaccard_join(rows, limit=limit))
    assert len(links) > 30 and sum(r.n_links for r in got.values()) == 2 * len(links)
    top = list(range(len(texts)))
    for a, b in sorted(links):
        old = {top[a], top[b]}
        top = [min(old) if x in old else x for x in top]
    assert {k: r.class_id for k, r in got.items()} == dict(enumerate(top))


def test_runs_allow_for_splits():
    assert jaccard_join.runs_for(0.8, 0.9999, depth=1) == 6 and jaccard_join.runs_for(0.8, 0.9999, depth=4) == 8


IDS = [(3, "a b c d e f g"), (7, "a b c d e f g"), (7, "quite another text than that"), (7, "quite another text than that"), (None, "a b c d e f g"), (9, None), (9, None), (9, ""), (2, "h i j k l m n o p"), (2, "h i j k l m n o p q")]


def test_repeated_ids(spark):
    rows = spark.createDataFrame(IDS, "doc_id long, text string")
    got = jaccard_join.jaccard_join(rows).collect()
    assert sum(r.stays for r in got) == 1 + 2 + 3 + 1  # one of the first class, both equal rows of the second, three without words


def test_stage_keeps_texts_of_repeated_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in IDS], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.text or "", r.doc_id or 0) for r in pipeline.near_duplicates(spark, rows, "").collect())
    assert got == [("", 9), ("", 9), ("", 9), ("a b c d e f g", 0), ("h i j k l m n o p", 2), ("quite another text than that", 7)]


def test_query(spark, tmp_path):
    texts = [*TEXTS, *near_copies(20)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op7_jaccard_join"](spark, str(tmp_path))
    assert dict(out.dtypes) | {} == {"doc_id": "bigint", "class_id": "bigint", "copy_of": "bigint", "n_links": "bigint", "text_key": "bigint"}
    assert out.count() == len(texts) + 1
