"""The stages of the pipeline, each on what the one before kept, against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lintlake.llm import mixing, quality, secrets

from .test_jaccard import brute_links, near_copies
from .test_operators import TEXTS, sentence

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "Qx7kP2vR9sT4wY6zB1cD"


def rows():
    prose = [" ".join(sentence(100 * k + j) for j in range(8)) for k in range(1, 40)]
    copied = [f"{prose[0]} extra", prose[1], *[f"key {KEY} " + " ".join(sentence(7000 + 100 * k + j) for j in range(8)) for k in range(2)], " ".join(sentence(8000 + j) for j in range(8)) + " 0123456789abcdef01"]
    texts = [*TEXTS, *prose, *copied, *[t for t in near_copies(12) if len(t.split()) > 60]]
    return [(k, t, ["en", "fr", None][k % 3], ["s0", "s0", "s0", "s1", None][k % 5], len(t or "")) for k, t in enumerate(texts)] + [(3, None, "en", "s1", 0), (12, prose[2], "en", "s1", 1)]


def key(r):
    return tuple((x is None, x) for x in r)


def collect(df):
    return sorted((tuple(r) for r in df.select(*pipeline.COLUMNS).collect()), key=key)


def test_each_stage(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)

    kept = pipeline.quality_rules(spark, docs, "")
    judged = quality.judge(docs, keep=tuple(pipeline.COLUMNS)).filter("kept")
    now = collect(kept)
    assert now == collect(judged) and 30 < len(now) < len(rows())
    texts = [r[1] for r in now]
    assert all(t and len(t.split()) >= 50 for t in texts)
    kept = spark.createDataFrame(now, SCHEMA)

    links = brute_links(texts)
    top = list(range(len(now)))
    for a, b in sorted(links):
        old = {top[a], top[b]}
        top = [min(old) if x in old else x for x in top]
    classes = {}
    for k, r in enumerate(now):
        classes.setdefault(top[k], []).append(r)
    alone = [min(own, key=lambda r: r[0]) for own in classes.values()]
    unique = pipeline.near_duplicates(spark, kept, "")
    now = collect(unique)
    assert [r[0] for r in now] == sorted(r[0] for r in alone) and len(now) < len(texts)
    unique = spark.createDataFrame(now, SCHEMA)

    owners = {}
    for _, t, _, source, _ in now:
        base = [m[2] for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 12] + re.findall(secrets.ACCESS, t) + re.findall(secrets.HEX, t)
        for v in [*base, *re.findall(secrets.TOKEN, t)]:
            owners.setdefault(v, set()).add(source)
    looks = lambda v: bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= secrets.MIN_DISTINCT)
    live = sorted((v for v, o in owners.items() if len(o) <= secrets.MAX_OWNERS and looks(v)), key=lambda v: (-len(v), v))
    want = []
    for i, t, lang, source, _ in now:
        for v in live:
            t = t.replace(v, "[secret]")
        want.append((i, t, lang, source, len(t)))
    masked = pipeline.secret_scan(spark, unique, "")
    now = collect(masked)
    assert now == sorted(want, key=key) and any("[secret]" in r[1] for r in now)
    masked = spark.createDataFrame(now, SCHEMA)

    mixed = pipeline.source_mixing(spark, masked, "")
    before, count = now, Counter(map(tuple, mixed.select(*pipeline.COLUMNS).collect()))
    now = sorted(count.elements(), key=key)
    assert set(count) <= set(before)
    words = Counter()
    for r in before:
        words[r[3]] += len(r[1].split())
    names = sorted(words, key=lambda s: (s is not None, s))
    w = mixing.solve(np.array([float(words[s]) for s in names]), float(sum(words.values())))
    for s, share, repeats in zip(names, w.weights, w.repeats, strict=True):
        got = sum(n * len(r[1].split()) for r, n in count.items() if r[3] == s)
        assert share * sum(words.values()) - max(len(r[1].split()) for r in before) <= got <= share * sum(words.values()) + 1e-6
        assert {n for r, n in count.items() if r[3] == s} <= {int(repeats), int(repeats) + 1}

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = pipeline.bpe_encoding(spark, spark.createDataFrame(now, SCHEMA), "").collect()
    assert len(out) == len(now)
    by_id = {r[0]: r[1] for r in now}
    for r in out:
        ids = t.encode(by_id[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_stages_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "s", 0), (None, " ", None, "s", 1)], SCHEMA)
    assert pipeline.quality_rules(spark, blank, "").count() == 0
    for name in ("near_duplicates", "secret_scan"):
        assert dict(pipeline.STAGES)[name](spark, blank.withColumn("n_chars", F.col("n_chars")), "").count() == 3
    assert pipeline.bpe_encoding(spark, blank, "").filter("n_tokens > 0").count() <= 1
