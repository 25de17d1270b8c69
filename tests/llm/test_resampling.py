"""Interning against the library and dictionaries, and the draw against a brute-force one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lintlake.llm import ngram_table, resampling
from lintlake.llm.queries import QUERIES

from .test_operators import ASCII_LOWER, SCHEMA, TEXTS, empty

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, shortest=1, longest=1):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    return [" ".join(words[i : i + k]) for k in range(shortest, longest + 1) for i in range(len(words) - k + 1)], len(words)


def brute(rows, target, shortest=1, longest=1, buckets=10_000, min_words=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [features(t, shortest, longest) for _, t in rows]
    s, t = Counter(bucket(f) for fs, _ in own for f in fs), Counter(bucket(f) for x in target for f in features(x, shortest, longest)[0])
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    out = []
    for (i, _), (fs, words) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    drawn = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def test_hashes_equal_the_library():
    rng = random.Random(1)
    keys = [rng.randbytes(n) for n in [*range(70), 31, 32, 33, 500]]
    at = np.cumsum([0, *map(len, keys)])
    buf = np.frombuffer(b"".join(keys) + bytes(8), np.uint8)
    got = ngram_table.xxhash64(buf, at[:-1], np.diff(at))
    assert got.tolist() == [xxhash.xxh64_intdigest(k) for k in keys]


@pytest.mark.parametrize("collide", [False, True])
def test_interning(monkeypatch, collide):
    """Slots hold each n-gram once with its count, also where hashes are equal and only bytes tell n-grams apart."""
    if collide:
        monkeypatch.setattr(ngram_table, "xxhash64", lambda buf, starts, sizes: np.full(len(starts), 7, np.uint64))
    rng = random.Random(2)
    vocabulary = [bytes(rng.choices(b"abc", k=rng.randint(1, 20))) for _ in range(60)]
    keys = [rng.choice(vocabulary) for _ in range(500)]
    at = np.cumsum([0, *map(len, keys)])
    t = ngram_table.NgramTable(np.frombuffer(b"".join(keys) + bytes(8), np.uint8), at[:-1], at[1:], 97)
    slots = {}
    for k, s in zip(keys, t.slot_of.tolist(), strict=True):
        assert slots.setdefault(k, s) == s
    assert len(set(slots.values())) == len(set(keys))
    assert {k: int(t.count[s]) for k, s in slots.items()} == Counter(keys)
    assert all(t.bucket[s] == zlib.crc32(k) % 97 for k, s in slots.items())
    want = Counter(zlib.crc32(k) % 97 for k in keys)
    assert t.bucket_counts(97).tolist() == [want[b] for b in range(97)]
    assert t.gather(np.arange(97) * 2).tolist() == [zlib.crc32(k) % 97 * 2 for k in keys]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 1, "h", "p") for i, t in rows], SCHEMA)


def rows():
    rng = random.Random(3)
    words = [f"Wort{k}" for k in range(80)] + ["été", "Straße", "x9", "語"]
    out = [(k, " ".join(rng.choices(words, k=rng.randint(5, 60)))) for k in range(200)]
    return [*out, *[(1000 + k, t) for k, t in enumerate(TEXTS)], (3, out[3][1]), (None, out[5][1]), (2000, "-- \x00 .")]


@pytest.mark.parametrize(("shortest", "longest", "buckets", "percent"), [(1, 1, 10_000, 10), (1, 3, 500, 50), (2, 2, 64, 100)])
def test_draw(spark, shortest, longest, buckets, percent):
    target = ["Wort1 Wort2 Wort3 Wort1", None, "", "été Wort7"]
    got = resampling.resample(table(spark, rows()), spark.createDataFrame([(t,) for t in target], "text string"), shortest=shortest, longest=longest, buckets=buckets, percent=percent)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()), key=key) == sorted(brute(rows(), target, shortest, longest, buckets, percent=percent), key=key)


def test_long_text_in_stretches(spark):
    text = " ".join(f"w{k % 5000}" for k in range(1_500_000))  # over 8 MB, read in three stretches
    one = resampling.bucket_counts(spark.createDataFrame([(text,)], "text string"), "text", 1000, 1, 2).collect()
    want = Counter(zlib.crc32(f.encode()) % 1000 for f in features(text, 1, 2)[0])
    assert {r.bucket: r.n for r in one} == want


def test_keeps_texts_and_empty_tables(spark):
    target = spark.createDataFrame([("Wort1",)], "text string")
    out = resampling.resample(table(spark, rows()).withColumn("rank", F.lit("own")), target, keep=("doc_id", "text", "rank"))
    assert out.columns == ["doc_id", "text", "n_features", "n_words", "weight", "score", "rank"]
    assert {r.text for r in out.filter("rank is not null").collect()} <= {t for _, t in rows()}
    assert resampling.resample(empty(spark), target).count() == 0
    assert resampling.resample(table(spark, rows()), target.limit(0)).filter("rank is not null").count() > 0


def test_query(spark, tmp_path):
    table(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Wort1 Wort2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = QUERIES["op12_importance_resampling"](spark, str(tmp_path))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute(rows(), ["Wort1 Wort2"]), key=key)
