"""Classes of near duplicates by b-bit minhash against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import bbit_minhash as bb
from lintlake.llm.queries import QUERIES

from .test_jaccard import near_copies
from .test_operators import ASCII_LOWER, SCHEMA, TEXTS, WORD, empty


def sets_of(texts, words=3):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute(rows, percent=85):
    """(n_shingles, component_id, kept) of each row; rows: (doc_id, text)."""
    sets, top = sets_of([t for _, t in rows]), list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [x for x in least[find(k)] if x is not None]
        c = min(ids) if ids else None
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 1, "h", "p") for i, t in rows], SCHEMA)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def chain(n):
    """Texts of which only neighbours are alike: classes hold pairs that are no links."""
    words = [f"c{k}" for k in range(60 + 2 * n)]
    return [" ".join(words[2 * k : 2 * k + 60]) for k in range(n)]


@pytest.mark.parametrize("block", [512, 4])
def test_against_all_pairs(spark, block):
    base = [f"t{k}" for k in range(60)]
    group = [" ".join(base[:k] + [f"z{k}"] + base[k:]) for k in range(0, 60, 2)]
    texts = [*TEXTS, *group, *near_copies(60), *chain(20), "One two", "one TWO", "one", "two one"]
    rows = [*enumerate(texts), (0, texts[0]), (500, texts[0]), (7, "another text of one id"), (None, texts[12]), (None, "alone"), (None, None)]
    got = result(bb.dedup(table(spark, rows), block=block))
    assert got == brute(rows)


def test_threshold_is_exact(spark):
    words = [f"e{k}" for k in range(102)]
    own = " ".join(words)  # 100 shingles
    near = " ".join(words[:-15] + [f"f{k}" for k in range(7)])  # 85 common of 107 ... not alike
    cut = " ".join(words[:-15])  # 85 of 100: alike
    less = " ".join(words[:-16])  # 84 of 100: not alike to the whole, but to the one cut
    got = {r.doc_id: r.component_id for r in bb.dedup(table(spark, [(1, own), (2, near), (3, cut)])).collect()}
    assert got[3] == 1 and dict(got)[2] == {r[0]: r[2] for r in brute([(1, own), (2, near), (3, cut)])}[2]
    assert {r.component_id for r in bb.dedup(table(spark, [(1, own), (4, less)])).collect()} == {1, 4}


def test_estimates_and_bands():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 1 << 63, 3000).astype(np.uint64)
    for share in (0.3, 0.6, 0.85):
        common = int(2000 * share / (1 + share))
        a, b = pool[:1000], np.concatenate([pool[:common], pool[1000 : 2000 - common]])
        least = bb.minima(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 1000, 2000]), 1024)
        for bits in (1, 4, 8):
            s = bb.packed(least, bits)
            assert s.shape == (2, bits * 16)
            differ = bb.mismatches(s[0], s[1:], bits)
            assert differ[0] == ((least[0] ^ least[1]) & np.uint64((1 << bits) - 1) != 0).sum()
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs(bb.agreement(differ, 1024, bits)[0] - true) < 0.1
    assert bb.bands_for(0.85) * bb.ROWS <= bb.HASHES and (1 - 0.85**bb.ROWS) ** bb.bands_for(0.85) <= 1 - bb.RECALL
    assert bb.floor_of(0.85, 128, 4) < 0.85


def test_column_form_of_the_estimate(spark):
    s = bb.packed(np.random.default_rng(2).integers(0, 1 << 63, (2, 128)).astype(np.uint64), 4)
    df = spark.createDataFrame([(s[0].view(np.int64).tolist(), s[1].view(np.int64).tolist())], "a array<long>, b array<long>")
    assert df.select(bb.mismatches_of("a", "b", 128, 4)).first()[0] == bb.mismatches(s[0], s[1:], 4)[0]


def test_clashing_and_empty(spark):
    rows = list(enumerate(near_copies(5)))
    df = table(spark, rows).withColumns({"kept": F.lit("own"), "node": F.lit(1), "component_id": F.lit(1.5)})
    out = bb.dedup(df, keep=("doc_id", "text", "node", "kept"))
    assert out.columns == ["doc_id", "text", "node", "n_shingles", "component_id", "kept"]
    assert bb.dedup(empty(spark)).count() == 0
    assert bb.dedup(table(spark, [(1, None), (2, " ")])).count() == 2


def test_query(spark, tmp_path):
    rows = list(enumerate([*TEXTS, *near_copies(15)]))
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_bbit_minhash"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and result(out) == brute(rows)
