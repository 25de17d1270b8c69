"""Every order of filters against applying them one after the other."""

import itertools
import re

from lintlake.llm import filter_audit
from lintlake.llm.queries import QUERIES

from .test_operators import WORD, empty

LABELS = "doc_id long, quality int, toxic int, n int"
LONG = " ".join(f"w{k}" for k in range(250))
TEXTS = [LONG, LONG, None, "", " \n\t", "a b c", "A B C" * 90, "x " * 300, LONG + " $", "a b c", "É" * 40 + " | Ünï", LONG.upper(), LONG + " x" * 400, "a b c", "ab\x0bcd\x0c" * 150]
LANGS = ["en", "en", "de", None, "", "en", "de", "de", "en", "de", "fr", "en", "en", None, "en"]


def rows():
    out = [(k, t, lang, "s", 1, 1, "h", "p") for k, (t, lang) in enumerate(zip(TEXTS, LANGS, strict=True))]
    return [*out, out[0], out[9], (None, LONG, "en", "s", 1, 1, "h", "p"), (None, "a b c", None, "s", 1, 1, "h", "p")]


def failures(k, text, first):
    words = WORD.findall(text)
    fails = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": k is not None and k > first[text],
    }
    return {x for x, f in fails.items() if f}


def brute(rows, labels):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    good, toxic = {i for i, q, *_ in labels if q == 1 and i is not None}, {i for i, _, t, *_ in labels if t == 1 and i is not None}
    docs = [(r[2] or "", failures(r[0], r[1] or "", first), r[0] in good, r[0] in toxic) for r in rows]
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                earlier = [d for d in own if x in d[1] and d not in gone and any(y in d[1] for y in order[: step - 1])]
                left = [d for d in left if x not in d[1]]
                removed_by[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(earlier), sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


def test_against_all_orders(spark):
    labels = [(0, 1, 0, 9), (1, 1, 1, 9), (1, 0, 0, 9), (5, None, 1, 9), (6, 1, None, 9), (99, 1, 1, 9), (None, 1, 1, 9), (13, 0, 1, 9)]
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long, n int, mask string, part string")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): [*r[3:]] for r in got} == brute(rows(), labels)
    assert len(got) == 4 * 600


def test_other_numbers_of_filters(spark):
    cells = spark.createDataFrame([("p", m, m + 1, 0, 0) for m in range(4)], "part string, mask int, docs long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.orders(cells, "XY").collect()}
    assert got == {("XY", 1): (4, 6, 0, 2, 8), ("XY", 2): (1, 3, 4, 3, 10), ("YX", 1): (3, 7, 0, 3, 10), ("YX", 2): (1, 2, 4, 2, 8)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(empty(spark), none).count() == 0
    docs = spark.createDataFrame(rows(), empty(spark).schema)
    assert all(r.good_lost == r.toxic_lost == 0 for r in filter_audit.audit(docs, none).collect())


def test_query(spark, tmp_path):
    docs = spark.createDataFrame(rows(), empty(spark).schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0, 9)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = QUERIES["op11_filter_audit"](spark, str(tmp_path))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [*r[3:]] for r in out.collect()} == brute(rows(), [(0, 1, 0)])
