import random
import re

import pytest
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions import text as X
from lintlake.functions.java_text import annotation_args, arity, naive_arity, split_top


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("r")).first().r


def reference_mask(src):
    """A character-wise state machine for comments, text blocks, strings and characters."""
    out, i, n = list(src), 0, len(src)

    def blank(a, b):
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        if src.startswith("//", i):
            j = src.find("\n", i)
            j = n if j < 0 else j
        elif src.startswith("/*", i):
            j = src.find("*/", i + 2)
            j = n if j < 0 else j + 2
        elif src.startswith('"""', i):
            j = src.find('"""', i + 3)
            j = n if j < 0 else j + 3
        elif src[i] in "\"'":
            j = i + 1
            while j < n and src[j] != "\n" and src[j] != src[i]:
                j += 2 if src[j] == "\\" else 1
            j += 1 if j < n and src[j] == src[i] else 0
        else:
            i += 1
            continue
        blank(i, j)
        i = j
    return "".join(out)


def test_masks_agree_with_a_state_machine(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice('ab"\'\\/*\n {') for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], ["t"]).select("t", X.mask_java(F.col("t")).alias("m")).collect()
    assert [r.m for r in rows] == [reference_mask(r.t) for r in rows]


def test_matches_and_lines(spark):
    t = "a1\nbb22\n\n333"
    rows = spark.createDataFrame([(t,)], ["t"]).select(F.explode(X.matches(F.col("t"), "[0-9]+")).alias("m"), "t").select("m.*", X.line_at(F.col("t"), F.col("m.start")).alias("line")).collect()
    assert [(r.start, r.end, r.text, r.line) for r in rows] == [(1, 2, "1", 1), (5, 7, "22", 2), (9, 12, "333", 4)]
    assert one(spark, F.size(X.matches(F.col("t"), "z")), t="") == 0


def test_snippet_and_short_forms(spark):
    assert one(spark, X.snippet(X.lines_of(F.col("t")), F.lit(2), F.lit(9)), t="a\n  b \n\n c") == "b\nc"
    assert len(one(spark, X.snippet(X.lines_of(F.col("t")), F.lit(1), F.lit(1)), t="x" * 500)) == 401
    assert one(spark, X.shorten_path(F.col("t")), t="a/b/c/d.java") == "…/c/d.java"
    assert one(spark, X.escape_property(F.col("t")), t="a:b c%\n") == "a%3Ab%20c%25%0A"
    assert one(spark, X.normalize_newlines(F.col("t")), t="a\r\nb\rc") == "a\nb\nc"


def test_brace_pairs(spark):
    df = spark.createDataFrame([(1, "{a{}}{"), (2, "}{}")], ["k", "t"])
    rows = X.brace_pairs(df, "t", "k").collect()
    assert sorted((r.k, r.open, r.close) for r in rows) == [(1, 0, 4), (1, 2, 3), (1, 5, -1), (2, 1, 2)]


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/a.xml", "x/y/a.xml", True), ("**/a.xml", "a.xml", True), ("*.xml", "x/a.xml", False), ("x/?.xml", "x/a.xml", True), ("x/[a].xml", "x/[a].xml", True), ("a.xml", "abxml", False)])
def test_globs(glob, path, hit):
    assert bool(re.match(P.glob_regex(glob).replace(r"\z", r"\Z"), path)) is hit


def test_paths(spark):
    rows = spark.createDataFrame([("a/target/X.java",), ("target/X.java",), ("b/C.XML",), ("n.kt",)], ["p"]).select(P.reviewable(F.col("p")).alias("r"), P.pruned(F.col("p")).alias("q")).collect()
    assert [(r.r, r.q) for r in rows] == [(False, True), (True, True), (True, False), (False, False)]
    assert one(spark, P.namespace_path(F.col("t")), t=" a.b.C ") == "a/b/C.java"
    assert one(spark, P.namespace_keys(F.col("t")), t="m/src/main/java/a/java/B.java") == ["B.java", "a/java/B.java"]


def test_argument_text():
    assert split_top("a, Map<K, V> m, f(x, y)") == ["a", "Map<K, V> m", "f(x, y)"]
    assert (arity(""), arity("a, f(b, c), d[1]"), naive_arity("a,,b")) == (0, 3, 2)
    assert annotation_args('propagation = Propagation.REQUIRES_NEW, rollbackFor = {A.class}, key = "#x"') == {"propagation": "REQUIRES_NEW", "rollbackFor": "class", "key": "#x"}
    assert annotation_args('"c"') == {"value": "c"}
    assert annotation_args(None) == {}
