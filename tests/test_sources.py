"""Folders that are walked without build output, and documents that tasks write."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lintlake import api, reports
from lintlake.plans import review as plan
from lintlake.plans.review import Options, review
from lintlake.sources.tree import TreeReader, read_tree
from lintlake.sources.units import whole_files

from .test_review import MAPPER, SERVICE, units


@pytest.fixture
def tree(tmp_path):
    files = {"a/X.java": "x" * 10, "a/Y.JAVA": "yé", "b.xml": "<b/>", "c d/e.xml": "<e/>", "n.txt": "no", "z/skip.java": "s", "empty.java": ""}
    shut = ["a/target", "a/deep/Build/more", ".git/objects", "node_modules", "gen/generated"]
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    for d in shut:
        for k in range(5):
            (tmp_path / d / f"s{k}").mkdir(parents=True)
            (tmp_path / d / f"s{k}" / "T.java").write_text("never read")
    return tmp_path


def test_walks_never_enter_build_output(tree):
    r = TreeReader(str(tree), ["z/**"], 1 << 20)
    parts = r.partitions()
    assert sorted(r.listed) == ["", "a", "a/deep", "c d", "gen", "z"]  # each folder once, nothing below build output
    assert [p.paths for p in parts] == [["a/X.java", "a/Y.JAVA", "b.xml", "c d/e.xml", "empty.java"]]


def test_files_are_dealt_by_size(tree):
    parts = TreeReader(str(tree), [], 8).partitions()
    assert [(p.first, p.paths) for p in parts] == [(0, ["a/X.java"]), (1, ["a/Y.JAVA", "b.xml", "c d/e.xml"]), (4, ["empty.java", "z/skip.java"])]
    assert [p.paths for p in TreeReader(str(tree / "gen"), [], 8).partitions()] == [[]]


def test_reading(spark, tree):
    df = read_tree(spark, str(tree), ("z/**",), 8)
    assert df.rdd.getNumPartitions() == 3
    want = [(0, "a/X.java", "x" * 10), (1, "a/Y.JAVA", "yé"), (2, "b.xml", "<b/>"), (3, "c d/e.xml", "<e/>"), (4, "empty.java", "")]
    assert sorted(map(tuple, df.collect())) == want
    assert sorted(map(tuple, read_tree(spark, f"file://{tree}", ("z/**",)).collect())) == want
    assert read_tree(spark, str(tree / "gen")).count() == 0
    os.remove(tree / "b.xml")
    assert read_tree(spark, str(tree)).count() == 5


def test_files_are_reviewed_in_the_order_of_their_paths(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"f{k:02d}.xml").write_text("<doc/>" if k % 2 else "<mapper namespace='a'></mapper>")
    for r in (api.review_tree(spark, str(tmp_path)), api.review_paths(spark, ["."], str(tmp_path))):
        left = r.skipped.orderBy("stage", "seq").collect()
        assert [s.path for s in left] == [f"f{k:02d}.xml" for k in range(12)]


def test_documents_are_those_of_the_driver(spark, tmp_path):
    odd = "<mapper namespace='ü'>\n<select id='q'>select * from \"t\" \\ \t where a = ${x}</select>\n</mapper>"
    r = review(units(spark, *[(f"m{k}.xml", MAPPER) for k in range(4)], ("S.java", SERVICE), ("ü.xml", odd), ("h.xml", "<html/>"), ("c.xml", "<mapper></mapper>")), options=Options(experimental=True))
    none = review(units(spark, ("n.txt", "x")))
    for k, one in enumerate((r, none)):
        c = reports.Collected.of(one)
        for kind, text in (("json", reports.render_json(c)), ("sarif", reports.render_sarif(c))):
            path = tmp_path / f"{k}.{kind}"
            reports.save_document(one, str(path), kind)
            assert path.read_text() == text and json.loads(text)
            reports.save_document(one, str(path), kind)  # over what was there
            assert path.read_text() == text
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0.json", "0.sarif", "1.json", "1.sarif"]


def draft(c, line="1"):
    return c.units.select("path", F.lit(90).alias("rule_ord"), F.array(F.lit(0)).alias("draft_seq"), F.lit("OWN001").alias("rule"), F.lit("warn").alias("severity"), F.expr(line).cast("int").alias("line"), F.lit(1).alias("end_line"), F.lit("seen").alias("message"), F.lit(None).cast("string").alias("suggestion"))


def test_a_rule_that_cannot_be_built(spark):
    def broken(c):
        raise KeyError("no such table")

    r = review(units(spark, ("m.xml", MAPPER), ("S.java", SERVICE)), own_rules=[draft, broken], own_ids=["OWN001", "OWN002"])
    found = {(x.rule, x.file) for x in r.findings.collect()}
    assert {("OWN001", "m.xml"), ("OWN001", "S.java"), ("SPR002", "S.java"), ("MYB004", "m.xml")} <= found
    assert {(s.path, s.reason) for s in r.skipped.collect()} == {("m.xml", "OWN002: 'no such table'"), ("S.java", "OWN002: 'no such table'")}


def test_a_rule_that_fails_on_one_unit(spark):
    """The rule is skipped for that unit alone, and all other rules and units keep their findings."""
    fails = lambda c: draft(c, "case when content like '%BOOM%' then raise_error('BOOM') else '1' end")
    files = [(f"A{k}.java", "class A {\n int BOOM;\n}" if k == 3 else f"class A{k} {{ }}") for k in range(9)] + [("m.xml", MAPPER)]
    r = review(units(spark, *files), own_rules=[fails], own_ids=["OWN001"])
    assert {x.file for x in r.findings.filter("rule = 'OWN001'").collect()} == {n for n, _ in files} - {"A3.java"}
    assert {x.rule for x in r.findings.filter("file = 'm.xml'").collect()} >= {"MYB001", "MYB004", "MYB005"}
    (left,) = r.skipped.collect()
    assert left.path == "A3.java" and left.reason.startswith("OWN001: ") and "BOOM" in left.reason


def test_a_built_in_rule_that_fails(spark, monkeypatch):
    def broken(c):
        raise ValueError("odd")

    monkeypatch.setitem(plan.MAKE, "MYB004", broken)
    r = review(units(spark, ("m.xml", MAPPER), ("A.java", "class A { }")))
    assert {x.rule for x in r.findings.collect()} >= {"MYB001", "MYB005"} and "MYB004" not in {x.rule for x in r.findings.collect()}
    assert {(s.path, s.reason) for s in r.skipped.collect()} == {("m.xml", "MYB004: odd"), ("A.java", "MYB004: odd")}
