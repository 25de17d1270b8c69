"""Rules as SQL text against the built-in ones, and table functions."""

from lintlake.functions import text as X
from lintlake.plans.review import Options, review
from lintlake.plans.sql_rules import SPR002, register, sql_rule
from lintlake.sources import corpus as C
from lintlake.sources.units import whole_files

from .test_review import SERVICE, units

SHOWN = ("rule", "file", "line", "end_line", "severity", "message", "suggestion", "snippet")


def rows(findings, rule):
    return sorted(tuple(r[c] for c in SHOWN) for r in findings.filter(f"rule = '{rule}'").collect())


def test_a_rule_in_sql_gives_the_same_findings(spark):
    files = whole_files(spark.createDataFrame([("S.java", SERVICE), *[(f"J{k}.java", t) for k, t in enumerate(C.JAVA_VARIANTS)]], "path string, content string"))
    built_in = rows(review(files, options=Options(only=("SPR002",))).findings, "SPR002")
    text = review(files, options=Options(only=("SPR001",)), own_rules=[sql_rule("SPR002", SPR002)], own_ids=["SPR002"]).findings
    assert rows(text, "SPR002") == built_in and len(built_in) > 1


def test_own_rules_in_sql(spark):
    many = sql_rule("OWN001", "SELECT path, array(member_ix) AS draft_seq, line, concat(name, ' has ', size(params), ' parameters') AS message FROM {members} WHERE size(params) > 1")
    wrong = sql_rule("OWN002", "SELECT path, no_such_column AS line FROM {members}")
    r = review(units(spark, ("S.java", SERVICE)), own_rules=[many, wrong], own_ids=["OWN001", "OWN002"])
    assert [(x.line, x.message) for x in r.findings.filter("rule = 'OWN001'").orderBy("line").collect()] == [(16, "save has 2 parameters"), (19, "load has 2 parameters"), (20, "keyed has 2 parameters")]
    assert [(s.path, s.reason.split(":")[0]) for s in r.skipped.collect()] == [("S.java", "OWN002")]


def test_table_functions(spark):
    register(spark)
    df = units(spark, ("S.java", SERVICE), ("E.java", "")).select("path", X.mask_java(X.F.col("content")).alias("m"), X.mask_java_comments(X.F.col("content")).alias("c"))
    got = spark.sql("SELECT u.path, f.name, f.arity FROM {u} u, LATERAL java_members(u.m, u.c) f WHERE f.kind = 'method'", u=df).collect()
    assert {(r.path, r.name, r.arity) for r in got} == {("S.java", n, k) for n, k in (("place", 1), ("save", 2), ("fire", 0), ("load", 2), ("keyed", 2))}
