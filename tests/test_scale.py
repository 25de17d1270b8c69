"""How plans grow: what is dealt out, worked out once, and left uncompiled."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lintlake.functions import text as X
from lintlake.operators import java_structure as J
from lintlake.operators import mapper_xml as mx
from lintlake.plans import review as R
from lintlake.plans import rules_sql as rs
from lintlake.session import WIDE
from lintlake.sources import corpus as C
from lintlake.sources.units import whole_files

SF = "/root/testdata/sf0.001"


def test_variants_and_patches_of_small_files_are_dealt_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert C.variant_units(spark, SF).rdd.getNumPartitions() >= 2 * cores
    assert C.patch_kinds(spark, SF).rdd.getNumPartitions() >= cores


def test_fragments_are_resolved_before_scopes_are_exploded(spark):
    el = spark.createDataFrame([], "path string, els array<struct<el_ord:int,closing:boolean,name:string,attrs:string,self_closing:boolean,body:string,line:int,body_line:int>>")
    plan = mx.xml_scopes(el, "path")._jdf.queryExecution().analyzed().toString()
    assert "transform_values" in plan and "transform_values" not in plan[: plan.index("Generate")]


def test_texts_are_not_split_by_a_pattern(spark):
    df = spark.createDataFrame([("a1\n22﷐ b﷐3",), ("",), ("none",), ("﷐7",), (None,)], "text string")
    found = df.select("text", X.matches(df.text, "[0-9]+").alias("m"), X.matched_lines(df.text, "[0-9]+").alias("l"))
    assert "split(text, [0-9]+" not in found._jdf.queryExecution().analyzed().toString()
    for r in found.collect():
        if r.text is not None:
            own = [(x.start(), x.end(), x[0], r.text[: x.start()].count("\n") + 1) for x in re.finditer("[0-9]+", r.text)]
            assert [tuple(x) for x in r.m] == own
            assert [tuple(x) for x in r.l] == [x[2:] for x in own]


def test_wide_queries_run_in_methods_that_are_compiled(spark):
    found = entry.queries()
    (key, limit), = WIDE.items()
    before = spark.conf.get(key)
    found["patch_line_numbers"](spark, SF)
    assert spark.conf.get(key) == limit
    found["op3_token_counts"](spark, SF)
    assert spark.conf.get(key) == before


def test_files_that_no_active_rule_concerns_are_read_no_further(spark, monkeypatch):
    files = [("A.java", C.JAVA_VARIANTS[7]), ("B.java", C.JAVA_VARIANTS[0]), ("x.xml", C.XML_VARIANTS[1]), ("y.xml", C.XML_VARIANTS[3]), ("z.xml", "<doc/>"), ("e.xml", "<mapper></mapper>")]
    read, own = [], J.java_structure
    monkeypatch.setattr(R, "java_structure", lambda units: read.append(units) or own(units))
    r = R.review(whole_files(spark.createDataFrame(files, "path string, content string")), options=R.Options(only=("MYB003",)))
    assert [x.file for x in read[0].select("file").collect()] == ["A.java"]
    assert {(x.file, x.line) for x in r.findings.collect()} == {(f, n) for f, texts, v in (("A.java", C.JAVA_VARIANTS, 7), ("x.xml", C.XML_VARIANTS, 1)) for w, n, rule, *_ in C.expected(texts) if (w, rule) == (v, "MYB003")}
    # what is skipped, and what was reviewed, does not depend on it
    assert {(x.path, x.reason) for x in r.skipped.collect()} == {("z.xml", "not a mapper XML"), ("e.xml", "no mapper SQL in this file")}
    assert r.units.count() == 5


def test_marked_files_hold_what_their_rules_look_for():
    for k, texts in enumerate((C.JAVA_VARIANTS, C.XML_VARIANTS)):
        for v, _, rule, *_ in C.expected(texts):
            bare = re.sub("//!.*|<!--!.*?-->", "", texts[v])
            assert re.search(R.HOLDS[rule][k], bare), (rule, v)
    assert set(R.HOLDS) == set(R.MAKE)


def test_words_may_be_put_together_across_cdata(spark):
    text = '<mapper namespace="a">\n<select id="q">select a from t where n li<![CDATA[ke \'%x\']]></select>\n</mapper>'
    r = R.review(whole_files(spark.createDataFrame([("m.xml", text)], "path string, content string")), options=R.Options(only=("MYB003",)))
    assert [x.line for x in r.findings.collect()] == [2]


def test_structures_are_held_for_a_few_files_at_once(spark, monkeypatch):
    calls, own = [], J.analyzed
    monkeypatch.setattr(J, "analyzed", lambda *r: calls.append(r[0]) or own(*r))
    names = [f"F{k}" for k in range(2 * J.FILES + 1)]
    batch = pa.RecordBatch.from_pydict({"path": names, "masked": ["class A { }"] * len(names), "commented": ["class A { }"] * len(names)})
    out = J.structures(iter([batch]), pa.schema([("path", pa.string())]))
    assert next(out).num_rows == len(calls) == J.FILES
    assert sum(b.num_rows for b in out) == J.FILES + 1 and calls == names


def test_patches_are_read_once_and_dealt_once(spark):
    plan = entry.queries()["patch_line_numbers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def mapper_files(spark):
    texts = {
        "joined": '<mapper namespace="a.B"><select id="s">select $<![CDATA[{x}]]> from t</select></mapper>', "apart": '<mapper namespace="a.C"><select id="s">select $<!-- -->{x}<if/> from t</select></mapper>',
        "plain": '<mapper namespace="a.D"><select id="s">select ${x} from t</select></mapper>', "none": '<mapper><select id="s">select a</select></mapper>', "include": '<mapper namespace="a.E"><select id="s"><INCLUDE refid="q"/></select></mapper>',
        "split": '<mapper namespace="a.S"><select id="s"><inc<![CDATA[lude refid="r"/>]]></select></mapper>',
        "two": '<mapper namespace="a.F"/><mapper a="x>y" namespace = \'a.G\'>', "commented": '<!-- <mapper namespace="a.H"> --><mapper id="1" namespace=" a.I "></mapper>', "inside": '<mapper namespace="a.J"><select id="s"><mapper namespace="a.K"></select></mapper>',
        "other": '<mapper.x namespace="a.L"/><select id="s" resultType="T">select a</select>', "open": '<mapper namespace="a.M"', "null": None,
    }
    return whole_files(spark.createDataFrame([(f"{k}.xml", v) for k, v in texts.items()], "path string, content string"))


def test_namespaces_are_those_of_the_elements(spark):
    u = mapper_files(spark)
    got, want = (sorted(map(tuple, x.collect())) for x in (mx.namespaces(u, "path"), mx.namespace_of(mx.elements(u, "path"), "path")))
    assert [(p, n or "") for p, n in got] == [(p, n or "") for p, n in want] and ("two.xml", "a.G") in got and len(got) > 7


def test_mappers_that_cannot_hold_a_pattern_are_read_no_further(spark):
    u = mapper_files(spark)
    scopes = lambda x: mx.xml_scopes(mx.elements(x, "path"), "path")
    held = {r.path for r in mx.holding(u, r"\$\{").collect()}
    assert held == {"joined.xml", "plain.xml", "split.xml"}
    found = lambda x: sorted((r.path, r.position) for r in rs.placeholders(scopes(x)).collect())
    assert found(mx.holding(u, r"\$\{")) == found(u) and len(found(u)) == 2
    refs = lambda x: sorted(tuple(r) for r in scopes(x).selectExpr("path", "explode(unresolved)").collect())
    assert refs(mx.holding(u, "(?i:<include)")) == refs(u) == [("include.xml", "q"), ("split.xml", "r")]


def test_queries_name_what_their_mappers_hold(spark):
    plan = lambda q: entry.queries()[q](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert r"\$\{)|<!\[CDATA" in plan("placeholder_position")
    assert "body_line" not in plan("companion_left_join")


def test_resolved_statements_are_those_of_the_scopes(spark):
    own = '<mapper namespace="demo"><sql id="a">A<include refid="b"/></sql><sql id="b">old</sql><sql id=" b ">B <include refid="c"/></sql><sql id="c">C <include refid="demo.d"/></sql><sql id="d">D <include refid="a"/></sql>'
    bodies = [
        '<include refid="a"/>,<INCLUDE\nrefid=\' demo.a \'></include>', '<include refid="b" refid="a"/>', '<include refid="far.a"/><include refid=""/><include REFID="a"/>', '<include x="refid=\'a\'" refid="b"/>', '<include refid="a"', "<include refid='a",
        'x <![CDATA[<include refid="a"/> < 1]]>', '<inc<![CDATA[lude refid="a"/>]]>', '<where> <if test="x > 1">a</if></where><trim prefix="(">b</trim><set/>', '<where <include refid="a"/>', "\x01 \x02<include refid=\"a\"/>\x03\x04\x05$1\\", '<include-x refid="a"/>', '<include refid="a"><property name="p" value="q"/></include>', "y " * 100_000 + '<include refid="a"/>' * 3_000,
    ]
    opens = ['<select id="q">', "<update id = ' u '>", '<insert id="i" useGeneratedKeys="true">', '<delete id="b id=" x="y">', '<select id="x" id="y">', '<select id="s" data-id="z">', "<select>"]
    files = [(f"{k}.xml", own + "".join(o + b + f"</ {o[1:7].upper()} >" for o in opens)) for k, b in enumerate(bodies)]
    files += [("comma.xml", '<mapper><sql id="a,b">1</sql><sql id="b">2</sql><select id="s"><include refid="a,b"/><include refid="b"/><include refid="a"/></select></mapper>'), ("cut.xml", own + '<resultMap id="<select id=\'n\'>x</select>"><insert id="open"><select id="t"/><select id="z">z</select>')]
    files += [("no.xml", "<doc/>"), ("bare.xml", '<select id="e" resultType="T"><include refid="a"/></select>'), ("null.xml", None), ("A.java", own), ("last.xml", '<mapper namespace="x"><mapper namespace="demo">' + own.split(">", 1)[1] + '<select id="l"><include refid="demo.a"/></select>')]
    u = whole_files(spark.createDataFrame(files, "path string, content string"))
    rows = lambda x: sorted(map(tuple, x.select("path", "kind", "id", "resolved").collect()))
    got = rows(mx.resolved_statements(u, "path"))
    assert got == rows(mx.xml_scopes(mx.elements(u, "path"), "path").filter("kind <> 'sql'")) and len(got) > 100
    assert ("comma.xml", "select", "s", "1 2") in got and ("last.xml", "select", "l", "A B C") in got
    assert [r for r in got if r[:3] == ("0.xml", "select", "q")] == [("0.xml", "select", "q", "A B C , A B C")]


def test_include_closure_makes_texts_once_and_writes_nothing_in_between(spark):
    plan = entry.queries()["include_closure"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    shuffled = plan.split("Exchange RoundRobinPartitioning")
    assert len(shuffled) == 2 and "<mapper" in shuffled[0] and "<mapper" not in shuffled[1]
    # fragments are no rows, and their names are searched without a scan by elements
    assert "ExistingRDD" not in plan and "find_in_set" in plan and "array_position" not in plan


def test_white_space_of_any_kind_is_found_behind_the_range_of_other_characters(spark):
    blanks = "\t\n\x0b\f\r         　﻿"
    df = spark.createDataFrame([(c,) for c in blanks + "\x01!~\x7f\u0085​⁠a"], "c string")
    flat = {r[0] for r in df.filter(X.flat(F.concat(F.lit("a"), "c", "c", F.lit("b"))) == "a b").collect()}
    assert flat == set(blanks) == {r[0] for r in df.filter(X.trim(F.concat("c", F.lit("a"), "c")) == "a").collect()} - {"a"}
    assert X.BLANKS.startswith("[[^!-~]&&")
