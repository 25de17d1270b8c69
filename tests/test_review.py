import json
import subprocess

import pytest

from lintlake import api, config, reports, rpc
from lintlake.operators.findings import ordering
from lintlake.plans.review import Options, review
from lintlake.sources.git import DiffSource
from lintlake.sources.units import whole_files

MAPPER = """<?xml version="1.0"?>
<mapper namespace="demo.UserMapper">
  <!-- <select id="no">select * from x</select> -->
  <sql id="cols">id, ${prefix}.x</sql>
  <sql id="cond"><where>a = 1</where></sql>
  <resultMap id="rm" type="U">
    <association property="d" select="selDept" column="x"/>
  </resultMap>
  <select id="all"
      resultType="U">
    select *
    from users
  </select>
  <select id="byName">select <include refid="cols"/> from users
    where name like '%${name}%'
    order by ${sort}</select>
  <select id="quoted">select a from t where name like '#{n}'</select>
  <select id="far">select <include refid="other.cols"/> from t</select>
  <select id="near">select a from t <include refid="demo.UserMapper.cond"/></select>
  <select id="paged">select a from t</select>
  <select id="cnt">select count(*) from t</select>
  <select id="grp">select a, count(*) from t group by a</select>
  <!-- review:disable MYB005 -->
  <select id="sup">select a from t</select>
  <select id="wrapped">select a from t ${ew.customSqlSegment}</select>
</mapper>
"""
SERVICE = """package demo;
@Service
@Transactional(readOnly = true)
public class OrderService {
    private OrderMapper orderMapper;
    private Map<Long, String> cache = new HashMap<>();
    private final ConcurrentHashMap<Long, String> safe = new ConcurrentHashMap<>();
    public void place(Order o) throws IOException {
        this.save(o, 1);
        save(o);
        for (Item i : o.items()) { orderMapper.insertItem(i); }
        orderMapper.findByName(s).map(e -> orderMapper.update(e));
        cache.put(1L, s);
        new Thread(() -> {}).start();
    }
    @Transactional(propagation = Propagation.REQUIRES_NEW, rollbackFor = Exception.class)
    public void save(Order o, int n) throws java.io.IOException { }
    @Async void fire() { }
    @Cacheable("c") public String load(Order o, boolean b) { return ""; }
    @Cacheable(value = "c", key = "#o") public String keyed(Order o, boolean b) { return load(null, true); }
}
"""


def found(r):
    return [(x.rule, x.line, x.severity) for x in r.findings.orderBy(*ordering()).collect()]


def units(spark, *files):
    return whole_files(spark.createDataFrame(list(files), "path string, content string"))


def test_mapper_rules(spark):
    java = spark.createDataFrame([(1, "src/main/java/demo/UserMapper.java", "interface UserMapper { List<U> paged(Page<U> p, int a); }")], "ord int, path string, content string")
    r = review(units(spark, ("m.xml", MAPPER)), None, java, Options(experimental=True))
    assert found(r) == [("MYB001", 4, "error"), ("MYB002", 7, "error"), ("MYB005", 9, "error"), ("MYB001", 15, "error"), ("MYB003", 17, "error"), ("MYB004", 11, "warn"), ("MYB003", 15, "warn"), ("MYB001", 16, "warn"), ("MYB005", 22, "warn")]


def test_java_rules(spark):
    r = review(units(spark, ("S.java", SERVICE)), options=Options(experimental=True))
    assert found(r) == [("SPR002", 8, "error"), ("SPR001", 9, "error"), ("MYB002", 11, "error"), ("SPR004", 14, "error"), ("SPR003", 18, "error"), ("SPR005", 6, "warn"), ("SPR006", 19, "warn"), ("SPR006", 20, "warn")]


def test_gates(spark):
    r = review(units(spark, ("a.xml", "<html><select id='x'>a</select></html>"), ("b.xml", "<#if x><mapper namespace='a'></mapper>"), ("c.xml", "<mapper namespace='a'></mapper>"), ("d.xml", "<doc><mapper namespace='x'/></doc>"), ("e.txt", "x")))
    assert {(s.path, s.reason) for s in r.skipped.collect()} == {("a.xml", "not a mapper XML"), ("b.xml", "a template, not a mapper"), ("c.xml", "no mapper SQL in this file"), ("d.xml", "root element is <doc>, not <mapper>")}
    assert r.findings.count() == 0


def test_reports(spark, tmp_path):
    r = review(units(spark, ("m.xml", "<mapper namespace='a'>\n<select id='q'>select * from t</select>\n</mapper>")))
    c = reports.Collected.of(r)
    out = json.loads(reports.render_json(c))
    assert out["summary"]["errors"] == 1 and out["summary"]["warnings"] == 1 and out["summary"]["hitRules"] == ["MYB004", "MYB005"]
    assert out["findings"][0]["line"] == 2 and out["findings"][0]["snippet"].startswith("<select")
    sarif = json.loads(reports.render_sarif(c))
    assert [x["level"] for x in sarif["runs"][0]["results"]] == ["error", "warning"]
    assert reports.render_annotations(c).startswith("::error file=m.xml,line=2,title=MYB005%20lintlake::")
    assert "1 error(s)" in reports.render_table(c) and "\x1b[31m" in reports.render_table(c, color=True)
    assert c.exit_code() == 1 and "MYB005" in reports.summary(r)
    assert '"suggestion":' in reports.json_rows(r.findings).first().value
    for kind in ("json", "sarif", "github"):
        reports.save(r.findings, f"{tmp_path}/{kind}", kind)
    rows = [json.loads(x.value) for x in spark.read.text(f"{tmp_path}/sarif").collect()]
    assert sorted(rows, key=lambda x: x["ruleId"]) == sorted(sarif["runs"][0]["results"], key=lambda x: x["ruleId"])
    assert spark.read.text(f"{tmp_path}/github").count() == spark.read.text(f"{tmp_path}/json").count() == 2


def run_git(cwd, *args):
    subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *args], cwd=cwd, check=True, capture_output=True)


def test_diff_of_a_work_tree(spark, tmp_path):
    run_git(tmp_path, "init", "-q")
    (tmp_path / "m.xml").write_text("<mapper namespace='a'>\n<select id='q'>select * from t</select>\n</mapper>\n")
    run_git(tmp_path, "add", ".")
    run_git(tmp_path, "commit", "-qm", "x")
    (tmp_path / "m.xml").write_text("<mapper namespace='a'>\n<select id='q'>select * from t</select>\n<select id='r'>select * from u</select>\n</mapper>\n")
    (tmp_path / "new.xml").write_text("<mapper namespace='b'>\n<select id='q'>select a from t</select>\n</mapper>\n")
    r = api.review_diff(spark, DiffSource("worktree"), str(tmp_path))
    assert {(x.file, x.rule, x.line) for x in r.findings.collect()} == {("m.xml", "MYB004", 3), ("m.xml", "MYB005", 3), ("new.xml", "MYB005", 2)}
    assert {x.content_source for x in r.units.collect()} == {"worktree"}


def test_patch_alone_and_stale(spark, tmp_path):
    patch = "--- a/m.xml\n+++ b/m.xml\n@@ -5,2 +5,3 @@\n <mapper namespace='a'>\n+<select id='q'>select * from t where a = ${x}</select>\n </mapper>\n"
    r = api.review_diff(spark, DiffSource("patch", patch), str(tmp_path))
    assert [(x.rule, x.line) for x in r.findings.collect()] == [("MYB001", 6)]
    assert any("not fully available" in s.reason for s in r.skipped.collect())
    (tmp_path / "m.xml").write_text("entirely\ndifferent\n")
    stale = api.review_diff(spark, DiffSource("patch", patch), str(tmp_path))
    assert any("does not match" in s.reason for s in stale.skipped.collect())


def test_expand(tmp_path):
    for p in ("a/X.java", "a/target/Y.java", "b.xml", "c.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert api.expand(["."], str(tmp_path)) == (["a/X.java", "b.xml"], [])
    assert api.expand(["a", "**/*.xml", "c.txt", "zz"], str(tmp_path), ("a/*",)) == (["b.xml"], [("c.txt", "not a .java/.xml file"), ("zz", "not readable")])


def test_tree_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.xml").write_text("<mapper namespace='a'><select id='q'>select * from t</select></mapper>")
    assert [x.file for x in api.review_tree(spark, str(tmp_path)).findings.collect()] == ["src/m.xml"] * 2


def test_config(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / config.NAMES[0]).write_text('{"disable": ["spr001, MYB004"], "minSeverity": "error"}')
    got = config.load(str(tmp_path / "sub"), stop_at=str(tmp_path))
    o = config.merge(got.config, exclude=["x"], only=["myb001"])
    assert o == Options("error", ("x",), ("MYB001",), ("SPR001", "MYB004"), False)
    (tmp_path / config.NAMES[0]).write_text('{"bad": 1}')
    assert "bad is not a known key" in config.load(str(tmp_path)).error
    assert config.unknown_rules(Options(only=("ABC999",))) == ["ABC999"]


def test_rpc(spark):
    listed = rpc.answer(spark, {"jsonrpc": "2.0", "id": 1, "method": "tools/list"})
    assert {t["name"] for t in listed["result"]["tools"]} == {"review_diff", "review_file", "list_rules"}
    wrong = rpc.answer(spark, {"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": {"name": "review_file", "arguments": {"x": 1}}})
    assert wrong["result"]["isError"]
    assert rpc.answer(spark, {"method": "notifications/initialized"}) is None


@pytest.mark.parametrize("line", ["-- review:disable", "<!-- spring-style review:disable ALL -->"])
def test_suppression_without_ids_is_for_all(spark, line):
    text = f"<mapper namespace='a'>\n<select id='q'>select * from t</select> {line}\n</mapper>"
    assert review(units(spark, ("m.xml", text))).findings.count() == 0


TWICE = "package demo;\n@Service\npublic class A {\n  public void a() { b(); }\n  %spublic void b() { }\n}\n"


def test_units_of_one_path_are_apart(spark):
    """Two versions of a file, of which neither has a finding."""
    both = spark.createDataFrame([(1, "A.java", TWICE % ""), (2, "A.java", (TWICE % "@Transactional ").replace("b();", ""))], "unit_ord long, path string, content string")
    rows = both.selectExpr("unit_ord", "path", "'java' as lang", "content", "'patch' as content_source", "true as complete", "true as whole_file")
    assert review(rows).findings.count() == 0
    last = both.filter("unit_ord = 2").selectExpr("unit_ord", "path", "'java' as lang", "replace(content, 'a() { ', 'a() { b(); ') as content", "'patch' as content_source", "true as complete", "true as whole_file")
    got = review(rows.filter("unit_ord = 1").unionByName(last)).findings.collect()
    assert [(x.rule, x.file, x.line, x.unit_ord) for x in got] == [("SPR001", "A.java", 4, 2)] and "b();" in got[0].snippet


def test_very_long_tags_and_gaps(spark):
    tag = "<select " + "x" * 1_000_000 + ">select * from t</select>"
    gap = "class AService {\n  private int n;\n  void m() { int /*" + "-" * 10_000 + "*/ n = 3; }\n}\n"
    r = review(units(spark, ("a.xml", tag), ("b.xml", "<mapper namespace='a'>" + tag + "</mapper>"), ("c.xml", "<doc " + "y" * 1_000_000), ("AService.java", gap)), options=Options(experimental=True))
    assert {(x.file, x.rule) for x in r.findings.collect()} == {("b.xml", "MYB004"), ("b.xml", "MYB005")}
    assert {s.path for s in r.skipped.collect()} == {"a.xml", "c.xml"}


def test_many_matches_in_one_text(spark):
    from pyspark.sql import functions as F

    from lintlake.functions import text as X

    text = "a\nbb a" * 3000 + "é a"
    df = spark.createDataFrame([(text,), ("",), (None,), ("a",), ("xa\n\na",)], "t string").select(X.matches(F.col("t"), "a").alias("m"))
    first, none, null, one, two = [r.m for r in df.collect()]
    assert [m.start for m in first] == [i for i, c in enumerate(text) if c == "a"] and all(m.end == m.start + 1 and m.text == "a" for m in first)
    assert [m.line for m in first] == [text.count("\n", 0, m.start) + 1 for m in first]
    assert none == [] and not null and [(m.start, m.line) for m in one] == [(0, 1)] and [(m.start, m.line) for m in two] == [(1, 1), (4, 3)]


def test_a_file_that_cannot_be_read_is_skipped(spark, monkeypatch):
    from lintlake.operators import java_structure as js

    bad = js.analyzed("A.java", None, None)
    assert bad["diagnostics"][0].startswith(js.FAILED) and bad["members"] == []
    broken = spark.createDataFrame([bad | {"path": "1\x1fA.java"}], js.SCHEMA)
    from lintlake.plans import review as plan

    monkeypatch.setattr(plan, "java_structure", lambda u: broken)
    rows = spark.createDataFrame([(1, "A.java", TWICE % "@Transactional ")], "unit_ord long, path string, content string").selectExpr("unit_ord", "path", "'java' as lang", "content", "'x' as content_source", "true as complete", "true as whole_file")
    r = review(rows, options=Options(only=("SPR001", "MYB001")))
    assert r.findings.count() == 0 and {s.reason.split(":")[0] for s in r.skipped.collect()} == {"SPR001", "MYB001"}


def test_own_rules(spark):
    from pyspark.sql import functions as F

    def long_names(c):
        return c.java.members.filter(F.length("name") > 3).select("path", F.lit(50).alias("rule_ord"), F.array("member_ix").alias("draft_seq"), F.lit("OWN001").alias("rule"), F.lit("warn").alias("severity"), "line", F.col("line").alias("end_line"), F.concat(F.lit("long name "), "name").alias("message"), F.lit(None).cast("string").alias("suggestion"))

    text = "class A {\n  void abcd() { }\n  // review:disable OWN001\n  void efgh() { }\n  void ij() { }\n}\n"
    r = review(units(spark, ("A.java", text)), own_rules=[long_names], own_ids=["OWN001"])
    assert [(x.rule, x.line, x.message) for x in r.findings.collect()] == [("OWN001", 2, "long name abcd")]


def test_staged_and_range(spark, tmp_path):
    run_git(tmp_path, "init", "-q")
    one, two, three = ("<mapper namespace='a'>\n" + "".join(f"<select id='q{k}'>select * from t{k}</select>\n" for k in range(n)) + "</mapper>\n" for n in (1, 2, 3))
    for text in (one, two):
        (tmp_path / "m.xml").write_text(text)
        run_git(tmp_path, "add", ".")
        run_git(tmp_path, "commit", "-qm", "x")
    (tmp_path / "m.xml").write_text(three)
    run_git(tmp_path, "add", ".")
    (tmp_path / "m.xml").write_text("overwritten")
    got = api.review_diff(spark, DiffSource("range", "HEAD~1..HEAD"), str(tmp_path))
    assert {x.line for x in got.findings.collect()} == {3} and {x.content_source for x in got.units.collect()} == {"head"}
    staged = api.review_diff(spark, DiffSource("staged"), str(tmp_path))
    assert {(x.rule, x.line) for x in staged.findings.collect()} <= {("MYB001", 4), ("MYB004", 4), ("MYB005", 4)}
    assert any("does not match" in s.reason for s in staged.skipped.collect())
    with pytest.raises(ValueError):
        api.review_diff(spark, DiffSource("range", "no-such-ref..HEAD"), str(tmp_path))
