"""Queries over the engine's operators, and SQL that predicts their results from the inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions import text as X
from lintlake.operators import findings as fin
from lintlake.operators import mapper_xml as mx
from lintlake.operators.java_structure import java_structure, table_of
from lintlake.operators.ranking import global_row_number
from lintlake.plans import rules_java as rj
from lintlake.plans import rules_sql as rs
from lintlake.plans.catalogue import RULE_IDS
from lintlake.plans.review import Options, review, scopes
from lintlake.plans.sql_rules import SPR002, register, sql_rule
from lintlake import reports
from lintlake.session import cut
from lintlake.sources import corpus as C
from lintlake.sources import diff as D
from lintlake.sources import units as U

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ text kernel


@query("SELECT doc_id, CAST(i AS BIGINT) AS line, s[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), range(1, 100000) r(i) WHERE i <= len(s)")
def lines_explode(spark, d):
    return X.explode_lines(C.table(spark, d, "documents"), "text", "doc_id").withColumn("line", F.col("line").cast("bigint"))


@query(r"SELECT doc_id, CAST(length(replace(text, chr(10), chr(10) || chr(32))) AS BIGINT) AS chars FROM documents")
def newline_normalise(spark, d):
    mixed = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\r")))
    return C.table(spark, d, "documents").select("doc_id", F.length(F.replace(X.normalize_newlines(mixed), F.lit("\n"), F.lit("\n "))).cast("bigint").alias("chars"))


@query(r"SELECT page_id, CAST(length(html) AS BIGINT) AS chars, CAST(length(regexp_replace(html, '<!--(.|\n)*?-->', '', 'g')) - length(replace(regexp_replace(html, '<!--(.|\n)*?-->', '', 'g'), ' ', '')) + list_sum(list_transform(regexp_extract_all(html, '<!--(.|\n)*?-->'), lambda c: length(replace(c, chr(10), '')))) AS BIGINT) AS spaces FROM pages")
def xml_comment_mask(spark, d):
    m = X.mask_xml_comments(F.col("html"))
    return C.table(spark, d, "pages").select("page_id", F.length(m).cast("bigint").alias("chars"), (F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit("")))).cast("bigint").alias("spaces"))


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '</?[A-Za-z_][\w:.-]*(?:"[^"]*"|''[^'']*''|[^"''>])*>')) AS BIGINT) AS tags FROM pages""")
def xml_tag_scan(spark, d):
    return C.table(spark, d, "pages").select("page_id", F.size(X.matches(F.col("html"), mx.TAG)).cast("bigint").alias("tags"))


@query(r"SELECT doc_id, line, CAST(len(regexp_extract_all(t, '[0-9]+')) AS BIGINT) AS n FROM (SELECT doc_id, CAST(i AS BIGINT) AS line, s[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), range(1, 100000) r(i) WHERE i <= len(s)) WHERE len(regexp_extract_all(t, '[0-9]+')) > 0")
def match_offsets_to_lines(spark, d):
    each = C.table(spark, d, "documents").filter(F.col("text").rlike("[0-9]")).select("doc_id", "text", F.explode(X.matches(F.col("text"), "[0-9]+")).alias("m"))
    return each.select("doc_id", X.line_at(F.col("text"), F.col("m.start")).cast("bigint").alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(length(props) - length(replace(props, '{', '')) AS BIGINT) AS pairs, CAST(0 AS BIGINT) AS unmatched FROM events WHERE props LIKE '%{%'")
def brace_depth_window(spark, d):
    pairs = X.brace_pairs(C.table(spark, d, "events").select("event_id", "props"), "props", "event_id")
    return pairs.groupBy("event_id").agg(F.count_if(F.col("close") > F.col("open")).alias("pairs"), F.count_if(F.col("close") < 0).alias("unmatched"))


@query(r"SELECT page_id FROM pages WHERE regexp_matches(url, '^https://[^/]*/(.*)1[^/]*$')")
def glob_path_filter(spark, d):
    return C.table(spark, d, "pages").filter(P.matches_any(F.col("url"), ["https://*/**1*"])).select("page_id")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'java' WHEN 1 THEN 'xml' WHEN 2 THEN 'java' ELSE 'other' END AS lang, (p_size % 4 <> 3 AND p_size % 5 <> 0) AS reviewable FROM part")
def lang_classify(spark, d):
    p = C.table(spark, d, "part")
    ext = F.element_at(F.array(*map(F.lit, [".java", ".XML", ".Java", ".kt"])), F.pmod("p_size", F.lit(4)).cast("int") + 1)
    path = F.concat(F.when(F.pmod("p_size", F.lit(5)) == 0, "a/target/").otherwise("target/"), F.lit("P"), "p_partkey", ext)
    return p.select("p_partkey", P.lang_of(path).alias("lang"), P.reviewable(path).alias("reviewable"))


# ------------------------------------------------------------------ findings tail, over events as drafts

_DRAFT_SQL = "SELECT event_id, event_type AS rule, CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'info' END AS severity, 'u/' || (user_id % 50) || '.java' AS file, CAST(event_id % 7 AS INTEGER) AS line FROM events"


def event_drafts(spark: SparkSession, d: str) -> DataFrame:
    e = C.table(spark, d, "events")
    sev = F.element_at(F.array(F.lit("error"), F.lit("warn"), F.lit("info")), F.pmod("event_id", F.lit(3)).cast("int") + 1)
    return e.select(F.lit(0).cast("bigint").alias("unit_ord"), F.lit(0).alias("rule_ord"), F.array(F.col("event_id").cast("int")).alias("draft_seq"), F.col("event_type").alias("rule"), sev.alias("severity"), F.concat(F.lit("u/"), F.pmod("user_id", F.lit(50)), F.lit(".java")).alias("file"), F.pmod("event_id", F.lit(7)).cast("int").alias("line"), F.lit(None).cast("int").alias("end_line"), F.lit("m").alias("message"), F.lit(None).cast("string").alias("suggestion"))


def event_units(drafts: DataFrame, whole: bool) -> DataFrame:
    return drafts.select(F.col("file").alias("path"), F.lit(whole).alias("whole_file")).distinct()


@query(f"SELECT severity, CAST(count(*) AS BIGINT) AS n FROM ({_DRAFT_SQL}) GROUP BY 1")
def severity_counts(spark, d):
    return fin.severity_counts(event_drafts(spark, d))


@query(f"SELECT file, CAST(count(*) AS BIGINT) AS n, CAST(min(r) AS BIGINT) AS first_rank FROM (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END, file, line, event_id) AS r FROM ({_DRAFT_SQL})) GROUP BY 1")
def findings_by_file(spark, d):
    return fin.by_file(event_drafts(spark, d))


@query(f"SELECT string_agg(rule, ',' ORDER BY rule) AS hit_rules FROM (SELECT DISTINCT rule FROM ({_DRAFT_SQL}))")
def hit_rules(spark, d):
    return fin.hit_rules(event_drafts(spark, d))


@query(f"""WITH d AS ({_DRAFT_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END, file, line, event_id) AS k FROM d)
SELECT rule, CAST(count(*) AS BIGINT) AS n, string_agg(CASE WHEN k <= 3 THEN file || ':' || line END, ', ' ORDER BY k) || CASE WHEN count(*) > 3 THEN ' +' || (count(*) - 3) || ' more' ELSE '' END AS where_text FROM r GROUP BY 1 ORDER BY n DESC, rule LIMIT 6""")
def top_rules_with_samples(spark, d):
    return fin.top_rules(event_drafts(spark, d))


@query(f"SELECT rule, file, line, CAST(min(event_id) AS BIGINT) AS first_event FROM ({_DRAFT_SQL}) GROUP BY 1, 2, 3")
def first_wins_dedupe(spark, d):
    return fin.first_wins(event_drafts(spark, d)).select("rule", "file", "line", F.get("draft_seq", F.lit(0)).cast("bigint").alias("first_event"))


@query(f"SELECT rule, file, line FROM (SELECT rule, file, line, arg_min(severity, event_id) AS s FROM ({_DRAFT_SQL}) GROUP BY 1, 2, 3) WHERE s = 'error'")
def dedupe_before_severity(spark, d):
    return fin.at_least(fin.first_wins(event_drafts(spark, d)), "error").select("rule", "file", "line")


@query(f"SELECT CAST(row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END, file, line, event_id) AS BIGINT) AS pos, event_id FROM ({_DRAFT_SQL})")
def stable_final_sort(spark, d):
    return global_row_number(event_drafts(spark, d), fin.ordering(), "pos").select("pos", F.get("draft_seq", F.lit(0)).cast("bigint").alias("event_id"))


@query(f"SELECT event_id FROM ({_DRAFT_SQL}) WHERE line >= 1 AND NOT (file LIKE 'u/1%' AND rule = (SELECT min(event_type) FROM events)) AND NOT (line = 3 AND file LIKE 'u/2%')")
def suppression_anti_join(spark, d):
    e = event_drafts(spark, d)
    least = C.table(spark, d, "events").agg(F.min("event_type").alias("rule"))
    ids = [r[0] for r in e.select("rule").distinct().collect()]
    files = e.select(F.col("file").alias("path")).distinct()
    supp = files.filter("path like 'u/1%'").select("path", F.lit(None).cast("int").alias("line")).crossJoin(least).unionByName(files.filter("path like 'u/2%'").select("path", F.lit(3).alias("line"), F.lit("ALL").alias("rule")))
    return fin.unsuppressed(e.filter("line >= 1"), supp, ids).select(F.get("draft_seq", F.lit(0)).cast("bigint").alias("event_id"))


@query(f"SELECT event_id FROM ({_DRAFT_SQL}) WHERE line IN (2, 5)")
def added_line_semi_join(spark, d):
    e = event_drafts(spark, d)
    units = event_units(e, False)
    added = units.select("path", F.explode(F.array(F.lit(2), F.lit(5), F.lit(40))).alias("line"))
    return fin.on_added_lines(e, units, added).select(F.get("draft_seq", F.lit(0)).cast("bigint").alias("event_id"))


@query(f"SELECT event_id FROM ({_DRAFT_SQL}) WHERE line >= 1 AND (file LIKE 'u/1%' OR line = 2)")
def whole_file_vs_added(spark, d):
    e = event_drafts(spark, d)
    units = event_units(e, False).withColumn("whole_file", F.col("path").like("u/1%"))
    return fin.on_added_lines(e, units, units.select("path", F.lit(2).alias("line"))).select(F.get("draft_seq", F.lit(0)).cast("bigint").alias("event_id"))


@query(f"SELECT '::' || CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'notice' END || ' file=' || file || ',line=' || line || ',title=' || rule || '%20lintlake::50%25 of %0A' || event_id AS value FROM ({_DRAFT_SQL})")
def workflow_annotation_text(spark, d):
    e = event_drafts(spark, d)
    text = F.concat(F.lit("::"), reports.annotation_level(F.col("severity")), F.lit(" file="), X.escape_property(F.col("file")), F.lit(",line="), "line", F.lit(",title="), X.escape_property(F.concat("rule", F.lit(" lintlake"))), F.lit("::"), X.escape_message(F.concat(F.lit("50% of \n"), F.get("draft_seq", F.lit(0)))))
    return e.select(text.alias("value"))


@query(f"SELECT CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'note' END AS level, CAST(count(*) AS BIGINT) AS n FROM ({_DRAFT_SQL}) GROUP BY 1")
def sarif_levels(spark, d):
    return event_drafts(spark, d).groupBy(reports.sarif_level(F.col("severity")).alias("level")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ diffs


@query("SELECT l_orderkey AS patch_id, CAST(9 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS new_line, CASE WHEN l_returnflag = 'R' THEN 'added' ELSE 'context' END AS kind FROM lineitem")
def patch_line_numbers(spark, d):
    return D.read_patches(C.patches(spark, d))[1].select("patch_id", "new_line", "kind")


@query(C.patch_kinds_sql())
def patch_file_kinds(spark, d):
    files, lines = D.read_patches(C.patch_kinds(spark, d))
    added = lines.filter("kind = 'added'").groupBy("patch_id", "file_ord").agg(F.count("*").cast("int").alias("n"))
    return files.join(added, ["patch_id", "file_ord"], "left").select("patch_id", "path", "old_path", "status", "hunks", "unsupported", F.coalesce("n", F.lit(0)).alias("added"))


def _parsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(x.withColumn("file_ord", F.col("patch_id").cast("int")).drop("patch_id") for x in D.read_patches(C.patches(spark, d)))


@query("SELECT CAST(l_orderkey AS INTEGER) AS file_ord, false AS contiguous, CAST(10 + count(*) AS BIGINT) AS lines FROM lineitem GROUP BY l_orderkey")
def patch_reconstruct_complete(spark, d):
    _, lines = _parsed(spark, d)
    return U.reconstruct(lines).select("file_ord", "contiguous", F.size(X.lines_of(F.col("content"))).cast("bigint").alias("lines"))


@query("SELECT CAST(l_orderkey AS INTEGER) AS file_ord, avg(CASE WHEN rn % 2 = 0 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT *, 9 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE l_returnflag <> 'R' GROUP BY l_orderkey")
def patch_context_ratio(spark, d):
    _, lines = _parsed(spark, d)
    # the file at hand agrees on even lines only
    rows = lines.groupBy("file_ord").agg(F.map_from_entries(F.collect_list(F.struct("new_line", "text"))).alias("m"), F.max("new_line").alias("z"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), "z"), lambda k: F.when(k % 2 == 0, F.concat(F.lit("  "), F.coalesce(F.try_element_at("m", k), F.lit("")))).otherwise("no")), "\n")
    return U.context_share(lines, rows.select("file_ord", body.alias("content")))


@query("""SELECT CAST(l_orderkey AS INTEGER) AS file_ord, CASE WHEN l_orderkey % 5 = 0 THEN 'binary file' WHEN r = 0 THEN 'no added lines' WHEN l_orderkey % 5 = 1 THEN 'not a .java/.xml file' WHEN l_orderkey % 5 = 2 THEN 'excluded' END AS reason
FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) WHERE l_orderkey % 7 <> 0""")
def skip_reason_cascade(spark, d):
    files, lines = _parsed(spark, d)
    k = F.pmod("file_ord", F.lit(5))
    path = F.when(k == 1, F.regexp_replace("path", "xml", "txt")).when(k == 2, F.concat(F.lit("gen/"), "path")).otherwise(F.col("path"))
    files = files.withColumns({"path": path, "unsupported": F.when(k == 0, "binary file"), "status": F.when(F.pmod("file_ord", F.lit(7)) == 0, "deleted").otherwise(F.col("status"))})
    return U.skip_reasons(files, lines, ("gen/**",)).select("file_ord", "reason")


# ------------------------------------------------------------------ structure


def _elements(spark: SparkSession, d: str, pattern: str) -> DataFrame:
    """Elements of the mappers that may hold a pattern without which they have no row in the result."""
    # written once: what follows asks for the elements of a file more than once
    return cut(mx.elements(mx.holding(C.mapper_units(spark, d), pattern), "path"))


@query("""SELECT 'm/M' || o_orderkey || '.xml' AS path, 'demo/M' || o_orderkey || '.java' AS companion_key, CASE WHEN o_orderkey % 3 = 0 THEN 'a/src/main/java/demo/M' || o_orderkey || '.java' END AS companion_path FROM orders""")
def companion_left_join(spark, d):
    ns = mx.namespaces(C.mapper_units(spark, d), "path")
    o = C.table(spark, d, "orders").filter("o_orderkey % 3 = 0")
    java = o.select(F.lit(1).alias("ord"), F.concat(F.lit("a/src/main/java/demo/M"), "o_orderkey", F.lit(".java")).alias("path")).unionByName(o.select(F.lit(2).alias("ord"), F.concat(F.lit("b/src/main/java/demo/M"), "o_orderkey", F.lit(".java")).alias("path")))
    keyed = ns.select("path", P.namespace_path(F.col("namespace")).alias("ns_key"))
    return keyed.join(U.namespace_index(java), "ns_key", "left").select("path", F.col("ns_key").alias("companion_key"), "companion_path")


@query("SELECT 'm/M' || o_orderkey || '.xml' AS path, 'select a, b from t' AS resolved FROM orders WHERE o_orderkey % 8 = 4")
def include_resolution_3pass(spark, d):
    return mx.xml_scopes(_elements(spark, d, 'refid="cols"'), "path").filter("kind = 'select' and raw like '%refid=\"cols\"%'").select("path", "resolved")


@query("""SELECT 'm/C' || o_orderkey || '.xml' AS path, x.id AS id, replace(x.resolved, 'K', 'k' || o_orderkey) AS resolved
FROM orders, (VALUES ('chain', 'select K x2 x3'), ('cycle', 'select p1 q1 p1'), ('diamond', 'select l1 b1 r1 b1'), ('own', 'select K x2 x3 from t')) AS x(id, resolved)""")
def include_closure(spark, d):
    """A chain of four fragments of which three levels are followed, a cycle, a diamond, and a fragment named by its namespace."""
    return mx.resolved_statements(U.whole_files(C.include_graphs(spark, d)), "path").filter("kind = 'select'").select("path", "id", "resolved")


@query("SELECT 'm/M' || o_orderkey || '.xml' AS path, 'far.cols' AS refid FROM orders WHERE o_orderkey % 8 = 6")
def unresolved_includes(spark, d):
    return mx.xml_scopes(_elements(spark, d, "(?i:<include)"), "path").select("path", F.explode("unresolved").alias("refid"))


@query("SELECT kind, CAST(n AS BIGINT) AS n FROM (SELECT 'select' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'sql', count(*) FROM orders)")
def scope_union(spark, d):
    u = C.mapper_units(spark, d)
    return scopes(u, java_structure(C.class_units(spark, d))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'src/main/java/demo/P' || p_partkey || 'Service.java' AS path, 'a' AS caller, 'b' AS callee, 5 AS line FROM part WHERE p_size % 8 = 0")
def self_call_equi_join(spark, d):
    java = rj.Java.of(java_structure(C.class_units(spark, d)))
    return java.invoked(java.members).select("path", "caller", "callee", "line")


@query("SELECT 'src/main/java/demo/P' || p_partkey || 'Service.java' AS path, 'selectById' AS callee, 7 AS line, 'for' AS loop FROM part WHERE p_size % 8 = 6")
def call_in_loop_range_join(spark, d):
    java = rj.Java.of(java_structure(C.class_units(spark, d)))
    return rj.calls_in_loops(java).select("path", "callee", "line", "loop")


@query("SELECT 'src/main/java/demo/P' || p_partkey || 'Service.java' AS path, 'n' AS name, 5 AS line FROM part WHERE p_size % 8 = 4")
def field_write_join(spark, d):
    s = java_structure(C.class_units(spark, d))
    fields = table_of(s, "fields").select("path", F.explode("names").alias("name"))
    return table_of(s, "writes").join(fields, ["path", "name"]).select("path", "name", "line")


@query("SELECT 'm/M' || o_orderkey || '.xml' AS path, CASE o_orderkey % 8 WHEN 1 THEN 'value' ELSE 'identifier' END AS position, o_orderkey % 8 = 3 AS sort_like FROM orders WHERE o_orderkey % 8 IN (1, 3)")
def placeholder_position(spark, d):
    u = mx.holding(C.mapper_units(spark, d), r"\$\{")
    return rs.placeholders(scopes(u, java_structure(C.class_units(spark, d).limit(0)))).select("path", "position", "sort_like")


@query("SELECT 'm/M' || o_orderkey || '.xml' AS path, o_custkey % 2 = 0 AS paged FROM orders WHERE o_orderkey % 8 = 0")
def paged_query_exemption(spark, d):
    u = C.mapper_units(spark, d)
    sc = scopes(u, java_structure(C.class_units(spark, d).limit(0))).filter("kind = 'select' and raw like '%select * from t%'")
    o = C.table(spark, d, "orders")
    text = F.concat(F.lit("interface M { List<T> q("), F.when(F.pmod("o_custkey", F.lit(2)) == 0, "IPage<T> p").otherwise("int p"), F.lit("); }"))
    comp = o.select(F.concat(F.lit("m/M"), "o_orderkey", F.lit(".xml")).alias("path"), text.alias("companion_content"))
    return rs.paged(sc, comp).select("path", "paged")


# ------------------------------------------------------------------ rules


def _xml_rule(spark: SparkSession, d: str, rule: str) -> DataFrame:
    return review(C.mapper_units(spark, d), options=Options(only=(rule,))).findings.select("file", "line", "severity")


def _java_rule(spark: SparkSession, d: str, rule: str) -> DataFrame:
    return review(C.class_units(spark, d), options=Options(only=(rule,), experimental=True)).findings.select("file", "line", "severity")


_M, _P = "'m/M' || o_orderkey || '.xml' AS file", "'src/main/java/demo/P' || p_partkey || 'Service.java' AS file"


def _part(variant: int, line: int, severity: str) -> str:
    return f"SELECT {_P}, {line} AS line, '{severity}' AS severity FROM part WHERE p_size % 8 = {variant}"


@query(_part(0, 5, "error"))
def rule_spr001(spark, d):
    return _java_rule(spark, d, "SPR001")


@query(_part(1, 4, "error"))
def rule_spr002(spark, d):
    return _java_rule(spark, d, "SPR002")


@query(_part(1, 4, "error"))
def rule_as_sql(spark, d):
    """The same rule as SQL text over the table of members, in place of the built-in one."""
    found = review(C.class_units(spark, d), options=Options(only=("SPR001",)), own_rules=[sql_rule("SPR002", SPR002)], own_ids=["SPR002"]).findings
    return found.filter("rule = 'SPR002'").select("file", "line", "severity")


@query("SELECT 'src/main/java/demo/P' || p_partkey || 'Service.java' AS path, 'selectById' AS callee, 'm' AS receiver, 1 AS arity, 7 AS line FROM part WHERE p_size % 8 = 6")
def lateral_calls(spark, d):
    """A table function of Java files in SQL."""
    register(spark)
    units = C.class_units(spark, d).select("path", X.mask_java(F.col("content")).alias("masked"), X.mask_java_comments(F.col("content")).alias("commented"))
    return spark.sql("SELECT u.path, c.* FROM {units} u, LATERAL java_calls(u.masked, u.commented) c WHERE c.callee LIKE 'select%'", units=units)


@query(_part(2, 4, "error"))
def rule_spr003(spark, d):
    return _java_rule(spark, d, "SPR003")


@query(_part(3, 5, "error"))
def rule_spr004(spark, d):
    return _java_rule(spark, d, "SPR004")


@query(_part(4, 4, "warn"))
def rule_spr005(spark, d):
    return _java_rule(spark, d, "SPR005")


@query(_part(5, 4, "warn"))
def rule_spr006(spark, d):
    return _java_rule(spark, d, "SPR006")


@query(f"SELECT {_M}, 4 AS line, CASE o_orderkey % 8 WHEN 1 THEN 'error' ELSE 'warn' END AS severity FROM orders WHERE o_orderkey % 8 IN (1, 3) AND o_orderstatus <> 'O'")
def rule_myb001(spark, d):
    return _xml_rule(spark, d, "MYB001")


@query(f"SELECT {_M}, 8 AS line, 'error' AS severity FROM orders WHERE o_custkey % 3 = 0 AND o_orderstatus <> 'O' UNION ALL {_part(6, 7, 'error')}")
def rule_myb002(spark, d):
    return review(C.mapper_units(spark, d).unionByName(C.class_units(spark, d)), options=Options(only=("MYB002",))).findings.select("file", "line", "severity")


@query(f"SELECT {_M}, 4 AS line, 'warn' AS severity FROM orders WHERE o_orderkey % 8 = 2 AND o_orderstatus <> 'O'")
def rule_myb003(spark, d):
    return _xml_rule(spark, d, "MYB003")


@query(f"SELECT {_M}, 4 AS line, 'warn' AS severity FROM orders WHERE o_orderkey % 8 = 0 AND o_orderstatus <> 'O'")
def rule_myb004(spark, d):
    return _xml_rule(spark, d, "MYB004")


@query(f"SELECT {_M}, 3 AS line, CASE o_orderkey % 8 WHEN 5 THEN 'warn' ELSE 'error' END AS severity FROM orders WHERE o_orderkey % 8 IN (0, 4, 5) AND o_orderstatus NOT IN ('O', 'F')")
def rule_myb005(spark, d):
    return _xml_rule(spark, d, "MYB005")


@query("""WITH m AS (SELECT o_orderkey % 8 AS v, o_custkey % 3 AS c, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'O'), p AS (SELECT p_size % 8 AS v FROM part)
SELECT rule, CAST(n AS BIGINT) AS n FROM (SELECT 'MYB001' AS rule, count(*) AS n FROM m WHERE v IN (1, 3) UNION ALL SELECT 'MYB002', (SELECT count(*) FROM m WHERE c = 0) + (SELECT count(*) FROM p WHERE v = 6) UNION ALL SELECT 'MYB003', count(*) FROM m WHERE v = 2 UNION ALL SELECT 'MYB004', count(*) FROM m WHERE v = 0 UNION ALL SELECT 'MYB005', count(*) FROM m WHERE v IN (0, 4, 5) AND s <> 'F'
UNION ALL SELECT 'SPR001', count(*) FROM p WHERE v = 0 UNION ALL SELECT 'SPR002', count(*) FROM p WHERE v = 1 UNION ALL SELECT 'SPR003', count(*) FROM p WHERE v = 2 UNION ALL SELECT 'SPR004', count(*) FROM p WHERE v = 3 UNION ALL SELECT 'SPR005', count(*) FROM p WHERE v = 4 UNION ALL SELECT 'SPR006', count(*) FROM p WHERE v = 5) WHERE n > 0""")
def corpus_summary(spark, d):
    u = C.mapper_units(spark, d).unionByName(C.class_units(spark, d))
    return review(u, options=Options(experimental=True)).findings.groupBy("rule").agg(F.count("*").alias("n"))


def _variants_of(rule: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return review(C.variant_units(spark, d), options=Options(only=(rule,), experimental=True)).findings.select("file", "line", "severity", "message")

    run.__name__ = f"variants_{rule.lower()}"
    run.__doc__ = f"Every branch of {rule} in fixtures that mark their own lines: places, severities and messages."
    query(C.variant_sql(rule))(run)


for _rule in RULE_IDS:
    _variants_of(_rule)


def star_selects(spark: SparkSession, d: str) -> DataFrame:
    """Which selects of the mapper corpus read all columns, on which line, without suppressed ones."""
    return review(C.mapper_units(spark, d), options=Options(only=("MYB004",))).findings.select("rule", "severity", "file", "line", "snippet")
