"""A corpus of mappers, classes and patches made from business tables; a key column decides what each file holds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.sources.units import whole_files

#: By o_orderkey % 8: the body of a select, on line 4 of its file.
SELECTS = [
    "select * from t",
    "select a from t where x = ${x}",
    "select a from t where n like '%abc'",
    "select a from t order by ${sort} limit 5",
    'select <include refid="cols"/> from t',
    "select a, count(*) from t group by a",
    'select <include refid="far.cols"/> from t',
    "select a from t where id = #{id}",
]
#: By p_size % 8: the members of a class, from line 4 on.
CLASSES = [
    "  public void a() {\n    b();\n  }\n  @Transactional\n  public void b() { }",
    "  @Transactional\n  public void a() throws IOException { }",
    "  @Async\n  void a() { }",
    "  public void a() {\n    new Thread(null).start();\n  }",
    "  private int n;\n  public void a() { n++; }",
    '  @Cacheable("c")\n  public String a(Order o, int b) { return "}"; }',
    "  private UMapper m;\n  public void a() {\n    for (X x : xs) {\n      m.selectById(x);\n    }\n  }",
    "  // b(); new Thread(null);\n  public int a(int b) { return b; }",
]


def _pick(key: Column, texts: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), F.pmod(key, F.lit(len(texts))).cast("int") + 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Few narrow rows dealt to all cores, before texts are made of them: a small file is one partition."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def mappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapper for each order. Line 2 suppresses by o_orderstatus: O the file, F the next line, others nothing."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"))
    note = F.when(F.col("o_orderstatus") == "O", "<!-- review:disable-file -->").when(F.col("o_orderstatus") == "F", "<!-- review:disable MYB005 -->").otherwise("")
    nested = F.when(F.pmod("o_custkey", F.lit(3)) == 0, '<resultMap id="r" type="T">\n<association property="p" select="s" column="c"/>\n</resultMap>\n').otherwise("")
    text = F.concat(F.lit('<mapper namespace="demo.M'), "o_orderkey", F.lit('">\n'), note, F.lit('\n<select id="q" resultType="T">\n'), _pick(F.col("o_orderkey"), SELECTS), F.lit('\n</select>\n<sql id="cols">a, b</sql>\n'), nested, F.lit("</mapper>\n"))
    return o.select(F.concat(F.lit("m/M"), "o_orderkey", F.lit(".xml")).alias("path"), text.alias("content"))


def include_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapper for each order, with fragments that include each other."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    edges = {"a": ("K", "b"), "b": ("x2", "c"), "c": ("x3", "d"), "d": ("x4",), "p": ("p1", "q"), "q": ("q1", "p"), "top": ("", "l", "r"), "l": ("l1", "base"), "r": ("r1", "base"), "base": ("b1",)}
    include = lambda ids: "".join(f' <include refid="{i}"/>' for i in ids)
    frags = "".join(f'<sql id="{k}">{word}{include(ids)}</sql>\n' for k, (word, *ids) in edges.items())
    chosen = {"chain": "a", "cycle": "p", "diamond": "top", "own": "demo.CK.a"}
    selects = "".join(f'<select id="{k}">select{include([i])}{" from t" if k == "own" else ""}</select>\n' for k, i in chosen.items())
    text = f'<mapper namespace="demo.CK">\n{frags}{selects}</mapper>\n'
    # K is the key: the text around it is put together, not searched for it in each row
    around = [F.lit(x) for x in text.replace(">K ", ">kK ").replace("CK", "C\0").replace("kK ", "k\0 ").split("\0")]
    own = F.concat(around[0], *[c for x in around[1:] for c in (F.col("o_orderkey").cast("string"), x)])
    return o.select(F.concat(F.lit("m/C"), "o_orderkey", F.lit(".xml")).alias("path"), own.alias("content"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One class for each part."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    text = F.concat(F.lit("package demo;\n@Service\npublic class P"), "p_partkey", F.lit("Service {\n"), _pick(F.col("p_size"), CLASSES), F.lit("\n}\n"))
    return p.select(F.concat(F.lit("src/main/java/demo/P"), "p_partkey", F.lit("Service.java")).alias("path"), text.alias("content"))


def mapper_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_files(mappers(spark, sf_dir))


def class_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_files(classes(spark, sf_dir))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patch for each order: a hunk from line 10 on, lines of returned items added, others as context."""
    li = table(spark, sf_dir, "lineitem")
    line = F.concat(F.when(F.col("l_returnflag") == "R", "+").otherwise(" "), F.lit("item "), "l_linenumber")
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("t")))).alias("x"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n"))
    head = F.concat(F.lit("diff --git a/m/M"), "l_orderkey", F.lit(".xml b/m/M"), "l_orderkey", F.lit(".xml\n--- a/m/M"), "l_orderkey", F.lit(".xml\n+++ b/m/M"), "l_orderkey", F.lit(".xml\n@@ -10,"), F.col("n") - F.col("r"), F.lit(" +10,"), "n", F.lit(" @@\n"))
    return rows.select(F.col("l_orderkey").alias("patch_id"), F.concat(head, F.array_join(F.transform("x", lambda v: v["t"]), "\n"), F.lit("\n")).alias("text"))


# ------------------------------------------------------------------ variants of the rules
# A line that is to be found ends with a comment: "! RULE severity: message". All other lines are to stay silent.

JAVA_VARIANTS = [
    """package demo;
@Service
@Transactional(readOnly = true)
public class Orders {
  public void a() {
    this.b(1, f(2, 3)); //! SPR001 error: a() calls the transactional b() on the same instance
    other.b(1, 2);
    b(1);
  }
  @Transactional(propagation = Propagation.REQUIRES_NEW)
  public void b(int x, int y) { }
  static void s() { b(1, 2); }
}
""",
    """package demo;
@Component
public class Plain {
  @Transactional public void outer() { inner(); }
  @Transactional public void inner() { }
  @Transactional private void hidden() { }
  public void c() { hidden(); new Runnable() { public void run() { inner(); } }; }
  @Transactional(rollbackFor = Exception.class)
  public void io() throws IOException, IllegalStateException { }
  @Transactional(rollbackFor = {}) //! SPR002 error: sql() throws java.sql.SQLException, which does not roll its transaction back
  public void sql() throws java.sql.SQLException { }
  @Transactional //! SPR002 error: two() throws TimeoutException, which does not roll its transaction back
  public void two() throws TimeoutException, RuntimeException { }
}
""",
    """package demo;
public class Jobs {
  @Scheduled(cron = "* *") //! SPR003 error: @Scheduled on tick() has no effect: it takes arguments
  public void tick(int n) { }
  @Async //! SPR003 error: @Async on stat() has no effect: it is static
  public static void stat() { }
  @Async
  public void good() { }
  public void go() {
    good(); //! SPR003 error: go() calls good() on the same instance, so it runs at once
    that.good();
  }
}
""",
    """package demo;
@RestController
public class Pool {
  public void a() {
    Executors.newFixedThreadPool(2); //! SPR004 error: Pool.a() makes an Executors factory
  }
  void b() {
    new ThreadPoolExecutor(1, 2); //! SPR004 error: Pool.b() makes new ThreadPoolExecutor
    Thread.startVirtualThread(x); //! SPR004 error: Pool.b() makes a virtual thread
  }
  void c() { new ScheduledThreadPoolExecutor(1); } //! SPR004 error: Pool.c() makes new ScheduledThreadPoolExecutor
  @Bean public Executor d() { return Executors.newCachedThreadPool(); }
}
class Helper { void e() { new Thread(x); } }
""",
    """package demo;
@Service
public class State {
  private int n; //! SPR005 warn: field n of the singleton State is written in 2 unguarded places, first in a() on line 9
  private volatile int v;
  private final Map<String, String> safe = new ConcurrentHashMap<>();
  private List<String> seen = new ArrayList<>(); //! SPR005 warn: field seen of the singleton State is written in 1 unguarded places, first in a() on line 10
  private AtomicInteger at;
  public void a() { n += 1; v++; int k = 3;
    seen.add("x"); safe.put("a", "b"); }
  public void b() { --k; n = 4; }
  synchronized void c() { n++; }
  @PostConstruct void d() { n = 0; }
}
""",
    """package demo;
@Service @Scope("prototype")
public class Own {
  private int n;
  public void a() { n++; }
}
@Service
class Cached {
  @Cacheable("x") //! SPR006 warn: f() is cached under all of its 2 parameters
  public String f(Order o, int b) { return ""; }
  @Cacheable(value = "x", key = "#o")
  public String g(Order o, int b) { return f(o, 1); } //! SPR006 warn: g() calls the cached f() on the same instance, past the cache
  @Cacheable("x")
  public String h(String o, Long b) { return ""; }
}
""",
    """package demo;
class Loops {
  private UserMapper users;
  private Other other;
  void a(List<Item> all) {
    while (x) { users.selectOne(1); } //! MYB002 error: users.selectOne() runs once for each element of a while loop
    all.forEach(i -> orderDao.insert(i)); //! MYB002 error: orderDao.insert() runs once for each element of an iteration
    all.stream().map(i -> users.getById(i)); //! MYB002 error: users.getById() runs once for each element of a stream
    users.findById(1).map(u -> users.getName(u));
    for (Item i : users.listAll()) other.find(i);
    users.selectAll();
  }
}
""",
    """package demo;
public interface Notes {
  @Select("select * from notes where id = ${id}") //! MYB001 error: annotation select puts ${id} into the SQL text as value //! MYB004 warn: annotation select selects all columns
  Note one(int id);
  @Update("update notes set a = #{a} where id = #{id}")
  int set(int a);
  @Select("select a from notes where a like '%" + "x'") //! MYB003 warn: annotation select searches with a literal that begins with %
  Note like();
  @Select("select a from notes") //! MYB005 error: annotation select reads a whole table, without a condition or a limit
  List<Note> all();
}
""",
]
XML_VARIANTS = [
    """<mapper namespace="demo.V">
<select id="a">
select x from t where a = #{a} and b in (${ids}) <!--! MYB001 error: select#a puts ${ids} into the SQL text as value -->
</select>
<select id="b">
select x from ${table} where a = 1 <!--! MYB001 error: select#b puts ${table} into the SQL text as identifier -->
</select>
<select id="c">select x from t where a = 1
order by a, ${orderBy} <!--! MYB001 warn: select#c puts ${orderBy} into the SQL text as clause -->
</select>
<update id="d">update t set a = #{a}
${where} <!--! MYB001 error: update#d puts ${where} into the SQL text as fragment -->
</update>
<select id="e">select x from t ${ew.customSqlSegment}</select>
</mapper>
""",
    """<mapper namespace="demo.V">
<select id="a">
select x from t where n like concat('%', #{n}) <!--! MYB003 warn: select#a searches with concat('%', ...) -->
</select>
<select id="b">
<bind name="p" value="'%' + n"/> <!--! MYB003 warn: select#b searches with a bind that puts % before the parameter -->
select x from t where n like #{p}
</select>
<select id="c">
select x from t where n like '#{n}' <!--! MYB003 error: select#c quotes a placeholder, so it is not bound -->
</select>
<select id="d">select x from t where n like concat(#{n}, '%')</select>
</mapper>
""",
    """<mapper namespace="demo.V">
<sql id="all">
select t.* from t where a = 1
</sql>
<select id="a">
select distinct t.* from t where a = 1 <!--! MYB004 warn: select#a selects all columns -->
</select>
<select id="b">select count(*) from t where a = 1</select>
<select id="c"> <!--! MYB004 warn: select#c selects all columns -->
<include refid="demo.V.all"/>
</select>
<!-- select * from gone -->
<delete id="d">delete from t where a = 1</delete>
</mapper>
""",
    """<mapper namespace="demo.V">
<select id="a"> <!--! MYB005 error: select#a reads a whole table, without a condition or a limit -->
select x from t</select>
<select id="b">select max(x) from t</select>
<select id="c"> <!--! MYB005 warn: select#c scans the whole table before it groups -->
select a, sum(x) from t group by a</select>
<select id="d">select x from t <where><if test="a">a = 1</if></where></select>
<select id="e">select x from t limit 5</select>
<resultMap id="m" type="T">
<collection property="p" select="s" column="c"/> <!--! MYB002 error: result map m runs a nested select for each row -->
<association property="q" resultMap="other"/>
</resultMap>
</mapper>
""",
]


def expected(texts: list[str]) -> list[tuple[int, int, str, str, str]]:
    """(variant, line, rule, severity, message) of the marked lines."""
    rx = re.compile(r"(?://|<!--)! (\w+) (\w+): (.*?)(?= -->| //!|$)")
    return [(v, n, *m.groups()) for v, text in enumerate(texts) for n, line in enumerate(text.split("\n"), 1) for m in rx.finditer(line)]


def variant_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each part and a mapper for each customer, each one of the variants."""
    p, c = spread(table(spark, sf_dir, "part").select("p_partkey")), spread(table(spark, sf_dir, "customer").select("c_custkey"))
    java = p.select(F.concat(F.lit("v/src/main/java/demo/V"), "p_partkey", F.lit(".java")).alias("path"), _pick(F.col("p_partkey"), JAVA_VARIANTS).alias("content"))
    xml = c.select(F.concat(F.lit("v/V"), "c_custkey", F.lit(".xml")).alias("path"), _pick(F.col("c_custkey"), XML_VARIANTS).alias("content"))
    return whole_files(java.unionByName(xml))


def variant_sql(rule: str) -> str:
    """What a rule is to find in the variants, as SQL over part and customer."""
    out = []
    for texts, key, rel, head, tail in ((JAVA_VARIANTS, "p_partkey", "part", "v/src/main/java/demo/V", ".java"), (XML_VARIANTS, "c_custkey", "customer", "v/V", ".xml")):
        own = [(v, n, s, m.replace("'", "''")) for v, n, r, s, m in expected(texts) if r == rule]
        rows = ", ".join(f"({v}, {n}, '{s}', '{m}')" for v, n, s, m in own)
        if rows:
            out.append(f"SELECT '{head}' || {key} || '{tail}' AS file, CAST(x.line AS INTEGER) AS line, x.severity AS severity, x.message AS message FROM {rel} JOIN (VALUES {rows}) AS x(v, line, severity, message) ON {key} % {len(texts)} = x.v")
    return " UNION ALL ".join(out)


#: Patches of one file each: text, and the path, old path, status, hunks, reason and added lines that it tells.
PATCH_KINDS = [
    ("diff --git a/o/A.java b/n/A.java\nsimilarity index 90%\nrename from o/A.java\nrename to n/A.java\n--- a/o/A.java\n+++ b/n/A.java\n@@ -1,2 +1,2 @@\n class A {\n-int a;\n+int b;\n", "n/A.java", "o/A.java", "renamed", 1, None, 1),
    ("diff --git a/o.xml b/n.xml\nsimilarity index 100%\ncopy from o.xml\ncopy to n.xml\n", "n.xml", "o.xml", "renamed", 0, None, 0),
    ("diff --git a/p.bin b/p.bin\nindex 1..2 100644\nBinary files a/p.bin and b/p.bin differ\n", "p.bin", "p.bin", "added", 0, "binary file", 0),
    ('diff --git "a/\\303\\251 x.java" "b/\\303\\251 x.java"\nnew file mode 100644\n--- /dev/null\n+++ "b/\\303\\251 x.java"\n@@ -0,0 +1,2 @@\n+a\n+b\n\\ No newline at end of file\n', "é x.java", "é x.java", "added", 1, None, 2),
    ("diff --git a/g.xml b/g.xml\ndeleted file mode 100644\n--- a/g.xml\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-x\n-y\n", "g.xml", "g.xml", "deleted", 1, None, 0),
    ("diff --cc c.xml\nindex 1,2..3\n--- a/c.xml\n+++ b/c.xml\n@@@ -1 -1 +1,2 @@@\n x\n", "c.xml", "c.xml", "modified", 0, "combined merge diff is not supported", 0),
    ("--- a/x y.java\t2020-01-01\n+++ b/x y.java\t2020-01-01\n@@ -1,2 +1,3 @@\n a\n\n+c\n", "x y.java", None, "modified", 1, None, 1),
    ("--- a/z.java\n+++ b/z.java\n@@ -1 +1,2 @@\n a\n b\n+c\n", "z.java", None, "modified", 1, "hunk line counts do not match", 0),
    ("diff --git a/k.java b/k.java\n--- a/k.java\n+++ b/k.java\n@@ -3 +3 @@ class K {\n--- looks like a header\n+++ so does this\n@@ -9,0 +10 @@\n+end\n", "k.java", "k.java", "modified", 2, None, 2),
]


def patch_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("patch_id"), _pick(F.col("o_orderkey"), [p[0] for p in PATCH_KINDS]).alias("text"))


def patch_kinds_sql() -> str:
    def lit(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    rows = ", ".join(f"({k}, {', '.join(map(lit, p[1:]))})" for k, p in enumerate(PATCH_KINDS))
    return f"SELECT o_orderkey AS patch_id, x.path AS path, x.old_path AS old_path, x.status AS status, CAST(x.hunks AS INTEGER) AS hunks, x.unsupported AS unsupported, CAST(x.added AS INTEGER) AS added FROM orders JOIN (VALUES {rows}) AS x(k, path, old_path, status, hunks, unsupported, added) ON o_orderkey % {len(PATCH_KINDS)} = x.k"
