"""Rules over Java structure: equi-joins of calls, members, fields and writes on the file and its ordinals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators.containment import all_around, first_around
from lintlake.operators.java_structure import table_of
from lintlake.plans.drafting import drafts

# Attributes that change a transaction, and propagations that join the caller's.
TX_KEYS = ["propagation", "isolation", "readOnly", "timeout", "rollbackFor", "noRollbackFor"]
JOINING = ["REQUIRED", "SUPPORTS", "MANDATORY"]
ROLLBACK_KEYS = ["rollbackFor", "rollbackForClassName", "noRollbackFor"]
# Annotations and names of beans. The rule on threads has its own, narrower list.
BEANS = ["Service", "Component", "RestController", "Controller", "Repository", "Configuration", "ControllerAdvice", "RestControllerAdvice", "WebService", "Endpoint", "Tag"]
BEAN_NAME = r"(?:Controller|Service|Component|Manager|Handler|Listener|Task|Job|Consumer|Facade)\z"
#: What a file with a bean holds somewhere.
BEAN_WORDS = "|".join(BEANS) + "|" + BEAN_NAME.removeprefix("(?:").removesuffix(r")\z")
THREAD_BEANS = ["Service", "Component", "RestController", "Controller", "Repository", "Configuration", "ControllerAdvice", "WebService", "Tag"]
THREAD_BEAN_NAME = r"(?:Controller|Service|Component|Manager|Handler|Listener)\z"
SCOPES = ["RequestScope", "SessionScope", "ApplicationRequestScope", "PrototypeScope"]
INJECTED = ["Autowired", "Resource", "Value", "Inject"]
# Fixed pattern: exceptions that are taken as unchecked.
UNCHECKED = r"(?i)(?:\A|\.)(?:(?:Runtime)?Exception|Error|Throwable|RuntimeException|IllegalArgumentException|IllegalStateException|UnsupportedOperationException|ConcurrentModificationException|NumberFormatException|ArithmeticException|NullPointerException|ClassCastException)\z"
# Fixed patterns: types that are safe to share, and those that are not.
SAFE = r"\A(?:ConcurrentHashMap|ConcurrentSkipListMap|CopyOnWriteArrayList|CopyOnWriteArraySet|Atomic\w+|ThreadLocal|InheritableThreadLocal|ImmutableList|ImmutableMap|BlockingQueue\w*)\z"
UNSAFE = r"\A(?:HashMap|TreeMap|LinkedHashMap|Hashtable|ArrayList|LinkedList|HashSet|TreeSet|ArrayDeque|StringBuilder|StringBuffer|SimpleDateFormat|Date|LocalDate|LocalDateTime|Map|List|Set|Collection|int|long|double|float|boolean|byte|char|short)\z"
# Fixed pattern: parameter types that make good cache keys.
SIMPLE = r"\A(?:final\s+)?(?:java\.(?:lang|math|util|sql|time)\.)?(?:String|Integer|Long|Boolean|Byte|Short|Float|Double|Character|BigDecimal|BigInteger|Date|LocalDate|LocalDateTime|LocalTime|Timestamp|int|long|boolean|double|float|short|byte|char|void)(?:\[\])?\z"
# Fixed patterns: receivers and methods that go to the database.
MAPPER = r"(?:Mapper|Dao|DAO|Repository)\z"
QUERY = r"(?i)\A(?:select|find|get|query|list|count|exists|page|search|load|fetch|insert|update|delete|save|remove|batch)"
CREATED = ["new Thread", "new ThreadPoolExecutor", "new ScheduledThreadPoolExecutor", "an Executors factory", "a virtual thread"]
LOOPS = {"for": "a for loop", "while": "a while loop", "forEach": "an iteration", "stream": "a stream"}


def annotated(anns: Column, *names: str) -> Column:
    return F.exists(anns, lambda a: a["name"].isin(*names))


def annotation(anns: Column, *names: str) -> Column:
    """The first annotation of one of the names, null where there is none."""
    return F.get(F.filter(anns, lambda a: a["name"].isin(*names)), F.lit(0))


def has(words: str, word: str) -> Column:
    return F.array_contains(words, word)


@dataclass
class Java:
    """Structure tables of all Java units; members carry what their type says about transactions."""

    types: DataFrame
    members: DataFrame
    fields: DataFrame
    calls: DataFrame
    loops: DataFrame
    writes: DataFrame

    @classmethod
    def of(cls, structure: DataFrame) -> Java:
        types = table_of(structure, "types")
        members = table_of(structure, "members")
        on_type = types.select("path", "type_ix", annotation(F.col("annotations"), "Transactional")["args"].alias("type_tx"))
        joined = members.join(on_type, ["path", "type_ix"])
        own = annotation(F.col("annotations"), "Transactional")["args"]
        inherited = F.when((F.col("kind") == "method") & ~has("modifiers", "static"), F.col("type_tx"))
        return cls(types, joined.withColumn("tx", F.coalesce(own, inherited)).drop("type_tx"), table_of(structure, "fields"), table_of(structure, "calls"), table_of(structure, "loops"), table_of(structure, "writes"))

    def self_calls(self) -> DataFrame:
        """Calls on the same instance, with their callers."""
        plain = self.calls.filter((F.size("receiver") == 0) | ((F.size("receiver") == 1) & (F.get("receiver", F.lit(0)) == "this")))
        callers = self.members.select("path", "member_ix", F.col("name").alias("caller"), F.col("tx").alias("caller_tx"), has("modifiers", "static").alias("caller_static"))
        return plain.join(callers, ["path", "member_ix"])

    def invoked(self, targets: DataFrame) -> DataFrame:
        """Self calls joined with the given members of the same type and name."""
        t = targets.select("path", "type_ix", F.col("name").alias("callee"), F.col("member_ix").alias("target_ix"), F.col("line").alias("target_line"), F.size("params").alias("n_params"), F.col("tx").alias("target_tx"), F.col("annotations").alias("target_ann"))
        return self.self_calls().join(t, ["path", "type_ix", "callee"])


def _present(args: Column, keys: list[str]) -> Column:
    return F.arrays_overlap(F.map_keys(args), F.array(*map(F.lit, keys)))


def _filled(args: Column, key: str) -> Column:
    """The value of a key that is there and not empty."""
    v = F.try_element_at(args, F.lit(key))
    return F.coalesce(v, F.lit("")) != ""


def spr001(java: Java) -> DataFrame:
    targets = java.members.filter((F.col("kind") == "method") & F.col("tx").isNotNull() & ~has("modifiers", "static") & ~has("modifiers", "private"))
    each = java.invoked(targets).filter(~F.col("caller_static") & (F.col("arity") == F.col("n_params")))
    caller, target = F.col("caller_tx"), F.col("target_tx")
    entries = lambda m: F.array_sort(F.map_entries(m))
    joins = F.coalesce(F.try_element_at(target, F.lit("propagation")), F.lit("REQUIRED")).isin(*JOINING)
    harmless = caller.isNotNull() & (~_present(target, TX_KEYS) | (joins & (entries(caller) == entries(target))))
    own = each.filter(~F.coalesce(harmless, F.lit(False)))
    return drafts(own, "SPR001", "line", ["type_ix", "member_ix", "off", "target_ix"], F.concat("caller", F.lit("() calls the transactional "), "callee", F.lit("() on the same instance")), "Move the method to another bean, or call it through the bean's own proxy.")


def checked(throws: str) -> Column:
    return F.filter(throws, lambda t: (t != "") & ~t.rlike(UNCHECKED))


def spr002(java: Java) -> DataFrame:
    own = java.members.withColumn("checked", checked("throws")).filter(F.col("tx").isNotNull() & (F.size("checked") > 0))
    for k in ROLLBACK_KEYS:
        own = own.filter(~_filled(F.col("tx"), k))
    return drafts(own, "SPR002", "line", ["type_ix", "member_ix"], F.concat("name", F.lit("() throws "), F.array_join("checked", ", "), F.lit(", which does not roll its transaction back")), "Set rollbackFor.")


def spr003(java: Java) -> DataFrame:
    first = annotation(F.col("annotations"), "Async", "Scheduled")["name"]
    marked = java.members.withColumn("how", first).filter("how is not null")
    static, public = has("modifiers", "static"), has("modifiers", "public")
    broken = static | ~public | ((F.col("how") == "Scheduled") & (F.size("params") > 0))
    why = F.concat_ws("; ", F.when(static, "it is static").when(~public, "it is not public"), F.when((F.col("how") == "Scheduled") & (F.size("params") > 0), "it takes arguments"))
    direct = drafts(marked.filter(broken), "SPR003", "line", ["type_ix", "member_ix", F.lit(-1), F.lit(0)], F.concat(F.lit("@"), "how", F.lit(" on "), "name", F.lit("() has no effect: "), why), "Make it public, not static, and without arguments if scheduled.")
    each = java.invoked(marked.filter(~broken)).filter((F.col("caller") != F.col("callee")) & ~F.col("caller_static") & (F.col("naive_arity") == F.col("n_params")))
    called = drafts(each, "SPR003", "line", ["type_ix", "target_ix", "member_ix", "off"], F.concat("caller", F.lit("() calls "), "callee", F.lit("() on the same instance, so it runs at once")), "Move the method to another bean.")
    return direct.unionByName(called)


def spr004(java: Java) -> DataFrame:
    beans = java.types.filter((F.col("kind") != "anonymous") & (annotated(F.col("annotations"), *THREAD_BEANS) | F.col("name").rlike(THREAD_BEAN_NAME))).select("path", "type_ix", F.col("name").alias("type_name"))
    own = java.members.filter(~annotated(F.col("annotations"), "Bean") & ~((F.col("kind") == "constructor") & has("modifiers", "private")))
    each = own.join(beans, ["path", "type_ix"]).select("path", "type_ix", "member_ix", "name", "type_name", F.explode("creations").alias("c"))
    what = F.element_at(F.array(*map(F.lit, CREATED)), F.col("c.what") + 1)
    return drafts(each, "SPR004", "c.line", ["type_ix", "member_ix", "c.what"], F.concat("type_name", F.lit("."), "name", F.lit("() makes "), what), "Inject a bounded executor that the container shuts down.")


def spr005(java: Java) -> DataFrame:
    scope = annotation(F.col("annotations"), "Scope")
    scoped = annotated(F.col("annotations"), *SCOPES) | F.coalesce(F.coalesce(scope["raw"], F.lit("")).rlike("(?i)prototype|request|session|application") & scope.isNotNull(), F.lit(False))
    beans = java.types.filter((F.col("kind") != "anonymous") & (annotated(F.col("annotations"), *BEANS) | F.col("name").rlike(BEAN_NAME)) & ~scoped).select("path", "type_ix", F.col("name").alias("type_name"), "body_start", "body_end")
    bare = lambda t: F.substring_index(F.trim(F.regexp_replace(t, r"<[\s\S]*", "")), ".", -1)
    f = java.fields.filter(~has("modifiers", "static") & ~has("modifiers", "volatile") & ~annotated(F.col("annotations"), *INJECTED))
    init = F.coalesce("initializer", F.lit(""))
    f = f.withColumns({"bare": bare(F.col("type")), "is_array": F.trim("type").rlike(r"[\[\]]\z"), "made": F.substring_index(F.regexp_extract(init, r"new\s+([A-Za-z_$][\w$.]*)", 1), ".", -1)})
    safe = F.col("bare").rlike(SAFE) | F.col("made").rlike(SAFE) | init.rlike(r"Collections\s*\.\s*(?:synchronized|unmodifiable)\w+") | init.rlike(r"\A\s*(?:List|Set|Map|ImmutableList|ImmutableMap)\s*\.\s*of\s*\(")
    f = f.filter(~safe & (F.col("is_array") | F.col("bare").rlike(UNSAFE)))
    # a field belongs to every bean whose body is around it
    inside = all_around(f, beans, ["path"], "start", "body_start", "body_end", "bean").filter(F.col("end") < F.col("bean.body_end"))
    inside = inside.select("*", "bean.type_ix", "bean.type_name").drop("bean")
    open_ = java.members.filter((F.col("kind") != "constructor") & ~annotated(F.col("annotations"), "PostConstruct", "Transactional") & ~has("modifiers", "synchronized"))
    writes = java.writes.join(open_.select("path", "member_ix", F.col("name").alias("method")), ["path", "member_ix"]).select("path", "type_ix", F.col("name").alias("field"), "member_ix", "method", F.col("line").alias("write_line"))
    each = inside.withColumn("field", F.explode("names")).join(writes, ["path", "type_ix", "field"])
    rows = each.groupBy("path", "type_ix", "type_name", "field_ix", "names", "line").agg(F.count("*").alias("n"), F.min(F.struct("member_ix", "write_line", "method")).alias("first"))
    message = F.concat(F.lit("field "), F.array_join("names", ", "), F.lit(" of the singleton "), "type_name", F.lit(" is written in "), "n", F.lit(" unguarded places, first in "), "first.method", F.lit("() on line "), "first.write_line")
    return drafts(rows, "SPR005", "line", ["type_ix", "field_ix"], message, "Use a local variable or a type that is safe to share.")


def spr006(java: Java) -> DataFrame:
    cached = annotation(F.col("annotations"), "Cacheable")["args"]
    marked = java.members.withColumn("cache", F.coalesce(cached, F.when(annotated(F.col("annotations"), "Cacheable"), F.create_map().cast("map<string,string>")))).filter("cache is not null")

    def simple(p: Column) -> Column:
        clean = F.regexp_replace(F.trim(F.regexp_replace(p, r"@\w+(?:\([^)]*\))?\s*", "")), r"\.\.\.\z", "")
        return F.regexp_replace(clean, r"\s+\S*\z", "").rlike(SIMPLE)

    keyless = marked.filter((F.size("params") > 1) & ~_filled(F.col("cache"), "key") & ~_filled(F.col("cache"), "condition") & F.exists("params", lambda p: ~simple(p)))
    direct = drafts(keyless, "SPR006", "line", ["type_ix", "member_ix", F.lit(-1), F.lit(0)], F.concat("name", F.lit("() is cached under all of its "), F.size("params").cast("string"), F.lit(" parameters")), "Write the key out.")
    targets = marked.filter(~has("modifiers", "private") & ~has("modifiers", "static"))
    each = java.invoked(targets).filter(F.col("caller") != F.col("callee"))
    called = drafts(each, "SPR006", "line", ["type_ix", "target_ix", "member_ix", "off"], F.concat("caller", F.lit("() calls the cached "), "callee", F.lit("() on the same instance, past the cache")), "Move the method to another bean.")
    return direct.unionByName(called)


def calls_in_loops(java: Java) -> DataFrame:
    """Calls with the first loop around them in their member."""
    loops = java.loops.select("path", "member_ix", F.col("kind").alias("loop"), "start", "end")
    calls = java.calls.select("path", "member_ix", "type_ix", "off", "callee", "line", "receiver")
    near = first_around(calls, loops, ["path", "member_ix"], "off", "start", "end", "around")
    return near.select("path", "type_ix", "member_ix", "off", "callee", "line", "receiver", F.col("around.loop").alias("loop"))


def myb002(java: Java) -> DataFrame:
    mapped = java.fields.filter(F.trim(F.regexp_replace("type", r"<[\s\S]*", "")).rlike(MAPPER)).select("path", F.explode("names").alias("n"))
    names = mapped.groupBy("path").agg(F.collect_set("n").alias("mappers"))
    each = calls_in_loops(java).filter((F.size("receiver") > 0) & F.col("callee").rlike(QUERY)).join(names, "path", "left")
    receiver = F.array_join("receiver", ".")
    known = F.coalesce(F.array_contains("mappers", F.get("receiver", F.lit(0))) | F.array_contains("mappers", receiver), F.lit(False))
    own = each.filter((receiver == "baseMapper") | receiver.rlike(MAPPER) | known)
    loop = F.element_at(F.create_map(*[F.lit(x) for kv in LOOPS.items() for x in kv]), F.col("loop"))
    return drafts(own, "MYB002", "line", [F.lit(0), "type_ix", "member_ix", "off"], F.concat(receiver, F.lit("."), "callee", F.lit("() runs once for each element of "), loop), "Collect the ids and query once.")
