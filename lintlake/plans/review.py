"""The plan of a review: units to structure tables to drafts to findings."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text as X
from lintlake.operators import findings as fin
from lintlake.operators import mapper_xml as mx
from lintlake.operators.java_structure import FAILED, SCHEMA, java_structure, table_of
from lintlake.plans import rules_java as rj
from lintlake.plans import rules_sql as rs
from lintlake.plans.catalogue import RULE_IDS, RULES
from lintlake.plans.drafting import COLUMNS
from lintlake.session import cut
from lintlake.sources.units import companions_of


@dataclass(frozen=True)
class Options:
    min_severity: str = "warn"
    exclude: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    experimental: bool = False

    def rules(self) -> list[str]:
        """Ids of the rules that may run; ids are compared in capitals."""
        only, off = {x.upper() for x in self.only}, {x.upper() for x in self.disabled}
        return [r.id for r in RULES if (not only or r.id in only) and r.id not in off and (self.experimental or not r.experimental)]


@dataclass
class Review:
    """findings, skipped and reviewed units as DataFrames."""

    findings: DataFrame
    skipped: DataFrame
    units: DataFrame


@dataclass(frozen=True)
class Context:
    """What rules read: units with their elements, Java structure, SQL scopes, companions. `path` is the key of a unit."""

    units: DataFrame
    structure: DataFrame
    elements: DataFrame
    scopes: DataFrame | None
    java: rj.Java
    companions: DataFrame


    def of(self, share: int, shares: int) -> Context:
        """The same tables for a share of the units."""
        own = F.pmod(F.xxhash64("path"), F.lit(shares).cast("long")) == share
        structure = self.structure.filter(own)
        return Context(self.units.filter(own), structure, self.elements.filter(own), self.scopes.filter(own) if self.scopes is not None else None, rj.Java.of(structure), self.companions.filter(own))


RuleOf = Callable[[Context], DataFrame]
#: The review's own rules, from the tables they read to drafts.
MAKE: dict[str, RuleOf] = {
    "SPR001": lambda c: rj.spr001(c.java), "SPR002": lambda c: rj.spr002(c.java), "SPR003": lambda c: rj.spr003(c.java), "SPR004": lambda c: rj.spr004(c.java), "SPR005": lambda c: rj.spr005(c.java), "SPR006": lambda c: rj.spr006(c.java),
    "MYB001": lambda c: rs.myb001(c.scopes), "MYB002": lambda c: rj.myb002(c.java).unionByName(rs.nested_selects(mx.nested_selects(c.elements, "path"))), "MYB003": lambda c: rs.myb003(c.scopes), "MYB004": lambda c: rs.myb004(c.scopes), "MYB005": lambda c: rs.myb005(c.scopes, c.companions),
}
#: Runs of one rule on shares of the units before what still fails is given up together.
MOST_RUNS = 64
_NO_DRAFTS = "path string, rule_ord int, draft_seq array<int>, rule string, severity string, line int, end_line int, message string, suggestion string"


def _reason(e: Exception) -> str:
    """The line of an error that says what went wrong: that of the Python error in a task, if there is one."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    told = [x for x in lines if re.match(r"[A-Za-z_.]*(?:Error|Exception)\b.*", x) and not x.startswith(("org.apache.spark", "at "))]
    return (told[-1] if told else lines[0] if lines else type(e).__name__)[:200]


def run_rules(rules: Sequence[tuple[str, RuleOf]], context: Context) -> tuple[DataFrame, list[tuple[str, int, int, str]]]:
    """The drafts of all rules, and what failed: (rule, share, shares, reason), the units of a share that a rule did not get through.

    All rules run in one job, which is all there is to it as long as none fails. A rule that cannot be built fails for all
    units. If the job fails, each rule runs by itself, and one that fails runs again on halves of its units, until what
    fails is a single unit, or MOST_RUNS runs are used up. All others' drafts stay.
    """
    spark, failed, built = context.units.sparkSession, [], []
    for id_, rule in rules:
        try:
            built.append((id_, rule, rule(context).select(*COLUMNS)))
        except Exception as e:  # noqa: BLE001 - whatever a rule raises is its own
            failed.append((id_, 0, 1, _reason(e)))
    none = spark.createDataFrame([], _NO_DRAFTS)
    try:
        return cut(reduce(DataFrame.unionByName, [d for *_, d in built], none)), failed
    except Exception:  # noqa: BLE001
        kept = [none]
    for id_, rule, whole in built:
        todo, runs = [(0, 1, whole)], 0
        while todo:
            share, shares, drafts = todo.pop()
            runs += 1
            try:
                kept.append(cut(drafts))
                continue
            except Exception as e:  # noqa: BLE001
                reason = _reason(e)
            own = context.of(share, shares)
            if runs >= MOST_RUNS or len(own.units.select("path").limit(2).collect()) < 2:
                failed.append((id_, share, shares, reason))
            else:
                todo += [(k, 2 * shares, rule(context.of(k, 2 * shares)).select(*COLUMNS)) for k in (share, share + shares)]
    return reduce(DataFrame.unionByName, kept), failed


def scopes(units: DataFrame, structure: DataFrame, el: DataFrame | None = None) -> DataFrame:
    """All SQL scopes with their number in a file: statements, fragments, annotation SQL."""
    xml = mx.xml_scopes(mx.elements(units, "path") if el is None else el, "path")
    java = table_of(structure, "sql").select("path", (F.col("ord") + 1).alias("scope_ix"), "kind", F.concat("kind", F.lit("Annotation")).alias("id"), "raw", X.flat(mx.strip_tags(F.col("raw"))).alias("resolved"), "line", F.col("line").alias("base"), F.lit("annotation").alias("source"), F.array().cast("array<string>").alias("unresolved"))
    return xml.unionByName(java)


#: What a file must hold (a Java one, a mapper) for a rule to say anything about it; such words are never put together from parts, but across
#: the edges of CDATA, so mappers with CDATA count for every rule.
_TRANSACTIONAL, _SQL_MARK = "Transactional", "@(?:Select|Update|Insert|Delete)"
HOLDS: dict[str, tuple[str, str | None]] = {
    "SPR001": (_TRANSACTIONAL, None), "SPR002": (_TRANSACTIONAL, None), "SPR003": ("Async|Scheduled", None), "SPR004": ("Thread|Executors", None), "SPR005": (rj.BEAN_WORDS, None), "SPR006": ("Cacheable", None),
    "MYB001": (_SQL_MARK, r"\$\{"), "MYB002": ("for|while|map|flatMap|peek", "<(?:collection|association)"), "MYB003": (_SQL_MARK, "(?i:like|concat|<bind)"), "MYB004": (_SQL_MARK, r"\*"), "MYB005": ("@Select", "(?i:from)"),
}


def concerned(rules: Sequence[str]) -> Column:
    """Whether a unit may hold what one of the rules looks for. The others are read no further until skipped files are asked for."""
    java, xml = ("|".join(filter(None, dict.fromkeys(HOLDS[r][k] for r in rules))) for k in (0, 1))
    held = lambda rx: F.col("content").rlike(rx) if rx else F.lit(False)
    mapper = held(f"{xml}|<!\\[CDATA\\[") if xml else F.lit(False)
    return F.coalesce(F.when(F.col("lang") == "java", held(java)).when(F.col("lang") == "xml", mapper), F.lit(True))


def gates(units: DataFrame, chosen: Column | None = None) -> DataFrame:
    """Units with `refused`, the reason for which an XML file is not reviewed (null where it is), and `els`, its elements.

    Comments are masked once for both. Both are null where `chosen` is not true.
    """
    xml = F.col("lang") == "xml"
    if chosen is not None:
        xml = xml & chosen
    masked = units.withColumn("masked", F.when(xml, X.mask_xml_comments(F.col("content"))))
    root = mx.root_element(F.col("masked"))
    reason = (
        F.when(~xml, F.lit(None).cast("string"))
        .when(~mx.is_mapper(F.col("masked")), "not a mapper XML")
        .when(F.col("content").rlike(mx.TEMPLATE), "a template, not a mapper")
        .when(F.col("complete") & root.isNotNull() & (root != "mapper"), F.concat(F.lit("root element is <"), root, F.lit(">, not <mapper>")))
    )
    return masked.withColumn("refused", reason).withColumn("els", F.when(xml & F.col("refused").isNull(), mx.element_array(F.col("masked")))).drop("masked")


#: What stands between a unit's number and its path in the key of its rows.
_KEY = "\x1f"
_STATEMENT_RULES = frozenset({"MYB001", "MYB003", "MYB004", "MYB005"})


def review(units: DataFrame, added: DataFrame | None = None, java_paths: DataFrame | None = None, options: Options = Options(), skipped: DataFrame | None = None, own_rules: Sequence[Callable[[Context], DataFrame]] = (), own_ids: Sequence[str] = ()) -> Review:
    """Review units (lintlake.sources.units) under options.

    own_rules: further rules, from the tables of a `Context` to drafts (lintlake.plans.drafting.COLUMNS), whose ids are
    own_ids; they see what all rules see, and their drafts pass the same gates.

    added: (path, line) that a diff added, for units that are not whole files. java_paths: (ord, path, content) of
    files that may be companions of mappers. What the active rules need is worked out once and written to the
    checkpoint folder, and so are the drafts. A unit whose structure cannot be read is skipped with a reason, and so is one
    on which a rule fails, for that rule (`run_rules`); the others are reviewed.
    """
    spark = units.sparkSession
    active = options.rules()
    chosen = F.lit(True) if own_rules else concerned(active)
    gated = cut(gates(units.withColumn("chosen", chosen), F.col("chosen")))
    # rows of a unit are told by its number and path: a path may come more than once
    keyed = lambda x: x.filter("refused is null").drop("refused").withColumn("file", F.col("path")).withColumn("path", F.concat(F.col("unit_ord"), F.lit(_KEY), "file"))
    ready = keyed(gated.filter("chosen"))
    # units about which no active rule can say anything: only lists of skipped and reviewed units come to read them
    rest = gates(gated.filter("not chosen").drop("refused", "els"))
    everything = ready if own_rules else ready.unionByName(keyed(rest))
    java_units = ready.filter("lang = 'java'")
    reads_java = bool(active) and not java_units.isEmpty()
    structure = cut(java_structure(java_units)) if reads_java else spark.createDataFrame([], SCHEMA)
    el = ready.filter("els is not null").select("path", "els")
    sc = cut(scopes(ready, structure, el)) if _STATEMENT_RULES & set(active) else None
    java = rj.Java.of(structure)
    companions = companions_of(mx.namespace_of(el, "path"), java_paths) if java_paths is not None else spark.createDataFrame([], "path string, companion_path string, companion_content string")

    # which rules apply to which units is a matter of the unit alone
    own = ["path", "file", "unit_ord", "lang", "complete", "whole_file", "chosen"]

    def with_issues(rows: DataFrame, structures: DataFrame) -> DataFrame:
        return rows.select(*own).join(structures.select("path", F.get("diagnostics", F.lit(0)).alias("issue")), "path", "left")

    slim = with_issues(ready, structure) if reads_java else ready.select(*own, F.lit(None).cast("string").alias("issue"))
    told = slim if own_rules else slim.unionByName(with_issues(keyed(rest), java_structure(keyed(rest))))
    full = [r.id for r in RULES if r.needs_full]
    unread = F.coalesce(F.startswith("issue", F.lit(FAILED)), F.lit(False))

    named = [(i, MAKE[i]) for i in active] + [((list(own_ids) + [f"OWN{k}"])[min(k, len(own_ids))], rule) for k, rule in enumerate(own_rules)]
    drafts, failed = run_rules(named, Context(ready, structure, el, sc, java, companions))
    drafts = drafts.join(slim.select("path", "file", "unit_ord", "complete", "whole_file", "issue"), "path")
    drafts = drafts.filter(~F.col("rule").isin(full) | (F.col("complete") & F.col("issue").isNull())).filter("line >= 1")
    lines = (added if added is not None else spark.createDataFrame([], "path string, line int")).withColumnRenamed("path", "file").distinct()
    on = [c for c in ("file", "unit_ord", "line") if c in lines.columns]
    kept = drafts.filter("whole_file").unionByName(drafts.filter("not whole_file").join(lines, on, "left_semi")).drop("whole_file", "complete", "issue")
    unit = kept.withColumnsRenamed({"file": "shown", "path": "file"})
    kept = fin.unsuppressed(unit, fin.suppressions(ready), [*RULE_IDS, *own_ids]).withColumnsRenamed({"file": "unit", "shown": "file"})
    found = fin.at_least(fin.first_wins(kept), options.min_severity)
    found = fin.with_snippets(found, ready, "unit").drop("unit")

    blank = everything.filter(F.col("els").isNotNull() & (F.size(mx.statements()) + F.size(mx.fragments()) == 0)).select("unit_ord", F.lit(-1).alias("k"), F.col("file").alias("path"), F.lit("no mapper SQL in this file").alias("reason"))
    refused = (gated if own_rules else gated.filter("chosen").unionByName(rest)).filter("refused is not null").select("unit_ord", F.lit(-2).alias("k"), "path", F.col("refused").alias("reason"))
    needs = F.array(*[F.struct(F.lit(r.ord).alias("ord"), F.lit(r.id).alias("id"), F.lit(r.target).alias("target"), F.lit(r.needs_full).alias("full")) for r in RULES if r.id in active]) if active else F.array().cast("array<struct<ord:int,id:string,target:string,full:boolean>>")
    why = F.when(unread, F.col("issue")).when(F.col("r.full") & ~F.col("complete"), "file not fully available (patch fragment)").when(F.col("r.full"), F.col("issue"))
    passed = told.select("*", F.explode(needs).alias("r")).filter((F.col("r.target") == "both") | (F.col("r.target") == F.col("lang"))).withColumn("why", why).filter("why is not null")
    passed = passed.select("unit_ord", F.col("r.ord").alias("k"), F.col("file").alias("path"), F.concat("r.id", F.lit(": "), "why").alias("reason"))
    targets = {r.id: (r.ord, r.target) for r in RULES}
    stopped = spark.createDataFrame([(i, *targets.get(i, (90, "both")), share, shares, f"{i}: {reason}") for i, share, shares, reason in failed], "id string, k int, target string, share bigint, shares bigint, reason string")
    hit = told.join(F.broadcast(stopped), (F.col("target") == "both") | (F.col("target") == F.col("lang"))) if failed else None
    if hit is not None:
        # a share is one of the units that the rule ran on
        hit = hit.filter((F.col("chosen") | (F.col("shares") == 1)) & (F.pmod(F.xxhash64("path"), F.col("shares")) == F.col("share")) & ~(F.col("id").isin(full) & (~F.col("complete") | F.col("issue").isNotNull())))
        passed = passed.unionByName(hit.select("unit_ord", "k", F.col("file").alias("path"), "reason"))
    own = refused.unionByName(blank).unionByName(passed).select(F.lit(2).alias("stage"), (F.col("unit_ord") * 100 + F.col("k")).cast("bigint").alias("seq"), "path", "reason")
    shown = everything.drop("path", "els").withColumnRenamed("file", "path").select(*[c for c in units.columns])
    return Review(found, own if skipped is None else skipped.unionByName(own), shown)
