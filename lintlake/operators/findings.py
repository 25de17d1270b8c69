"""From drafts to findings: gates, added lines, suppressions, first-wins dedupe, severity, order, snippets, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import text as X
from lintlake.operators.ranking import global_row_number

#: What a suppression comment holds, whatever prefix stands before it.
MARKER = "review:disable"


def suppressions(units: DataFrame) -> DataFrame:
    """(path, line, rule): line is null for a whole file; rule is an id in capitals, or ALL.

    A comment on its own line is for the next line, another one for its own. Without a valid id it is for all rules.
    """
    marked = X.explode_lines(units.filter(F.col("content").contains(MARKER)), "content", "path").filter(F.col("text").contains(MARKER))
    after = F.regexp_replace(F.substring_index(F.substr("text", F.locate(MARKER, F.col("text")) + len(MARKER)), "\x00", 1), r"\A-file", "")
    words = F.split(F.regexp_replace(after, "\"[^\"]*\"|'[^']*'", " "), r"[\s,]+", -1)
    ids = F.array_distinct(F.filter(F.transform(words, F.upper), lambda w: w.rlike(r"\A(?:[A-Z]{3}\d{3}|ALL)\z")))
    target = F.when(F.col("text").contains("disable-file"), F.lit(None).cast("int")).when(X.trim(F.col("text")).rlike(r"\A(?://|/\*|\*|<!--|#)"), F.col("line") + 1).otherwise(F.col("line"))
    return marked.select("path", target.alias("line"), F.explode(F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit("ALL")))).alias("rule")).distinct()


def on_added_lines(drafts: DataFrame, units: DataFrame, added: DataFrame) -> DataFrame:
    """Drafts on lines that the diff added; all drafts of whole files. Drafts before line 1 go."""
    kind = units.select(F.col("path").alias("file"), "whole_file")
    own = drafts.filter("line >= 1").join(kind, "file")
    lines = added.select(F.col("path").alias("file"), "line").distinct()
    return own.filter("whole_file").unionByName(own.filter("not whole_file").join(lines, ["file", "line"], "left_semi")).drop("whole_file")


def unsuppressed(drafts: DataFrame, supp: DataFrame, rule_ids: list[str]) -> DataFrame:
    """Drafts without a suppression; ALL stands for every rule, so both joins are on equal keys."""
    every = F.when(F.col("rule") == "ALL", F.array(*map(F.lit, rule_ids))).otherwise(F.array("rule"))
    each = supp.select(F.col("path").alias("file"), "line", F.explode(every).alias("rule")).distinct()
    files = each.filter("line is null").select("file", "rule")
    lines = each.filter("line is not null")
    return drafts.join(files, ["file", "rule"], "left_anti").join(lines, ["file", "rule", "line"], "left_anti")


def first_wins(drafts: DataFrame) -> DataFrame:
    """Of drafts with the same rule, file and line the first one emitted."""
    w = Window.partitionBy("rule", "file", "line").orderBy("unit_ord", "rule_ord", "draft_seq")
    return drafts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(X.severity_rank(F.col("severity")) >= X.severity_rank(F.lit(severity)))


def ordering() -> list[Column]:
    """Worst first, then file and line, then the order of emission."""
    return [X.severity_rank(F.col("severity")).desc(), F.col("file"), F.col("line"), F.col("unit_ord"), F.col("rule_ord"), F.col("draft_seq")]


def with_snippets(findings: DataFrame, units: DataFrame, key: str = "file") -> DataFrame:
    """Findings with the source of their lines; `key` is the findings' column that has the units' path. Only files with findings are split."""
    own = findings.join(units.select(F.col("path").alias(key), "content"), key, "left")
    return own.withColumn("snippet", X.snippet(X.lines_of(F.col("content")), F.col("line"), F.coalesce("end_line", "line"))).drop("content")


# ------------------------------------------------------------------ roll-ups


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def by_file(findings: DataFrame) -> DataFrame:
    """(file, n, first_rank): files in the order in which the sorted findings first show them."""
    ranked = global_row_number(findings, ordering(), "rank")
    return ranked.groupBy("file").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"))


def hit_rules(findings: DataFrame) -> DataFrame:
    return findings.agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("hit_rules"))


def top_rules(findings: DataFrame, most: int = 6, samples: int = 3) -> DataFrame:
    """(rule, n, where_text): the rules with the most findings, ties by first appearance, with their first places.

    First places are chosen in shares of each rule's findings and then among those, so no rule is sorted in one task.
    """
    place = F.struct((-X.severity_rank(F.col("severity"))).alias("s"), "file", "line", "unit_ord", "rule_ord", "draft_seq").alias("at")
    rows = findings.select("rule", place, F.pmod(F.xxhash64("file", "line"), F.lit(256)).alias("share"))
    counts = rows.groupBy("rule").agg(F.count("*").alias("n"))
    for keys in (["rule", "share"], ["rule"]):
        w = Window.partitionBy(*keys).orderBy("at")
        rows = rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= samples)
    firsts = rows.groupBy("rule").agg(F.min("at").alias("first"), F.array_sort(F.collect_list("at")).alias("places"))
    text = F.array_join(F.transform("places", lambda p: F.concat(X.shorten_path(p["file"]), F.lit(":"), p["line"])), ", ")
    more = F.when(F.col("n") > samples, F.concat(F.lit(" +"), F.col("n") - samples, F.lit(" more"))).otherwise("")
    return firsts.join(counts, "rule").orderBy(F.desc("n"), "first").limit(most).select("rule", "n", F.concat(text, more).alias("where_text"))
