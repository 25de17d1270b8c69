"""The rules: order, severity, target, gates and what they are for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    ord: int
    id: str
    severity: str
    target: str
    experimental: bool
    needs_full: bool
    title: str
    rationale: str


RULES = [
    Rule(0, "SPR001", "error", "java", False, True, "Self-invoked transactional method", "A call on the same instance does not pass the proxy, so the transaction it asks for never starts."),
    Rule(1, "SPR002", "error", "java", False, True, "Checked exception without a rollback rule", "By default only unchecked exceptions roll a transaction back; a checked one commits what was written."),
    Rule(2, "SPR003", "error", "java", False, True, "Ineffective async or scheduled method", "Static, hidden or self-called methods are not intercepted, and scheduled ones take no arguments."),
    Rule(3, "SPR004", "error", "java", False, True, "Threads created inside a bean", "Beans serve many requests at once; threads made in their methods are neither bounded nor shut down."),
    Rule(4, "SPR005", "warn", "java", True, True, "Mutable state in a singleton", "Fields of a singleton are shared by all requests; unguarded writes race."),
    Rule(5, "SPR006", "warn", "java", False, True, "Cache key or self-call of a cached method", "Without a key all parameters make up the key; a call on the same instance does not reach the cache."),
    Rule(6, "MYB001", "error", "both", False, False, "Raw interpolation into SQL", "Interpolated text becomes part of the statement; only bound parameters are safe."),
    Rule(7, "MYB002", "error", "both", False, True, "One query for each element", "Queries inside loops or nested selects go to the database once for each row."),
    Rule(8, "MYB003", "warn", "both", False, True, "Search with a leading wildcard", "An index cannot be used to find what ends or contains a text."),
    Rule(9, "MYB004", "warn", "both", False, True, "All columns selected", "Unneeded columns widen rows, defeat covering indexes and tie readers to the table's shape."),
    Rule(10, "MYB005", "error", "both", False, True, "Unbounded read of a table", "A select without a condition or limit brings the whole table into memory."),
]
RULE_IDS = [r.id for r in RULES]


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.ord, r.id, r.severity, r.target, r.experimental, r.needs_full, r.title, r.rationale) for r in RULES], "rule_ord int, id string, severity string, target string, experimental boolean, needs_full boolean, title string, rationale string")


def rule(id_: str) -> Rule:
    return next(r for r in RULES if r.id == id_)
