"""Rules as SQL text, and table functions that give one file's rows to SQL.

A rule is a SELECT over the tables of a review's `Context`, named in braces: {units}, {elements}, {scopes}, {types},
{members}, {fields}, {calls}, {loops}, {writes}, {companions}. It gives `path`, `draft_seq` (an array of ints that orders a
file's drafts) and `line`; severity, order and the rest come from the catalogue, or stand in the SELECT. Such a rule
passes the same gates as all others, and takes part in their isolation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.java_structure import analyzed
from lintlake.plans.catalogue import RULES
from lintlake.plans.drafting import COLUMNS
from lintlake.plans.rules_java import UNCHECKED

#: Tables that a rule may name.
TABLES = ("units", "elements", "scopes", "types", "members", "fields", "calls", "loops", "writes", "companions")
_KINDS = {"rule_ord": "int", "draft_seq": "array<int>", "rule": "string", "severity": "string", "line": "int", "end_line": "int", "message": "string", "suggestion": "string"}


def tables(context) -> dict[str, DataFrame]:  # noqa: ANN001 - a Context, whose module reads this one's neighbours
    """The tables of a context by the names that SQL has for them."""
    own = {n: getattr(context, n) for n in ("units", "elements", "scopes", "companions")}
    return {k: v for k, v in (own | {n: getattr(context.java, n) for n in TABLES if n not in own}).items() if v is not None}


def sql_rule(id_: str, text: str, severity: str = "warn", rule_ord: int = 90) -> Callable[[object], DataFrame]:
    """A rule for `review(..., own_rules=[...])` from SQL text; a table that the review has not built is an error of the rule."""
    known = next((r for r in RULES if r.id == id_), None)
    defaults = {"rule_ord": F.lit(known.ord if known else rule_ord), "rule": F.lit(id_), "severity": F.lit(known.severity if known else severity), "end_line": F.col("line"), "message": F.lit(known.title if known else id_), "suggestion": F.lit(None)}

    def run(context) -> DataFrame:  # noqa: ANN001
        named = {k: v for k, v in tables(context).items() if f"{{{k}}}" in text}
        rows = context.units.sparkSession.sql(text, **named)
        for c, value in defaults.items():
            if c not in rows.columns:
                rows = rows.withColumn(c, value)
        return rows.select("path", *[F.col(c).cast(_KINDS[c]).alias(c) for c in COLUMNS if c != "path"])

    return run


#: The rule on checked exceptions, as SQL over the table of members.
SPR002 = r"""
SELECT path, array(type_ix, member_ix) AS draft_seq, line,
  concat(name, '() throws ', array_join(checked, ', '), ', which does not roll its transaction back') AS message, 'Set rollbackFor.' AS suggestion
FROM (SELECT *, filter(throws, t -> t <> '' AND NOT t RLIKE r'UNCHECKED') AS checked FROM {members})
WHERE tx IS NOT NULL AND size(checked) > 0
  AND coalesce(tx['rollbackFor'], '') = '' AND coalesce(tx['rollbackForClassName'], '') = '' AND coalesce(tx['noRollbackFor'], '') = ''
""".replace("UNCHECKED", UNCHECKED)


class JavaMembers:
    """java_members(masked, commented): the members of one Java file, as rows."""

    def eval(self, masked: str, commented: str) -> Iterator[tuple]:
        for m in analyzed("", masked or "", commented or "")["members"]:
            yield m["kind"], m["name"], m["return_type"], len(m["params"]), m["line"]


class JavaCalls:
    """java_calls(masked, commented): the calls of one Java file, as rows."""

    def eval(self, masked: str, commented: str) -> Iterator[tuple]:
        for c in analyzed("", masked or "", commented or "")["calls"]:
            yield c["callee"], ".".join(c["receiver"]), c["arity"], c["line"]


def register(spark: SparkSession) -> None:
    """Make java_members and java_calls known to SQL: SELECT u.path, m.* FROM units u, LATERAL java_members(u.masked, u.commented) m."""
    spark.udtf.register("java_members", F.udtf(JavaMembers, returnType="kind string, name string, return_type string, arity int, line int"))
    spark.udtf.register("java_calls", F.udtf(JavaCalls, returnType="callee string, receiver string, arity int, line int"))
