"""The shape that every rule gives its results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.plans.catalogue import rule

COLUMNS = ["path", "rule_ord", "draft_seq", "rule", "severity", "line", "end_line", "message", "suggestion"]


def drafts(df: DataFrame, id_: str, line: str | Column, seq: list, message: Column, suggestion: str | Column | None = None, severity: Column | None = None) -> DataFrame:
    """Rows with a path as drafts of a rule; `seq` orders the drafts of a file as they are emitted."""
    r = rule(id_)
    at = (F.col(line) if isinstance(line, str) else line).cast("int")
    hint = suggestion if isinstance(suggestion, Column) else F.lit(suggestion).cast("string")
    return df.select("path", F.lit(r.ord).alias("rule_ord"), F.array(*[(F.col(s) if isinstance(s, str) else s).cast("int") for s in seq]).alias("draft_seq"), F.lit(r.id).alias("rule"), (severity if severity is not None else F.lit(r.severity)).alias("severity"), at.alias("line"), at.alias("end_line"), message.alias("message"), hint.alias("suggestion"))
