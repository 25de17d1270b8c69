"""Reports. What grows with the findings is made as columns; only the rendering of one review's rows is on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text as X
from lintlake.operators import findings as fin
from lintlake.plans.catalogue import RULES, rule
from lintlake.plans.review import Review
from lintlake.sources.documents import section, write_document

TOOL = "lintlake"
# Terminal codes.
_CODES = {"bold": "\x1b[1m", "dim": "\x1b[2m", "error": "\x1b[31m", "warn": "\x1b[33m", "info": "\x1b[34m", "file": "\x1b[36m", "good": "\x1b[32m"}


def annotation_level(severity: Column) -> Column:
    return F.when(severity == "error", "error").when(severity == "warn", "warning").otherwise("notice")


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "error", "error").when(severity == "warn", "warning").otherwise("note")


def annotations(findings: DataFrame) -> DataFrame:
    """(value): one workflow command for each finding, in report order; can be written with write.text."""
    title = X.escape_property(F.concat("rule", F.lit(f" {TOOL}")))
    text = F.concat(F.lit("::"), annotation_level(F.col("severity")), F.lit(" file="), X.escape_property(F.col("file")), F.lit(",line="), "line", F.lit(",title="), title, F.lit("::"), X.escape_message(X.flat(F.col("message"))))
    return findings.orderBy(*fin.ordering()).select(text.alias("value"))


def json_rows(findings: DataFrame, *keys: Column) -> DataFrame:
    """(value): one JSON object for each finding; missing suggestions are written as null."""
    fields = F.struct("rule", "severity", "file", "line", F.coalesce("end_line", "line").alias("endLine"), "snippet", "message", "suggestion")
    return findings.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"), *keys)


def sarif_results(findings: DataFrame, *keys: Column) -> DataFrame:
    """(value): one SARIF result for each finding, as JSON."""
    place = F.create_map(*[F.lit(x) for k, r in enumerate(RULES) for x in (r.id, k)])
    text = F.concat("message", F.coalesce(F.concat(F.lit("\n"), "suggestion"), F.lit("")))
    region = F.struct(F.col("line").alias("startLine"), F.lit(1).alias("startColumn"), F.struct(F.col("snippet").alias("text")).alias("snippet"))
    where = F.struct(F.struct(F.struct(F.col("file").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    one = F.struct(F.col("rule").alias("ruleId"), F.coalesce(F.try_element_at(place, F.col("rule")), F.lit(0)).alias("ruleIndex"), sarif_level(F.col("severity")).alias("level"), F.struct(text.alias("text")).alias("message"), F.array(where).alias("locations"))
    return findings.select(F.to_json(one).alias("value"), *keys)


def save(findings: DataFrame, folder: str, kind: str = "json") -> None:
    """Findings as lines of text files below a folder, written by executors: json, sarif (results) or github."""
    {"json": json_rows, "sarif": sarif_results, "github": annotations}[kind](findings).write.text(folder)


@dataclass
class Collected:
    """A review on the driver: rows are read in order, a partition at a time."""

    findings: list
    skipped: list
    units: int

    @classmethod
    def of(cls, r: Review) -> Collected:
        found = list(r.findings.orderBy(*fin.ordering()).toLocalIterator())
        return cls(found, list(r.skipped.orderBy("stage", "seq").toLocalIterator()), r.units.count())

    def count(self, severity: str) -> int:
        return sum(f.severity == severity for f in self.findings)

    def rules(self) -> list[str]:
        return sorted({f.rule for f in self.findings})

    def exit_code(self) -> int:
        return int(any(f.severity == "error" for f in self.findings))


def _summary(units: int, counts: dict[str, int], rules: list[str]) -> dict:
    return {"units": units, "errors": counts.get("error", 0), "warnings": counts.get("warn", 0), "infos": counts.get("info", 0), "hitRules": rules}


def _sarif(version: str, results: list | str) -> dict:
    level = {"error": "error", "warn": "warning"}
    rules = [{"id": r.id, "name": r.title, "shortDescription": {"text": r.title}, "fullDescription": {"text": r.rationale}, "defaultConfiguration": {"level": level.get(r.severity, "note")}} for r in RULES]
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": TOOL, "version": version, "rules": rules}}, "results": results}]}


#: Stands for a section in the text of a document whose lists are written by tasks.
_HOLE = "\x00%d"


def _layout(document: dict, margins: list[str]) -> list:
    """The text of a document, with sections where its holes are."""
    text = json.dumps(document, indent=2, ensure_ascii=False) + "\n"
    out: list = []
    for k, margin in enumerate(margins):
        before, text = text.split(json.dumps(_HOLE % k), 1)
        out += [before, section(k, margin)]
    return [*out, text]


def save_document(r: Review, path: str, kind: str = "json", version: str = "0") -> None:
    """The whole report as one JSON or SARIF file, the same bytes that `render_json` or `render_sarif` gives.

    Tasks sort and write the findings and skipped files; only counts reach the driver.
    """
    none = [F.lit(None).cast(t).alias(k) for k, t in (("k4", "bigint"), ("k5", "int"), ("k6", "array<int>"))]
    names = [f"k{k}" for k in range(1, 7)]
    keys = [(-X.severity_rank(F.col("severity"))).alias("k1"), F.col("file").alias("k2"), F.col("line").cast("bigint").alias("k3"), F.col("unit_ord").cast("bigint").alias("k4"), F.col("rule_ord").cast("int").alias("k5"), F.col("draft_seq").cast("array<int>").alias("k6")]
    if kind == "sarif":
        rows = sarif_results(r.findings, *keys).withColumn("section", F.lit(0))
        write_document(rows, names, _layout(_sarif(version, _HOLE % 0), [" " * 6]), path)
        return
    counts = {x.severity: x.n for x in fin.severity_counts(r.findings).collect()}
    hit = fin.hit_rules(r.findings).first().hit_rules
    summary_ = _summary(r.units.count(), counts, hit.split(",") if hit else [])
    found = json_rows(r.findings, *keys).withColumn("section", F.lit(1))
    left = r.skipped.select(F.to_json(F.struct("path", "reason"), {"ignoreNullFields": "false"}).alias("value"), F.col("stage").cast("int").alias("k1"), F.lit(None).cast("string").alias("k2"), F.col("seq").cast("bigint").alias("k3"), *none, F.lit(0).alias("section"))
    document = {"tool": TOOL, "version": 1, "summary": summary_ | {"skipped": _HOLE % 0}, "findings": _HOLE % 1}
    layout = _layout(document, [" " * 4, " " * 2])
    write_document(left.unionByName(found), names, layout, path)


def render_json(c: Collected, indent: int = 2) -> str:
    rows = [{"rule": f.rule, "severity": f.severity, "file": f.file, "line": f.line, "endLine": f.end_line or f.line, "snippet": f.snippet, "message": f.message, "suggestion": f.suggestion} for f in c.findings]
    summary = _summary(c.units, {s: c.count(s) for s in ("error", "warn", "info")}, c.rules()) | {"skipped": [{"path": s.path, "reason": s.reason} for s in c.skipped]}
    return json.dumps({"tool": TOOL, "version": 1, "summary": summary, "findings": rows}, indent=indent, ensure_ascii=False) + "\n"


def render_sarif(c: Collected, version: str = "0") -> str:
    level = {"error": "error", "warn": "warning"}
    place = {r.id: k for k, r in enumerate(RULES)}
    results = []
    for f in c.findings:
        region = {"startLine": f.line, "startColumn": 1, "snippet": {"text": f.snippet}}
        text = f"{f.message}\n{f.suggestion}" if f.suggestion else f.message
        results.append({"ruleId": f.rule, "ruleIndex": place.get(f.rule, 0), "level": level.get(f.severity, "note"), "message": {"text": text}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f.file, "uriBaseId": "%SRCROOT%"}, "region": region}}]})
    return json.dumps(_sarif(version, results), indent=2, ensure_ascii=False) + "\n"


def render_annotations(c: Collected) -> str:
    esc = lambda t: t.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    prop = lambda t: esc(t).replace(":", "%3A").replace(" ", "%20")
    level = {"error": "error", "warn": "warning"}
    out = [f"::{level.get(f.severity, 'notice')} file={prop(f.file)},line={f.line},title={prop(f.rule + ' ' + TOOL)}::{esc(' '.join(f.message.split()))}" for f in c.findings]
    out.append(f"::notice::{esc(f'{TOOL}: {c.count("error")} error(s), {c.count("warn")} warning(s), {c.count("info")} info across {c.units} file(s)')}")
    return "\n".join(out) + "\n"


def render_table(c: Collected, color: bool = False, summary: str | None = None) -> str:
    paint = (lambda t, *k: "".join(_CODES[x] for x in k) + t + "\x1b[0m") if color else (lambda t, *k: t)
    out: list[str] = []
    if not c.findings:
        out.append(paint(f"{TOOL}: {c.units} file(s) reviewed, no findings", "good"))
    files: dict[str, list] = {}
    for f in c.findings:
        files.setdefault(f.file, []).append(f)
    for name, own in files.items():
        out += ["", paint(name, "bold", "file")]
        for f in own:
            out.append(f"  {paint(f'{f.file}:{f.line}', 'dim')}  {paint(f'{f.severity:<5}', f.severity, 'bold')}  {paint(f.rule, 'bold')}  {f.message}")
            out += [paint(f"      {_short(f.snippet)}", "dim")] if f.snippet else []
            out += [paint(f"      > {_short(f.suggestion)}", "good")] if f.suggestion else []
    if c.findings:
        counts = [(c.count("error"), "error(s)", "error"), (c.count("warn"), "warning(s)", "warn"), (c.count("info"), "info", "info")]
        out += ["", "  ".join([paint(f"{n} {w}", k) for n, w, k in counts if n] + [paint(f"across {len(files)} file(s), rules hit: {', '.join(c.rules())}", "dim")])]
    if c.skipped:
        out += ["", paint("skipped (nothing was guessed):", "dim")]
        out += [paint(f"  {line}", "dim") for line in dict.fromkeys(f"{s.path}: {s.reason}" for s in c.skipped)]
    if summary:
        out += ["", summary.strip()]
    return "\n".join(out)


def _short(text: str) -> str:
    flat = " ".join(text.split())
    return f"{flat[:157]}…" if len(flat) > 160 else flat


def summary(r: Review) -> str:
    """The offline summary: what was reviewed, the rules with the most findings, whether anything blocks."""
    total = r.findings.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("e")).first()
    units = r.units.count()
    if not total.n:
        return f"Reviewed {units} file(s) against {len(RULES)} rules: nothing to flag."
    lines = [f"Reviewed {units} file(s); {total.n} finding(s)" + (f", {total.e} of them blocking." if total.e else "."), ""]
    lines += [f"- {t.rule} ({rule(t.rule).title}): {t.n}x  {t.where_text}" for t in fin.top_rules(r.findings).collect()]
    return "\n".join([*lines, "", "Deal with the errors before merging." if total.e else "No errors; ready to merge."])
