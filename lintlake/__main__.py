"""Command line: review paths, a patch, or a git diff. Exit 0: no errors found, 1: errors found, 2: could not run."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from lintlake import api, config, reports
from lintlake.plans.catalogue import RULES
from lintlake.session import session
from lintlake.sources import git as G


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lintlake", description=__doc__)
    p.add_argument("paths", nargs="*", help="files, folders or globs")
    p.add_argument("--diff", metavar="RANGE", help="review a git range A..B")
    p.add_argument("--staged", action="store_true", help="review what is staged")
    p.add_argument("--patch", metavar="FILE", help="review a unified diff; - reads standard input")
    p.add_argument("--format", choices=["table", "json", "github", "sarif"], default="table")
    p.add_argument("--min-severity", choices=["error", "warn", "info"])
    p.add_argument("--exclude", action="append", default=[], metavar="GLOB")
    p.add_argument("--only", action="append", metavar="RULES")
    p.add_argument("--disable", action="append", default=[], metavar="RULES")
    p.add_argument("--experimental", action="store_true", default=None)
    p.add_argument("--config", metavar="FILE")
    p.add_argument("--summary", action="store_true")
    p.add_argument("--output", metavar="PATH", help="write there, without bringing findings to the driver: one document for json and sarif where it ends in .json or .sarif, else a folder of lines")
    p.add_argument("--list-rules", action="store_true")
    p.add_argument("--no-color", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    cwd = os.getcwd()
    if a.list_rules:
        print(json.dumps([{"id": r.id, "title": r.title, "severity": r.severity, "appliesTo": r.target, "experimental": r.experimental, "rationale": r.rationale} for r in RULES], indent=2))
        return 0
    loaded = config.load(cwd, a.config, G.root_of(cwd))
    if loaded.error or (a.config and loaded.path is None):
        print(loaded.error or f"{a.config}: not readable", file=sys.stderr)
        return 2
    options = config.merge(loaded.config, a.min_severity, a.exclude, a.only, a.disable, a.experimental)
    if wrong := config.unknown_rules(options):
        print(f"unknown rules: {', '.join(wrong)}", file=sys.stderr)
        return 2
    spark = session()
    try:
        if a.patch:
            text = sys.stdin.read() if a.patch == "-" else Path(a.patch).read_text(encoding="utf-8", errors="replace")
            r = api.review_diff(spark, G.DiffSource("patch", text), cwd, options)
        elif a.paths and not a.diff and not a.staged:
            r = api.review_paths(spark, a.paths, cwd, options)
        else:
            r = api.review_diff(spark, G.DiffSource("range", a.diff) if a.diff else G.DiffSource("staged" if a.staged else "worktree"), cwd, options)
    except (OSError, ValueError) as e:
        print(str(e), file=sys.stderr)
        return 2
    if a.output:
        kind = "json" if a.format == "table" else a.format
        if kind != "github" and a.output.endswith((".json", ".sarif")):
            reports.save_document(r, a.output, kind)
        else:
            reports.save(r.findings, a.output, kind)
        return int(not r.findings.filter("severity = 'error'").isEmpty())
    done = reports.Collected.of(r)
    text = reports.summary(r) if a.summary else None
    color = not a.no_color and sys.stdout.isatty() and "NO_COLOR" not in os.environ
    render = {"table": lambda: reports.render_table(done, color, text), "json": lambda: reports.render_json(done), "github": lambda: reports.render_annotations(done), "sarif": lambda: reports.render_sarif(done)}[a.format]
    print(render(), end="" if a.format != "table" else "\n")
    if text and a.format != "table":
        print(text, file=sys.stderr)
    return done.exit_code()


if __name__ == "__main__":
    sys.exit(main())
