"""Tools over standard input and output: JSON-RPC 2.0, one message a line; one batch review for each call."""

from __future__ import annotations

import json
import sys
from typing import Any

from pyspark.sql import SparkSession

from lintlake import api, config, reports
from lintlake.plans.catalogue import RULES
from lintlake.sources import git as G

_OPTIONS = {"cwd": {"type": "string"}, "minSeverity": {"enum": ["error", "warn", "info"]}, "experimental": {"type": "boolean"}}
TOOLS = {
    "review_diff": {"description": "Review a unified diff, or a git range (needs cwd).", "properties": {"patch": {"type": "string"}, "range": {"type": "string"}, **_OPTIONS}},
    "review_file": {"description": "Review whole files (needs cwd).", "properties": {"paths": {"type": "array"}, **_OPTIONS}},
    "list_rules": {"description": "The rules.", "properties": {}},
}


def call(spark: SparkSession, name: str, args: dict[str, Any]) -> str:
    """The text that a tool returns; ValueError for wrong arguments."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name}")
    if extra := set(args) - set(TOOLS[name]["properties"]):
        raise ValueError(f"unknown arguments: {', '.join(sorted(extra))}")
    if name == "list_rules":
        return json.dumps([{"id": r.id, "title": r.title, "severity": r.severity, "appliesTo": r.target, "experimental": r.experimental} for r in RULES], indent=1)
    cwd = args.get("cwd")
    loaded = config.load(cwd, None, G.root_of(cwd)) if cwd else config.Loaded({})
    if loaded.error:
        raise ValueError(loaded.error)
    options = config.merge(loaded.config, args.get("minSeverity"), experimental=args.get("experimental"))
    if name == "review_file":
        if not cwd or not args.get("paths"):
            raise ValueError("review_file needs cwd and paths")
        r = api.review_paths(spark, args["paths"], cwd, options)
    elif args.get("patch") is not None:
        r = api.review_diff(spark, G.DiffSource("patch", args["patch"]), cwd or "/nonexistent", options)
    elif args.get("range") and cwd:
        r = api.review_diff(spark, G.DiffSource("range", args["range"]), cwd, options)
    else:
        raise ValueError("review_diff needs a patch, or a range and cwd")
    out = reports.render_json(reports.Collected.of(r), indent=1)
    return out


def answer(spark: SparkSession, message: dict[str, Any]) -> dict[str, Any] | None:
    """The reply to one message, None for notifications."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": reports.TOOL, "version": "0"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": k, "description": v["description"], "inputSchema": {"type": "object", "properties": v["properties"], "additionalProperties": False}} for k, v in TOOLS.items()]}}
    if method == "tools/call":
        try:
            text, wrong = call(spark, params.get("name", ""), params.get("arguments") or {}), False
        except ValueError as e:
            text, wrong = str(e), True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": wrong}}
    return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def serve(spark: SparkSession) -> None:
    for line in sys.stdin:
        if line.strip() and (out := answer(spark, json.loads(line))) is not None:
            print(json.dumps(out, ensure_ascii=False), flush=True)
