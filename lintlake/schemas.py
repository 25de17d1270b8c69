"""Schemas of the tables that the review passes along, and the fixed sets that go with them."""

from __future__ import annotations

from pyspark.sql import types as T

UNITS = T.StructType.fromDDL("unit_ord bigint, path string, lang string, content string, content_source string, complete boolean, whole_file boolean") if hasattr(T.StructType, "fromDDL") else None
ADDED = "path string, line int"
DIFF_FILES = "file_ord int, path string, old_path string, status string, hunks int, unsupported string"
DIFF_LINES = "file_ord int, path string, kind string, new_line int, text string"
DRAFTS = "unit_ord bigint, rule_ord int, draft_seq array<int>, rule string, severity string, file string, line int, end_line int, message string, suggestion string"
SKIPPED = "stage int, seq bigint, path string, reason string"

# Severities and their ranks.
SEVERITY_RANK = {"error": 3, "warn": 2, "info": 1}
