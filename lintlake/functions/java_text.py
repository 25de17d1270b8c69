"""Small parsers of Java argument text, shared by the structure extraction and its tests."""

from __future__ import annotations

import re

_OPEN, _CLOSE = "<([", ">)]"


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts between separators outside brackets, trimmed, empty ones dropped."""
    out, depth, start = [], 0, 0
    for k, ch in enumerate(text):
        if ch in _OPEN:
            depth += 1
        elif ch in _CLOSE:
            depth = max(0, depth - 1)
        elif ch == sep and depth == 0:
            out.append(text[start:k])
            start = k + 1
    out.append(text[start:])
    return [p for p in (x.strip() for x in out) if p]


def arity(args: str) -> int:
    """Arguments of a call by commas outside round and square brackets."""
    if not args.strip():
        return 0
    depth, n = 0, 1
    for ch in args:
        depth += (ch in "([") - (ch in ")]" and depth > 0)
        n += ch == "," and depth == 0
    return n


def naive_arity(args: str) -> int:
    """Non-empty parts between any commas."""
    return sum(1 for p in args.split(",") if p)


def clean_value(raw: str) -> str:
    """Without array braces, quotes at the ends and the qualifier of a constant."""
    s = raw.strip()
    if s.startswith("{") and s.endswith("}") and len(s) > 1:
        s = s[1:-1]
    s = re.sub(r'^"|"$', "", s)
    return re.sub(r"^[A-Za-z$.]*\.", "", s).strip()


def annotation_args(raw: str | None) -> dict[str, str]:
    """`key = value` pairs; a bare argument is `value`; the last of a key counts."""
    out: dict[str, str] = {}
    for part in split_top(raw or ""):
        key, eq, value = part.partition("=")
        out[key.strip() if eq else "value"] = clean_value(value if eq else part)
    return out
