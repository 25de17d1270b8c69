"""A patch read from top to bottom in one place: what the relational scan is held against."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from lintlake.sources.diff import git_paths, side, unquote


@dataclass
class File:
    path: str = ""
    old_path: str | None = None
    status: str = "unknown"
    hunks: int = 0
    unsupported: str | None = None
    lines: dict[int, tuple[str, str]] = field(default_factory=dict)  # number -> (kind, text)


#: What git writes before the hunks of a file, by how a line starts.
HEADERS = ("new file mode", "deleted file mode", "old mode", "similarity index", "rename from ", "rename to ", "copy from ", "copy to ", "Binary files", "--- ", "+++ ")
_RANGE = re.compile(r"@@+ -(?P<a>\d+)(?:,(?P<m>\d+))? \+(?P<b>\d+)(?:,(?P<n>\d+))? @@")


@dataclass
class Section:
    """The lines of a patch that tell of one file: the line that opens it (None before the first), facts, hunks."""

    opening: str | None
    facts: dict[str, str] = field(default_factory=dict)
    hunks: list[tuple[int, list[str]]] = field(default_factory=list)  # number of the first new line, lines with their marks
    overrun: bool = False

    def fact(self, *names: str) -> str | None:
        return next((self.facts[n] for n in names if n in self.facts), None)

    def status(self, moved: bool) -> str:
        if self.fact("rename from ", "rename to ", "copy from ", "copy to ") is not None:
            return "renamed"
        for name, status in (("deleted file mode", "deleted"), ("new file mode", "added"), ("similarity index", "renamed"), ("old mode", "renamed")):
            if name in self.facts:
                return status
        gone = [s is None or not s or "/dev/null" in s for s in (self.fact("--- "), self.fact("+++ "))]
        return "added" if gone[0] else "deleted" if gone[1] else "renamed" if moved else "modified"

    def file(self) -> File | None:
        """What the section tells; None where it names no file."""
        git = (self.opening or "").startswith("diff --git ")
        if self.opening is None and not self.hunks:
            return None
        names = (git_paths(self.opening[11:]) if git else None) or ("", None)
        minus, plus = self.fact("--- "), self.fact("+++ ")
        to, origin = (None if x is None else unquote(x) for x in (self.fact("rename to ", "copy to "), self.fact("rename from ", "copy from ")))
        path = side(plus) or to or names[1] or side(minus)
        if not path:
            return None
        old = origin or names[0] or (side(minus) if plus is not None and self.opening is not None else "") or None
        reason = "binary file" if "Binary files" in self.facts else "combined merge diff is not supported" if self.opening and not git else "hunk line counts do not match" if self.overrun else None
        f = File(path, old, self.status(bool(old) and old != path), len(self.hunks), reason)
        for number, body in self.hunks:
            shown = [("added" if x[:1] == "+" else "context", x if len(x) == 1 and x not in "+ " else x[1:]) for x in body if x[:1] != "-"]
            f.lines.update(enumerate(shown, number))
        return f


def hunk_body(lines: list[str], at: int, old: int, new: int) -> tuple[list[str], int, bool]:
    """The lines from `at` on that make up `old` and `new` lines, where they end, and whether they hold more than that.

    A hunk without new lines only takes lines away. A line of one odd character is context that lost its mark.
    """
    body: list[str] = []
    adds = new > 0
    while at < len(lines) and (old > 0 or new > 0):
        line = lines[at]
        mark = line[:1] or " "
        note = mark == "\\" or (not adds and line == "")
        if not note:
            if mark != "-" and not (adds and (mark in "+ " or len(line) == 1)):
                break
            body.append(line)
            old -= mark != "+"
            new -= mark != "-"
        at += 1
        if adds and min(old, new) < 0:
            return body, at, True
    return body, at, False


def sections(text: str) -> Iterator[Section]:
    """A patch cut where files begin. Lines of hunks never start like a file does, so only hunks need counting."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    now, at = Section(None), 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if line.startswith(("diff --git ", "diff --cc ")):
            yield now
            now = Section(line)
        elif m := _RANGE.match(line):
            a, n = (1 if m[k] is None else int(m[k]) for k in ("m", "n"))
            body, at, over = hunk_body(lines, at, a, n)
            now.hunks.append((int(m["b"]), body if n else []))
            now.overrun |= over
        else:
            for name in HEADERS:
                # before the first file of a bare patch stands prose, where only the two sides count
                if line.startswith(name) and (now.opening or now.hunks or name in ("--- ", "+++ ")):
                    now.facts[name] = line[len(name) :]
    yield now


def parse_patch(text: str) -> list[File]:
    return [f for s in sections(text) if (f := s.file())]
