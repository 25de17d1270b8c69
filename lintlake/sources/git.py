"""git on the driver: diffs, files at a ref, the root of a work tree. Executors never call it.

What git writes is passed on in chunks; nothing of a diff's or a tree's size is held.
"""

from __future__ import annotations

import re
import subprocess
import threading
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

#: Seconds that one call of git may take.
TIMEOUT = 600
_CHUNK = 1 << 20


class GitError(OSError):
    """git did not end in time, or with another status than 0."""


def stream(args: list[str], cwd: str) -> Iterator[bytes]:
    """Standard output in chunks, whatever its size; GitError at its end where the status is not 0."""
    with subprocess.Popen(["git", *args], cwd=cwd, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        timer = threading.Timer(TIMEOUT, run.kill)
        timer.start()
        try:
            yield from iter(lambda: run.stdout.read(_CHUNK), b"")
            status = run.wait()
        finally:
            timer.cancel()
            run.kill()
    if status:
        raise GitError(f"git {args[0]} was stopped" if status < 0 else f"git {args[0]} ended with status {status}")


def git(args: list[str], cwd: str) -> str | None:
    """Standard output of a call that answers little, or None where there is nothing to show (no git, or a status other than 0)."""
    try:
        return b"".join(stream(args, cwd)).decode("utf-8", "replace")
    except GitError as e:
        if "was stopped" in str(e):
            raise
        return None
    except OSError:
        return None


@dataclass(frozen=True)
class DiffSource:
    """kind: worktree, staged, range or patch; text: the range or the patch."""

    kind: str
    text: str = ""

    def after(self) -> str | None:
        """The ref at which contents are read: the right end of a range, HEAD where that is empty."""
        if self.kind != "range":
            return None
        left, dots, right = self.text.partition("...") if "..." in self.text else self.text.partition("..")
        return (right or "HEAD") if dots else None


def diff_chunks(source: DiffSource, cwd: str) -> Iterator[bytes]:
    """The bytes of a diff; OSError where git cannot tell."""
    if source.kind == "patch":
        yield source.text.encode("utf-8", "surrogateescape")
        return
    what = {"worktree": ["HEAD"], "staged": ["--cached"], "range": [source.text]}[source.kind]
    yield from stream(["diff", "--no-color", "--no-ext-diff", "-U3", *what], cwd)


def root_of(cwd: str) -> str | None:
    out = git(["rev-parse", "--show-toplevel"], cwd)
    return out.strip() if out else None


def untracked_files(cwd: str) -> list[str]:
    out = git(["ls-files", "--others", "--exclude-standard", "-z"], cwd)
    return [p for p in (out or "").split("\0") if p]


def tracked_java(cwd: str) -> list[str]:
    out = git(["ls-files", "-z", "--", "*.java"], cwd)
    return [p for p in (out or "").split("\0") if p]


_ANSWER = re.compile(rb"[0-9a-f]{40,64} (\w+) (\d+)\n")


def blobs(ref: str, paths: Iterable[str], cwd: str) -> Iterator[tuple[str, bytes | None]]:
    """Each path with its content at a ref, None where there is no file: one process for all of them.

    Names go to `cat-file --batch` ended by NUL, so they may hold blanks and line breaks, while answers, which state
    their length, are read one at a time.
    """
    names = list(paths)
    if not names:
        return
    with subprocess.Popen(["git", "cat-file", "--batch", "-z"], cwd=cwd, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:

        def ask() -> None:
            try:
                for name in names:
                    run.stdin.write(f"{ref}:{name}".encode("utf-8", "surrogateescape") + b"\0")
                run.stdin.close()
            except OSError:  # git has gone: the reader tells
                return

        threading.Thread(target=ask, daemon=True).start()
        try:
            for name in names:
                head = run.stdout.readline()
                if not head:
                    raise GitError("git cat-file ended early")
                if m := _ANSWER.fullmatch(head):
                    body = run.stdout.read(int(m[2]) + 1)[:-1]
                    yield name, body if m[1] == b"blob" else None
                    continue
                for _ in range(f"{ref}:{name}".count("\n")):  # the answer repeats the name
                    run.stdout.readline()
                yield name, None
        finally:
            run.kill()


def in_tree(path: str, root: str) -> str | None:
    try:
        return (Path(root) / path).read_text(encoding="utf-8", errors="replace")
    except OSError:
        return None
