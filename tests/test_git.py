"""git as a source: streams, many blobs by one process, contents in parts."""

import subprocess

import pytest

from lintlake import api
from lintlake.sources import git as G

from .test_review import run_git

NAMES = ["a.xml", "with blank.java", "sub/é.java", "line\nbreak.xml", "empty.xml", "bin.xml", "very/deep/x.java"]
BODIES = [b"one\n", b"two\r\nthree", "é\n".encode(), b"odd name", b"", b"\xff\x00\n\n", b"x" * 3_000_000]


@pytest.fixture
def repo(tmp_path):
    run_git(tmp_path, "init", "-q")
    for name, body in zip(NAMES, BODIES, strict=True):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    run_git(tmp_path, "add", ".")
    run_git(tmp_path, "commit", "-qm", "x")
    for name in NAMES:
        (tmp_path / name).write_bytes(b"later")
    return str(tmp_path)


def test_blobs_come_from_one_process(repo, monkeypatch):
    calls = []
    real = subprocess.Popen
    monkeypatch.setattr(subprocess, "Popen", lambda *a, **k: calls.append(a[0]) or real(*a, **k))
    asked = ["missing.xml", *NAMES, "no\nsuch\nfile", "sub", NAMES[0]]
    got = list(G.blobs("HEAD", asked, repo))
    assert got == [("missing.xml", None), *zip(NAMES, BODIES, strict=True), ("no\nsuch\nfile", None), ("sub", None), (NAMES[0], BODIES[0])]
    assert len(calls) == 1
    many = list(G.blobs("HEAD", [NAMES[0], "none"] * 5000, repo))  # far more than pipes hold
    assert many == [(NAMES[0], BODIES[0]), ("none", None)] * 5000 and len(calls) == 2
    assert list(G.blobs("HEAD", [], repo)) == []
    with pytest.raises(G.GitError):
        list(G.blobs("HEAD", ["a"], "/"))  # no repository


def test_streams_tell_of_failures(repo):
    assert b"".join(G.stream(["show", f"HEAD:{NAMES[-1]}"], repo)) == BODIES[-1]
    with pytest.raises(G.GitError):
        list(G.stream(["show", "HEAD:nothing"], repo))
    assert G.git(["show", "HEAD:nothing"], repo) is None
    with pytest.raises(OSError):
        list(G.diff_chunks(G.DiffSource("range", "no-such..HEAD"), repo))


def test_contents_in_parts(spark):
    rows = [(f"p{k}", "x" * 100) for k in range(50)]
    for most in (1 << 20, 999):
        df = api.contents(spark, iter(rows), "path string, content string", most)
        assert sorted(map(tuple, df.collect())) == sorted(rows)
    assert api.contents(spark, iter([]), "path string, content string").count() == 0


def test_versions(repo):
    got = {p: (body, source) for p, body, source in api._versions([*NAMES[:2], "gone.xml"], "HEAD", repo)}
    assert got == {NAMES[0]: ("one\n", "head"), NAMES[1]: ("two\r\nthree", "head")}
    assert {source for _, _, source in api._versions(NAMES, None, repo)} == {"worktree"}
