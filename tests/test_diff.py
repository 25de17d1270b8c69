import random

import pytest

from lintlake.sources import diff as D
from lintlake.sources.corpus import PATCH_KINDS
from lintlake.sources.diff import git_paths, side, unquote

from .brute.patches import parse_patch

PATCH = """diff --git a/src/A.java b/src/A.java
index 1..2 100644
--- a/src/A.java
+++ b/src/A.java
@@ -1,3 +1,4 @@
 one
--- removed looks like a header
+two
+three
 four
@@ -10 +11,2 @@ class
 ten
+eleven
\\ No newline at end of file
"""


def lines(f, kind):
    return {n: t for n, (k, t) in f.lines.items() if k == kind}


def test_two_hunks():
    (f,) = parse_patch(PATCH.replace("\n", "\r\n"))
    assert (f.path, f.status, f.hunks, f.unsupported) == ("src/A.java", "modified", 2, None)
    assert lines(f, "added") == {2: "two", 3: "three", 12: "eleven"}
    assert lines(f, "context") == {1: "one", 4: "four", 11: "ten"}


def test_new_deleted_renamed_binary_combined():
    new, gone, moved, binary, merged = (
        parse_patch("diff --git a/n.xml b/n.xml\nnew file mode 100644\n--- /dev/null\n+++ b/n.xml\n@@ -0,0 +1 @@\n+x\n")[0],
        parse_patch("diff --git a/g.xml b/g.xml\ndeleted file mode 100644\n--- a/g.xml\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n")[0],
        parse_patch("diff --git a/o.xml b/m.xml\nsimilarity index 90%\nrename from o.xml\nrename to m.xml\n")[0],
        parse_patch("diff --git a/b.bin b/b.bin\nBinary files a/b.bin and b/b.bin differ\n")[0],
        parse_patch("diff --cc c.xml\n--- a/c.xml\n+++ b/c.xml\n")[0],
    )
    assert (new.status, lines(new, "added")) == ("added", {1: "x"})
    assert gone.status == "deleted" and not gone.lines
    assert (moved.path, moved.old_path, moved.status) == ("m.xml", "o.xml", "renamed")
    assert binary.unsupported == "binary file"
    assert merged.unsupported == "combined merge diff is not supported" and merged.path == "c.xml"


def test_without_git_header_and_blank_context():
    (f,) = parse_patch("--- a/x y.java\t2020-01-01\n+++ b/x y.java\t2020-01-01\n@@ -1,2 +1,3 @@\n a\n\n+c\n")
    assert f.path == "x y.java" and lines(f, "context") == {1: "a", 2: ""} and lines(f, "added") == {3: "c"}


def test_overrun_is_unsupported():
    (f,) = parse_patch("--- a/x.java\n+++ b/x.java\n@@ -1,1 +1,2 @@\n a\n b\n c\n")
    assert f.unsupported == "hunk line counts do not match"


@pytest.mark.parametrize(("raw", "path"), [('"a/\\303\\251.java"', "a/é.java"), ("plain", "plain"), ('"t\\tq\\""', 't\tq"')])
def test_unquote(raw, path):
    assert unquote(raw) == path


def test_paths():
    assert git_paths("a/x y.java b/x y.java") == ("x y.java", "x y.java")
    assert git_paths("a/p.java b/q.java") == ("p.java", "q.java")
    assert side("/dev/null") == "" and side("b/p.java\t1") == "p.java"


def files_of(text):
    """What the one-place reading tells of a patch: files and their lines, as rows."""
    found = parse_patch(text)
    files = [(k, f.path, f.old_path, f.status, f.hunks, f.unsupported) for k, f in enumerate(found)]
    return files, sorted((k, f.path, kind, n, t) for k, f in enumerate(found) for n, (kind, t) in f.lines.items())


def rows_of(files, lines):
    return sorted((r.file_ord, r.path, r.old_path, r.status, r.hunks, r.unsupported) for r in files.collect()), sorted((r.file_ord, r.path, r.kind, r.new_line, r.text) for r in lines.collect())


ODD = ["--- a/x", "+++ b/x", "@@ -1,3 +1,4 @@ f", "@@ -5 +6,0 @@", "@@ -0,0 +1,2 @@", "@@ bad", "diff --git a/p.java b/p.java", "diff --cc q.xml", "+", "-", " ", "", "x", "xy", "\\ No newline", "+one", "-two", " three", "--- removed", "+++ added", "rename to r.java", "new file mode 100644", "Binary files differ", 'diff --git "a/\\303\\251.java" "b/\\303\\251.java"', "@@ -10,2 +99999999999999999999 @@"]


def patches():
    rng = random.Random(4)
    made = ["\n".join(rng.choices(ODD, k=rng.randint(1, 60))) + rng.choice(["", "\n", "\r\n"]) for _ in range(150)]
    return [PATCH, PATCH.replace("\n", "\r\n"), PATCH.replace("\n", "\r"), "", *[p[0] for p in PATCH_KINDS], *made]


def test_tables_of_patches_against_one_place(spark):
    texts = patches()
    files, lines = D.read_patches(spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(len(texts), None)], "patch_id long, text string"))
    got_files, got_lines = {}, {}
    for r in files.collect():
        got_files.setdefault(r.patch_id, []).append((r.file_ord, r.path, r.old_path, r.status, r.hunks, r.unsupported))
    for r in lines.collect():
        got_lines.setdefault(r.patch_id, []).append((r.file_ord, r.path, r.kind, r.new_line, r.text))
    for k, t in enumerate(texts):
        if "999999999" in t:
            continue  # line numbers beyond an int
        assert (sorted(got_files.get(k, [])), sorted(got_lines.get(k, []))) == files_of(t), t


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_a_file_in_ranges_against_one_place(spark, tmp_path, size):
    """Ranges end inside hunks, headers, runs of CR LF and characters of several bytes; hunks run over many of them."""
    long = "".join(f"+é {k}\n" for k in range(40))
    texts = [*[t for t in patches()[:30] if "999999999" not in t], PATCH + f"diff --git a/n.xml b/n.xml\nnew file mode 100644\n--- /dev/null\n+++ b/n.xml\n@@ -0,0 +1,40 @@\n{long}--- not a side\n" + PATCH, "@@ -1,2 +1,3 @@\n a\n+b"]
    text = "\n".join(t.rstrip("\r\n") for t in texts) + "\n"
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        for k, t in enumerate([text, PATCH, PATCH.rstrip("\n"), texts[-1], texts[-1] + "\n", ""] if size < 1000 else [text]):
            (tmp_path / f"{k}.diff").write_bytes(t.encode())
            lines = D.lines_of_file(spark, str(tmp_path / f"{k}.diff"))
            assert k or lines.select("stretch").distinct().count() > len(text.encode()) / size / 4
            assert rows_of(*D.read_patch_file(spark, str(tmp_path / f"{k}.diff"))) == files_of(t)
    finally:
        spark.conf.set(name, before)


def test_files_outside_version_control(spark):
    own = spark.createDataFrame([("b.xml", "x\ny\n"), ("a.xml", "one"), ("c.xml", "")], "path string, content string")
    files, lines = D.untracked(own, 5)
    assert sorted((r.file_ord, r.path, r.status) for r in files.collect()) == [(5, "a.xml", "added"), (6, "b.xml", "added"), (7, "c.xml", "added")]
    assert sorted((r.file_ord, r.new_line, r.text) for r in lines.collect()) == [(5, 1, "one"), (6, 1, "x"), (6, 2, "y")]
