"""Fixtures that mark the lines that are to be found: nothing else is."""

from lintlake.plans.review import Options, review
from lintlake.sources import corpus as C
from lintlake.sources.units import whole_files

from .brute.patches import parse_patch


def test_marked_lines_and_no_others(spark):
    rows = [(f"J{k}.java", t) for k, t in enumerate(C.JAVA_VARIANTS)] + [(f"X{k}.xml", t) for k, t in enumerate(C.XML_VARIANTS)]
    r = review(whole_files(spark.createDataFrame(rows, "path string, content string")), options=Options(experimental=True))
    got = {(x.file, x.line, x.rule, x.severity, x.message) for x in r.findings.collect()}
    want = {(f"J{v}.java", *x) for v, *x in C.expected(C.JAVA_VARIANTS)} | {(f"X{v}.xml", *x) for v, *x in C.expected(C.XML_VARIANTS)}
    assert got == want and {x[2] for x in want} == {f"SPR00{k}" for k in range(1, 7)} | {f"MYB00{k}" for k in range(1, 6)}


def test_kinds_of_patches():
    for text, path, old, status, hunks, unsupported, added in C.PATCH_KINDS:
        (f,) = parse_patch(text)
        assert (f.path, f.old_path, f.status, f.hunks, f.unsupported, sum(k == "added" for k, _ in f.lines.values())) == (path, old, status, hunks, unsupported, added)
