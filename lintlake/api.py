"""Reviews of paths, patches and git diffs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.paths import BUILD_DIRS, glob_regex
from lintlake.plans.review import Options, Review, review
from lintlake.session import cut, shared_folder
from lintlake.sources import diff as D
from lintlake.sources import git as G
from lintlake.sources import units as U
from lintlake.sources.tree import read_tree

#: Characters that a table of the driver's rows holds before they go to the shared folder.
CHUNK = 32 << 20
_CONTENT = "path string, content string, content_source string"
_SKIP = "stage int, seq bigint, path string, reason string"


def expand(paths: list[str], cwd: str, exclude: tuple[str, ...] = ()) -> tuple[list[str], list[tuple[str, str]]]:
    """Files, folders and globs as a sorted list of reviewable files, and the inputs that gave none."""
    base, files, skipped = Path(cwd), set(), []
    inside = re.compile(rf"(?:^|/)(?:{BUILD_DIRS}|\.git)(?:/|$)", re.I)
    good = re.compile(r"\.(?:java|xml)\Z", re.I)
    built = re.compile(rf"[\\/](?:{BUILD_DIRS})[\\/]", re.I)

    def walk(top: str) -> list[str]:
        out = []
        for d, dirs, names in (base / top).walk() if (base / top).is_dir() else []:
            rel = d.relative_to(base).as_posix()
            dirs[:] = [x for x in dirs if not inside.search(x if rel == "." else f"{rel}/{x}")]
            out += [n if rel == "." else f"{rel}/{n}" for n in names if good.search(n)]
        return [p for p in out if not built.search(p)]

    for raw in paths:
        rel = re.sub(r"/+\Z", "", re.sub(r"\A\./", "", raw.replace("\\", "/")))
        if rel in ("", "."):
            files.update(walk("."))
        elif re.search(r"[*?\[]", rel):
            fixed = rel[: re.search(r"[*?\[]", rel).start()]
            rx = re.compile(glob_regex(rel).replace(r"\z", r"\Z"))
            hit = [p for p in walk(fixed.rpartition("/")[0] or ".") if rx.match(p)]
            files.update(hit)
            skipped += [] if hit else [(raw, "no .java/.xml file matched this pattern")]
        elif (base / rel).is_dir():
            hit = walk(rel)
            files.update(hit)
            skipped += [] if hit else [(raw, "no .java/.xml file under this directory")]
        elif not (base / rel).is_file():
            skipped.append((raw, "not readable"))
        elif not good.search(rel) or built.search(rel):
            skipped.append((raw, "not a .java/.xml file"))
        else:
            files.add(rel)
    shut = [re.compile(glob_regex(g).replace(r"\z", r"\Z")) for g in exclude]
    return sorted(p for p in files if not any(rx.match(p) for rx in shut)), skipped


def contents(spark: SparkSession, rows: Iterable[tuple], schema: str, most: int = CHUNK) -> DataFrame:
    """Rows that the driver reads, as a table: what is beyond `most` characters goes to the shared folder, part by part."""
    folder, held, size = None, [], 0

    def flush() -> None:
        nonlocal folder, size
        folder = folder or f"{shared_folder(spark)}/contents-{uuid.uuid4().hex}"
        spark.createDataFrame(held, schema).coalesce(1).write.mode("append").parquet(folder)
        held.clear()
        size = 0

    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if size > most:
            flush()
    if folder is None:
        return spark.createDataFrame(held, schema)
    if held:
        flush()
    return spark.read.schema(schema).parquet(folder)


def _java_of(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(ord, path, content) of the Java files that may be companions of mappers among the files: those named like the last part of a namespace."""
    found = F.explode(F.regexp_extract_all("content", F.lit(r"""namespace\s*=\s*["']\s*([\w.$]+)"""), F.lit(1)))
    names = files.filter(F.lower("path").endswith(".xml")).select(found.alias("ns"))
    wanted = names.select(F.concat(F.substring_index("ns", ".", -1), F.lit(".java")).alias("name"))
    tracked = spark.createDataFrame([(k, p) for k, p in enumerate(G.tracked_java(root))], "ord int, path string")
    named = tracked.withColumn("name", F.substring_index("path", "/", -1)).join(wanted.distinct(), "name", "left_semi").orderBy("ord")
    rows = ((r.ord, r.path, G.in_tree(r.path, root)) for r in named.select("ord", "path").toLocalIterator())
    return contents(spark, (r for r in rows if r[2] is not None), "ord int, path string, content string")


def review_paths(spark: SparkSession, paths: list[str], cwd: str, options: Options = Options()) -> Review:
    files, left = expand(paths, cwd, options.exclude)
    rows = ((k, p, G.in_tree(p, cwd)) for k, p in enumerate(files))
    own = contents(spark, (r for r in rows if r[2] is not None), "ord bigint, path string, content string")
    skipped = spark.createDataFrame([(1, k, p, r) for k, (p, r) in enumerate(left)], _SKIP)
    return review(U.whole_files(own), None, _java_of(spark, cwd, own), options, skipped)


def review_tree(spark: SparkSession, root: str, options: Options = Options()) -> Review:
    """All files below a folder, read by executors; mappers find their interfaces among them."""
    files = read_tree(spark, root, options.exclude)
    java = files.filter(F.lower("path").endswith(".java")).select(F.lit(0).alias("ord"), "path", "content")
    return review(U.whole_files(files), None, java, options)


def _versions(names: Iterable[str], ref: str | None, root: str) -> Iterator[tuple[str, str, str]]:
    """(path, content, content_source): at the ref where there is one that has the file, else as it lies in the work tree."""
    at_ref = G.blobs(ref, names, root) if ref else ((p, None) for p in names)
    for p, blob in at_ref:
        body = blob.decode("utf-8", "replace") if blob is not None else G.in_tree(p, root)
        if body is not None:
            yield p, body, "head" if blob is not None else "worktree"


def review_diff(spark: SparkSession, source: G.DiffSource, cwd: str, options: Options = Options()) -> Review:
    """A diff of any size: rules see whole files, findings are kept on added lines."""
    try:
        patch = D.put_file(spark, G.diff_chunks(source, cwd))
    except OSError as e:
        raise ValueError("the diff could not be read") from e
    root = G.root_of(cwd) or cwd
    files, lines = (x.drop("patch_id") for x in D.read_patch_file(spark, patch))
    files = cut(files)
    names = (r.path for r in files.filter("status != 'deleted'").select("path").distinct().toLocalIterator())
    at_hand = contents(spark, _versions(names, source.after(), root), _CONTENT)
    if source.kind == "worktree":
        new = (p for p in G.untracked_files(root) if p.lower().endswith((".java", ".xml")))
        own = contents(spark, _versions(new, None, root), _CONTENT)
        more, more_lines = D.untracked(own.select("path", "content"), 1 + (files.agg(F.max("file_ord")).first()[0] or 0))
        files, lines, at_hand = files.unionByName(more), lines.unionByName(more_lines), at_hand.unionByName(own)
    units, added, skipped = U.from_diff(files, lines, at_hand, options.exclude)
    return review(cut(units), cut(added), _java_of(spark, root, at_hand), options, cut(skipped))
