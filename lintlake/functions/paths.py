"""Paths: languages, what can be reviewed, globs, companions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders of build output.
BUILD_DIRS = "target|build|out|node_modules|generated"


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: `**` with a following slash crosses folders, `*` and `?` do not."""
    parts = re.split(r"(\*\*/?|\*|\?)", glob)
    words = {"**": ".*", "**/": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(words.get(p) or re.sub(r"([^\w/ -])", r"\\\1", p) for p in parts if p) + r"\z"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs; false for none."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def lang_of(path: Column) -> Column:
    return F.when(path.rlike(r"(?i)\.java\z"), "java").when(path.rlike(r"(?i)\.xml\z"), "xml").otherwise("other")


def reviewable(path: Column) -> Column:
    """Java or XML, outside build output below some folder, not minified."""
    return (lang_of(path) != "other") & ~path.rlike(rf"(?i)[\\/](?:{BUILD_DIRS})[\\/]") & ~path.rlike(r"(?i)[\\/]\.min\.[a-z]+\z")


def pruned(path: Column) -> Column:
    """Inside a folder that a directory walk does not enter."""
    return path.rlike(rf"(?i)(?:^|/)(?:{BUILD_DIRS}|\.git)/")


def namespace_path(namespace: Column) -> Column:
    """The source file that a namespace names."""
    return F.concat(F.replace(F.btrim(namespace), F.lit("."), F.lit("/")), F.lit(".java"))


def namespace_keys(path: Column) -> Column:
    """The keys under which a Java file can be found: after the last /java/, and after src/main/java or src/test/java."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    last = F.regexp_replace(p, r"^[\s\S]*/java/", "")
    alt = F.regexp_replace(p, r"^.*?src/(?:main|test)/java/", "")
    return F.array_distinct(F.array(last, F.when(alt != p, alt).otherwise(last)))
