"""Units: one row for each file to review, from files, from diffs, and their companions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions import text as X

#: First reasons win; deleted files go without a reason.
SKIP_ORDER = ("unsupported", "no added lines", "not a .java/.xml file", "excluded")
#: Least share of context lines that must agree with the file on disk.
CONTEXT_SHARE = 0.5


def whole_files(files: DataFrame) -> DataFrame:
    """Units of whole files: every line can be reported. Files are in the order of `ord` where they have one, else in that of a hash."""
    number = F.col("ord").cast("bigint") if "ord" in files.columns else F.pmod(F.xxhash64("path"), F.lit(1 << 52))
    rows = files.select(number.alias("unit_ord"), "path", X.normalize_newlines(F.col("content")).alias("content"))
    return rows.select("unit_ord", "path", P.lang_of(F.col("path")).alias("lang"), "content", F.lit("worktree").alias("content_source"), F.lit(True).alias("complete"), F.lit(True).alias("whole_file"))


def reconstruct(lines: DataFrame) -> DataFrame:
    """(file_ord, content, contiguous): files as far as the diff shows them, holes as empty lines."""
    own = lines.groupBy("file_ord", "new_line").agg(F.max(F.struct((F.col("kind") == "added").alias("a"), "text")).alias("t"))
    rows = own.groupBy("file_ord").agg(F.map_from_entries(F.collect_list(F.struct("new_line", "t.text"))).alias("m"), F.max("new_line").alias("last"), F.min("new_line").alias("first"), F.count("*").alias("n"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), "last"), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(""))), "\n")
    return rows.select("file_ord", F.concat(text, F.lit("\n")).alias("content"), ((F.col("first") == 1) & (F.col("n") == F.col("last"))).alias("contiguous"))


def context_share(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_ord, share): how many of the context lines stand in the file at hand; null without any."""
    context = lines.filter("kind = 'context'")
    have = files.select("file_ord", F.posexplode(X.lines_of(F.col("content"))).alias("k", "actual")).select("file_ord", (F.col("k") + 1).alias("new_line"), "actual")
    same = F.coalesce(X.trim(F.col("actual")) == X.trim(F.col("text")), F.lit(False))
    return context.join(have, ["file_ord", "new_line"], "left").groupBy("file_ord").agg(F.avg(same.cast("int")).alias("share"))


def skip_reasons(files: DataFrame, lines: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files of a diff with `reason`; null where they are to be reviewed. Deleted ones are gone."""
    added = lines.filter("kind = 'added'").select("file_ord").distinct().withColumn("has_added", F.lit(True))
    path = F.coalesce(F.when(F.col("path") != "", F.col("path")), F.col("old_path"))
    rows = files.withColumn("path", path).filter("coalesce(path, '') != '' and status != 'deleted'").join(added, "file_ord", "left")
    reason = F.when(F.col("unsupported").isNotNull(), F.col("unsupported")).when(F.col("has_added").isNull(), SKIP_ORDER[1]).when(~P.reviewable(F.col("path")), SKIP_ORDER[2]).when(P.matches_any(F.col("path"), list(exclude)), SKIP_ORDER[3])
    return rows.withColumn("reason", reason).drop("has_added")


def from_diff(files: DataFrame, lines: DataFrame, contents: DataFrame, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, added lines, skipped) of a parsed diff.

    contents: (path, content, content_source) of what could be read, at the ref or in the working tree. A file whose
    context does not fit what was read is reviewed as the patch shows it, and so is one that could not be read.
    """
    judged = skip_reasons(files, lines, exclude)
    todo = judged.filter("reason is null").select("file_ord", "path", "unsupported")
    have = todo.join(contents.withColumn("content", X.normalize_newlines(F.col("content"))), "path", "left")
    share = context_share(lines.join(todo.select("file_ord"), "file_ord", "left_semi"), have.filter("content is not null"))
    built = reconstruct(lines).withColumnsRenamed({"content": "built"})
    rows = have.join(share, "file_ord", "left").join(built, "file_ord", "left")
    stale = F.col("content").isNotNull() & (F.coalesce("share", F.lit(1.0)) < CONTEXT_SHARE)
    rows = rows.withColumn("stale", stale).withColumn("read", F.col("content").isNotNull() & ~F.col("stale"))
    units = rows.select(
        F.col("file_ord").cast("bigint").alias("unit_ord"), "path", P.lang_of(F.col("path")).alias("lang"), F.when(F.col("read"), F.col("content")).otherwise(F.coalesce("built", F.lit(""))).alias("content"),
        F.when(F.col("read"), F.col("content_source")).otherwise("patch").alias("content_source"), F.when(F.col("read"), True).when(F.col("stale"), False).otherwise(F.coalesce("contiguous", F.lit(True)) & F.col("unsupported").isNull()).alias("complete"), F.lit(False).alias("whole_file"),
    )
    added = lines.filter("kind = 'added'").join(todo.select("file_ord", F.col("path").alias("p")), "file_ord").select(F.col("p").alias("path"), F.col("file_ord").cast("bigint").alias("unit_ord"), F.col("new_line").alias("line"))
    left = judged.filter("reason is not null").select("file_ord", "path", "reason").unionByName(rows.filter("stale").select("file_ord", "path", F.lit("patch context does not match the file on disk, so the patch's own lines were reviewed").alias("reason")))
    return units, added, left.select(F.lit(1).alias("stage"), F.col("file_ord").cast("bigint").alias("seq"), "path", "reason")


def namespace_index(java_paths: DataFrame) -> DataFrame:
    """(ns_key, companion_path): of several files under a key the first."""
    keys = java_paths.select("ord", "path", F.posexplode(P.namespace_keys(F.col("path"))).alias("k", "ns_key"))
    w = Window.partitionBy("ns_key").orderBy("ord", "k")
    return keys.withColumn("n", F.row_number().over(w)).filter("n = 1").select("ns_key", F.col("path").alias("companion_path"))


def companions_of(namespaces: DataFrame, java: DataFrame) -> DataFrame:
    """(path, companion_path, companion_content): the interface that each mapper's namespace names."""
    named = namespaces.filter("namespace is not null").select("path", P.namespace_path(F.col("namespace")).alias("ns_key"))
    found = named.join(namespace_index(java.select("ord", "path")), "ns_key")
    return found.join(java.select(F.col("path").alias("companion_path"), X.normalize_newlines(F.col("content")).alias("companion_content")), "companion_path").select("path", "companion_path", "companion_content")
