"""Folders as a data source: the walk never enters build output, and files are dealt to tasks by their sizes."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lintlake.functions.paths import BUILD_DIRS, glob_regex

#: Bytes and files of a partition, and bytes of a batch.
PARTITION_BYTES, PARTITION_FILES, BATCH_BYTES = 64 << 20, 20_000, 8 << 20
NAME = "source_tree"
_SCHEMA = "ord bigint, path string, content string"
_CLOSED = re.compile(rf"(?i)\A(?:{BUILD_DIRS}|\.git)\Z")
_GOOD = re.compile(r"(?i)\.(?:java|xml)\Z")


def file_system(path: str) -> tuple[afs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"[A-Za-z][\w+.-]*:", path):
        return afs.FileSystem.from_uri(re.sub(r"\Afile:/*", "file:///", path))
    return afs.LocalFileSystem(), path


@dataclass
class Files(InputPartition):
    """Files of one task, each with its place in the order of all."""

    first: int
    paths: list[str]


class TreeReader(DataSourceReader):
    """Reads the reviewable files below a folder, in the order of their paths."""

    def __init__(self, root: str, exclude: list[str], partition_bytes: int) -> None:
        self.root, self.limit = root, partition_bytes
        self.shut = [glob_regex(g).replace(r"\z", r"\Z") for g in exclude]
        self.listed: list[str] = []

    def walk(self) -> Iterator[tuple[str, int]]:
        """(path below the root, size) in order; folders of build output are not listed."""
        fs, root = file_system(self.root)
        root = root.rstrip("/") or "/"
        shut = [re.compile(x) for x in self.shut]
        todo = [""]
        while todo:
            rel = todo.pop()
            self.listed.append(rel)
            found = fs.get_file_info(afs.FileSelector(posixpath.join(root, rel) if rel else root))
            folders = []
            for info in found:
                path = f"{rel}/{info.base_name}" if rel else info.base_name
                if info.type == afs.FileType.Directory:
                    if not _CLOSED.match(info.base_name):
                        folders.append(path)
                elif info.type == afs.FileType.File and _GOOD.search(path) and not any(x.match(path) for x in shut):
                    yield path, info.size
            todo += folders

    def partitions(self) -> list[Files]:
        """Runs of files in the order of their paths, each of about so many bytes; a larger file is alone or last in its run."""
        out, run, size, first = [], [], 0, 0
        for path, n in sorted(self.walk()):
            run.append(path)
            size += n
            if size >= self.limit or len(run) >= PARTITION_FILES:
                out.append(Files(first, run))
                first, run, size = first + len(run), [], 0
        return [*out, Files(first, run)] if run or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(self.root)
        rows, size = [], 0
        for k, path in enumerate(partition.paths, partition.first):
            try:
                with fs.open_input_stream(posixpath.join(root, path)) as f:
                    text = f.read().decode("utf-8", "replace")
            except FileNotFoundError:  # gone since the walk
                continue
            rows.append((k, path, text))
            size += len(text)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    o, p, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(p, pa.string()), pa.array(c, pa.string())], names=["ord", "path", "content"])


class TreeSource(DataSource):
    """spark.read.format("source_tree").load(root): (ord, path, content). Options: exclude (a JSON list of globs), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(self.options["path"], json.loads(self.options.get("exclude", "[]")), int(self.options.get("partitionBytes", PARTITION_BYTES)))


def read_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(ord, path, content) of the reviewable files below a folder that driver and executors can reach.

    ord numbers the files in the order of their paths. Names are settled before any content is read; a folder
    without such files gives no rows.
    """
    spark.dataSource.register(TreeSource)
    return spark.read.format(NAME).option("exclude", json.dumps(list(exclude))).option("partitionBytes", partition_bytes).load(root)
