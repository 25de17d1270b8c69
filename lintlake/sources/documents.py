"""One text document from many tasks: tasks write sorted pieces, the commit puts them together.

A document is a layout: literal texts, and sections whose items are rows. Rows are dealt into ranges of the order and
sorted; each task writes its items of a section into a file of its own, already joined, and the commit, which runs once
on the driver after all tasks are done, copies the files of a section one after the other, between what opens and closes
it. Only file names reach the driver; contents pass through in blocks. Files of failed attempts are never named.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lintlake.sources.tree import file_system

NAME = "text_document"
_BLOCK = 4 << 20


@dataclass
class Pieces(WriterCommitMessage):
    """(section, partition, file) of what a task wrote."""

    files: list[tuple[int, int, str]]


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, folder: str, layout: list) -> None:
        self.path, self.folder, self.layout = path, folder, layout

    def write(self, iterator: Iterator[Row]) -> Pieces:
        fs, folder = file_system(self.folder)
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get()
        files: list[tuple[int, int, str]] = []
        out, section = None, None
        margins = {x["section"]: x["margin"] + "  " for x in self.layout if not isinstance(x, str)}
        try:
            for row in iterator:
                margin = margins[row[0]]
                text = margin + json.dumps(json.loads(row[1]), indent=2, ensure_ascii=False).replace("\n", "\n" + margin)
                if row[0] != section:
                    if out:
                        out.close()
                    section = row[0]
                    name = posixpath.join(folder, f"{section}-{task.partitionId()}-{task.taskAttemptId()}")
                    files.append((section, task.partitionId(), name))
                    out = fs.open_output_stream(name)
                else:
                    text = ",\n" + text
                out.write(text.encode("utf-8", "surrogatepass"))
        finally:
            if out:
                out.close()
        return Pieces(files)

    def commit(self, messages: list[Pieces | None]) -> None:
        fs, path = file_system(self.path)
        files = sorted(f for m in messages if m for f in m.files)
        part = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            for x in self.layout:
                if isinstance(x, str):
                    out.write(x.encode())
                    continue
                own = [name for section, _, name in files if section == x["section"]]
                out.write(b"[\n" if own else b"[]")
                for k, name in enumerate(own):
                    out.write(b",\n" if k else b"")
                    with fs.open_input_stream(name) as piece:
                        while block := piece.read(_BLOCK):
                            out.write(block)
                out.write(f"\n{x['margin']}]".encode() if own else b"")
        fs.move(part, path)
        self._clean()

    def abort(self, messages: list[Pieces | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, folder = file_system(self.folder)
        if fs.get_file_info(folder).type == FileType.Directory:  # no task had rows, else
            fs.delete_dir(folder)


class DocumentSink(DataSource):
    """df.write.format("text_document").save(path) of (section, value) rows, with a layout (JSON) as an option."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DocumentWriter:  # noqa: ANN001
        path = self.options["path"]
        return DocumentWriter(path, f"{path}.pieces-{uuid.uuid4().hex}", json.loads(self.options["layout"]))


def section(number: int, margin: str) -> dict:
    """A list of items in a layout, written as JSON with an indent of 2 writes it; the margin is that of its last line."""
    return {"section": number, "margin": margin}


def write_document(rows: DataFrame, order: list[Column | str], layout: list, path: str) -> None:
    """Write (section, value) rows, whose values are JSON objects, in order of their section and `order`, as one document."""
    rows.sparkSession.dataSource.register(DocumentSink)
    keys = [F.col("section"), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.col("section").cast("int").alias("section"), "value")
    dealt.write.format(NAME).mode("append").option("layout", json.dumps(layout)).save(path)
