"""One file made by many tasks: a sink of pieces of text.

Rows (piece) come in the order of the document.  Each task writes the pieces of its partition to a file
beside the target; the commit joins them in order, under the head and before the end, and puts the
result in place with one rename.  A task that runs again writes a file of its own, and only those that
succeeded are joined.  A job that fails leaves no target; a task that still runs then may leave its part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

COPY_BYTES = 4 << 20


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str | None


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.target, self.folder = options["target"], f"{options['target']}.parts-{uuid.uuid4().hex}"
        self.head, self.between, self.end = (options[k][1:] for k in ("head", "between", "end"))

    def write(self, iterator: Iterator) -> Part:
        context = TaskContext.get()
        first = next(iterator, None)
        if first is None:
            return Part(context.partitionId(), None)
        name = f"{context.partitionId():08}-{context.taskAttemptId()}"
        system, folder = _system(self.folder)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}") as out:
            out.write(first[0].encode())
            for row in iterator:
                out.write((self.between + row[0]).encode())
        return Part(context.partitionId(), name)

    def commit(self, messages: list[Part]) -> None:
        system, folder = _system(self.folder)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/whole") as out:
            out.write(self.head.encode())
            before = b""
            for part in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.partition):
                out.write(before)
                with system.open_input_stream(f"{folder}/{part.name}") as data:
                    while chunk := data.read(COPY_BYTES):
                        out.write(chunk)
                before = self.between.encode()
            out.write(self.end.encode())
        system.move(f"{folder}/whole", _system(self.target)[1])
        system.delete_dir(folder)

    def abort(self, messages: list[Part]) -> None:
        from pyarrow import fs

        system, folder = _system(self.folder)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class DocumentSink(DataSource):
    """Options: target, a URI; head, between and end, each after one mark, so that white space is kept."""

    @classmethod
    def name(cls) -> str:
        return "sift_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write_document(rows: DataFrame, path: str, head: str, between: str, end: str) -> None:
    """Write rows (piece) as one file at a path or URI that all tasks and the driver see."""
    import os

    spark = rows.sparkSession
    spark.dataSource.register(DocumentSink)
    target = path if "://" in path else "file://" + os.path.abspath(path)
    rows.write.format("sift_document").mode("append").options(target=target, head="." + head, between="." + between, end="." + end).save()
