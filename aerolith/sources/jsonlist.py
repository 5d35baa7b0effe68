"""Results as one JSON list, committed as a whole: a Spark data sink whose parts become one file, or nothing."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .flightlog import opened

#: Bytes that the commit copies at a time.
PIECE = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    task: int
    rows: int
    path: str


class JsonListWriter(DataSourceWriter):
    """Each task writes its rows, joined by commas, beside the target; the commit joins the parts and puts the list in place by one move.

    A result has a row for each target, so the list is short; the driver copies it piece by piece all the same. Until the move the old
    file stays; a failed job deletes its parts.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.pending = f"._pending-{uuid.uuid4().hex}"

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        system, target = opened(self.path)
        return system, target, posixpath.join(posixpath.dirname(target), self.pending)

    def write(self, rows: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        system, _, folder = self._folder()
        system.create_dir(folder, recursive=True)
        task = TaskContext.get().partitionId()
        path, n = posixpath.join(folder, f"{task}-{uuid.uuid4().hex}"), 0  # of this attempt alone
        with system.open_output_stream(path) as out:
            for row in rows:
                out.write(((",\n  " if n else "") + json.dumps(row.asDict(recursive=True), ensure_ascii=False)).encode())
                n += 1
        return Part(task, n, path)

    def commit(self, messages: list[Part | None]) -> None:
        system, target, folder = self._folder()
        system.create_dir(folder, recursive=True)
        whole = posixpath.join(folder, "list")
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.task)
        with system.open_output_stream(whole) as out:
            out.write(b"[")
            for k, part in enumerate(parts):
                out.write(b",\n  " if k else b"\n  ")
                with system.open_input_stream(part.path) as source:
                    while piece := source.read(PIECE):
                        out.write(piece)
            out.write(b"\n]\n" if parts else b"]\n")
        system.move(whole, target)
        system.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        system, _, folder = self._folder()
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class JsonList(DataSource):
    """``jsonlist``: one file with a list of objects, in the order of partitions."""

    @classmethod
    def name(cls) -> str:
        return "jsonlist"

    def writer(self, schema: StructType, overwrite: bool) -> JsonListWriter:
        return JsonListWriter(self.options["path"])
