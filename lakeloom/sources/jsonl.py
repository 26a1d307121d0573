"""A source and sink in Python: JSON lines in a folder that driver and executors mount."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Bytes of a file that one task reads.
RANGE = 8 << 20


class _Range(InputPartition):
    """The lines of a file that begin from ``start`` on and before ``end``."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.names, self.path = schema.fieldNames(), path

    def partitions(self) -> list[InputPartition]:
        files = sorted(f"{self.path}/{x}" for x in os.listdir(self.path) if x.endswith(".jsonl") and not x.startswith("."))
        return [_Range(f, a, a + RANGE) for f in files for a in range(0, os.path.getsize(f), RANGE)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            if partition.start:  # a line that began before belongs to the range before
                f.seek(partition.start - 1)
                f.readline()
            while f.tell() < partition.end and (line := f.readline()):
                row = json.loads(line)
                yield tuple(row.get(name) for name in self.names)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    """Tasks write hidden files; only a job that succeeds makes them visible."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator[Row]) -> _Written:
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.jsonl"
        with open(f"{self.path}/.{name}", "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r.asDict(recursive=True), ensure_ascii=False) + "\n" for r in rows)
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        before = [x for x in os.listdir(self.path) if x.endswith(".jsonl") and not x.startswith(".")] if self.overwrite else []
        for m in filter(None, messages):
            os.rename(f"{self.path}/.{m.name}", f"{self.path}/{m.name}")
        for x in before:
            os.remove(f"{self.path}/{x}")

    def abort(self, messages: list[_Written | None]) -> None:
        for m in filter(None, messages):
            os.remove(f"{self.path}/.{m.name}")


class JsonLinesSource(DataSource):
    """Format ``lakeloom_jsonl`` with the option ``path``.

    Reading needs a schema of strings, whole numbers, doubles, booleans, or
    arrays and structs of these; a field that a line lacks is null, one that
    the schema lacks is passed over. Large files are read in ranges of
    ``RANGE`` bytes. Appending and overwriting are atomic for readers that
    list the folder after the job.
    """

    @classmethod
    def name(cls) -> str:
        return "lakeloom_jsonl"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)
