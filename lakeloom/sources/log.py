"""A source in Python: a folder of Parquet files as a log that is read with filters, or followed as a stream."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import DoubleType, FloatType, StructType

#: Rows of an Arrow batch that a task gives to Spark.
BATCH = 8192


def _found(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The file system of a path, and its Parquet files in order of their names."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    if fs.get_file_info(root).type == pafs.FileType.File:
        return fs, [root]
    own = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return fs, sorted(x.path for x in own if x.type == pafs.FileType.File and x.base_name.endswith(".parquet") and x.base_name[0] not in "._")


@dataclass
class _Group(InputPartition):
    """Rows ``start`` to ``stop`` of one row group of a file."""

    file: str
    group: int
    start: int = 0
    stop: int = 1 << 62


def _rows(path: str, part: _Group, schema: StructType, where: ds.Expression | None) -> Iterator[pa.RecordBatch]:
    fs, _ = _found(path)
    fragment = ds.ParquetFileFormat().make_fragment(part.file, fs, row_groups=[part.group])
    at = 0
    for batch in fragment.to_batches(columns=schema.fieldNames(), filter=where, batch_size=BATCH):
        a, b = max(part.start - at, 0), min(part.stop - at, batch.num_rows)
        at += batch.num_rows
        if b > a:
            yield batch.slice(a, b - a)


class _Reader(DataSourceReader):
    """Row groups that the filters leave, and of these the rows that satisfy them.

    Taken over are equality, membership, order, null tests and prefixes of
    single columns. Those that Arrow and Spark see differently, an order that
    NaN would satisfy, stay with Spark.
    """

    def __init__(self, schema: StructType, path: str):
        self.schema, self.path = schema, path
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        kinds = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", IsNull: "null", IsNotNull: "not null", StringStartsWith: "prefix"}
        for f in filters:
            value = getattr(f, "value", None)
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            known = type(f) in kinds and name in self.schema.fieldNames()
            if known and isinstance(self.schema[name].dataType, DoubleType | FloatType):
                known = type(f) not in (GreaterThan, GreaterThanOrEqual, In) and not (isinstance(value, float) and math.isnan(value))
            if known and (value is not None or type(f) in (IsNull, IsNotNull)) and not (type(f) is In and None in value):
                self.filters.append((name, kinds[type(f)], value))
            else:
                yield f

    def _where(self) -> ds.Expression | None:
        out = []
        for name, kind, value in self.filters:
            c = ds.field(name)
            if kind in ("null", "not null"):
                out.append(c.is_null() if kind == "null" else c.is_valid())
            elif kind == "prefix":
                import pyarrow.compute as pc

                out.append(pc.starts_with(c, value))
            else:
                out.append({"==": lambda: c == value, ">": lambda: c > value, ">=": lambda: c >= value, "<": lambda: c < value, "<=": lambda: c <= value, "in": lambda: c.isin(list(value))}[kind]())  # noqa: B023
        return reduce(lambda a, b: a & b, out) if out else None

    def partitions(self) -> list[InputPartition]:
        fs, files = _found(self.path)
        where, out = self._where(), []
        for f in files:
            fragment = ds.ParquetFileFormat().make_fragment(f, fs)
            groups = fragment.split_by_row_group(where) if where is not None else fragment.split_by_row_group()
            out += [_Group(f, g.row_groups[0].id) for g in groups]
        return out

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition, self.schema, self._where())


class _Stream(DataSourceStreamReader):
    """The log from a row on: an offset is the number of rows before it, files in order of their names."""

    def __init__(self, schema: StructType, path: str):
        self.schema, self.path = schema, path
        self.sizes: dict[str, list[int]] = {}

    def _groups(self) -> list[tuple[str, list[int]]]:
        fs, files = _found(self.path)
        for f in files:
            if f not in self.sizes:
                meta = pq.read_metadata(f, filesystem=fs)
                self.sizes[f] = [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
        return [(f, self.sizes[f]) for f in files]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rows": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"rows": sum(sum(s) for _, s in self._groups())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, at = [], 0
        for f, sizes in self._groups():
            for g, n in enumerate(sizes):
                a, b = max(start["rows"] - at, 0), min(end["rows"] - at, n)
                at += n
                if b > a:
                    out.append(_Group(f, g, a, b))
        return out

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        return _rows(self.path, partition, self.schema, None)


class LogSource(DataSource):
    """Format ``lakeloom_log`` with the option ``path``, and ``columns`` to read only some.

    A batch read takes filters over from Spark (where
    ``spark.sql.python.filterPushdown.enabled`` is set), skips row groups by
    their statistics and passes on Arrow batches of what is left. A stream
    gives each row once and goes on from its checkpoint; files must be added
    under names that come after the earlier ones and never change. Any file
    system that Arrow opens will do. A folder without files needs a schema.
    """

    @classmethod
    def name(cls) -> str:
        return "lakeloom_log"

    def schema(self) -> StructType:
        fs, files = _found(self.options["path"])
        whole = from_arrow_schema(pq.read_schema(files[0], filesystem=fs).remove_metadata())
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or whole.fieldNames()
        return StructType([whole[c] for c in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(schema, self.options["path"])
