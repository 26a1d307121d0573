"""Names and Arrow helpers; staged tables are those of the library."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.names import spare
from lakeloom.sources.shared import stage, unstage

__all__ = ["LOWER", "bucket_of", "slices", "spare", "stage", "unstage", "utf8"]

#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(range(256)).lower()
#: Rows, and bytes unless one row has more, that a Python worker handles at a time.
SLICE, SLICE_BYTES = 256, 4 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows and bytes, so that long texts don't pile up."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            left = [batch.slice(start, rows)]
            while left:
                part = left.pop()
                if part.num_rows > 1 and part.nbytes > most:
                    half = part.num_rows // 2
                    left += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


def utf8(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def bucket_of(id_col: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as empty."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % buckets
