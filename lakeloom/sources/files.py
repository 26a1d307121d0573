"""Sources and sinks that Spark has, with their settings in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Values keep their own white space.
_CSV = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
READERS = ("parquet", "orc", "csv", "json", "text")


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", **options: str) -> None:
    """``df`` as files of ``kind``; csv has a header, text needs one string column."""
    if kind not in READERS:
        raise ValueError(f"no sink {kind!r}")
    own = _CSV if kind == "csv" else {}
    df.write.mode(mode).format(kind).options(**own | options).save(path)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Files of ``kind``; csv and json need a schema, so that nothing is read to guess one."""
    if kind not in READERS:
        raise ValueError(f"no source {kind!r}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    own = _CSV if kind == "csv" else {}
    reader = spark.read.format(kind).options(**own | options)
    return (reader.schema(schema) if schema else reader).load(path)
