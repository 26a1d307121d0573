"""Scratch folders where driver and executors see the same files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: For each ``cleared`` that is entered, the scratch folders made within it.
_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a temporary folder serves local mode, in which driver
    and executors are one process; on a cluster an unset folder is an error.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        path = tempfile.mkdtemp(prefix="lakeloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local[app] = "file://" + path
    return _local[app]


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    for made in _made:
        made.append(path)
    return path


@contextmanager
def cleared(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Scratch folders made within it are removed at its end, but for staged tables given to ``keep``, which it yields.

    What is read lazily from the others must have been written by then.
    """
    made: list[str] = []
    kept: set[str] = set()
    _made.append(made)
    try:
        yield lambda df: (kept.add(df._staged_at), df)[1]
    finally:
        _made[:] = [x for x in _made if x is not made]
        for path in made:
            if path not in kept:
                remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing will read again."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    It cuts the lineage: a lost executor later costs no more than rereading.
    The files go when the driver's JVM ends, or earlier by ``unstage``.
    """
    spark = df.sparkSession
    folder = scratch(spark, tag)
    df.write.parquet(f"{folder}/rows")
    out = spark.read.schema(df.schema).parquet(f"{folder}/rows")
    out._staged_at = folder
    return out


def unstage(df: DataFrame) -> None:
    """Removes a staged table that nothing will read again."""
    remove(df.sparkSession, df._staged_at)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is one file and no folder."""
    fs, at = _file_system(spark, path)
    return fs.getFileStatus(at).isFile()


def _file_system(spark: SparkSession, path: str):
    # PySpark has no public call that removes files of any file system.
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
