"""Named queries over the test tables, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans import relational, retrieval, sources, streams

_MODULES = [retrieval, relational, sources, streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for m in _MODULES for name, q in m.QUERIES.items() if q.sql}
