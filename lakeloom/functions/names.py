"""Column names that are still free."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(df: DataFrame, name: str) -> str:
    """``name``, or it with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
