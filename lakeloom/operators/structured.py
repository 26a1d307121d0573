"""Structured output, prompts, conversation windows and injected clients."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parse_structured(df: DataFrame, col: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``parsed``, and the rows whose ``col`` isn't JSON of that schema.

    A null payload is among the latter. Fields that are missing are null.
    """
    shape = StructType.fromDDL(schema)
    full = schema + ", `__bad` string"
    own = df.withColumn("parsed", F.from_json(F.col(col), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    good = F.col("parsed").isNotNull() & F.col("parsed.__bad").isNull()
    kept = F.struct(*[F.col(f"parsed.{f.name}").alias(f.name) for f in shape])
    return own.where(good).withColumn("parsed", kept), own.where(~F.coalesce(good, F.lit(False))).drop("parsed")


def prompt_render(template: str, **columns: Column) -> Column:
    """``template`` with each ``{name}`` replaced by a column; nulls are empty."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min((rest.find("{" + n + "}") for n in columns if "{" + n + "}" in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        parts += [F.lit(rest[:at]), F.coalesce(columns[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def history_window(turns: DataFrame, n: int = 3, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``turns`` with ``history``: the last ``n`` turns up to and with each, oldest first."""
    own = Window.partitionBy(conv_col).orderBy(turn_col).rowsBetween(1 - n, Window.currentRow)
    return turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(own))


def with_client(df: DataFrame, col: str, make: Callable[[], Callable[[list[Any]], list[Any]]], name: str, kind: str) -> DataFrame:
    """``df`` with what an injected client returns for ``col``, batch by batch.

    ``make`` builds the client once a task (an embedding model, a completion
    service); it gets a list of values and returns a list of as many. A
    column ``name`` is replaced, ``col`` itself too if it has that name.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for x in frames:
            made = client(x[col].tolist())
            yield x.drop(columns=name, errors="ignore").assign(**{name: made})

    return df.mapInPandas(run, df.drop(name).withColumn(name, F.lit(None).cast(kind)).schema)
