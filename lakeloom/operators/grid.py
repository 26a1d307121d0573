"""Every row asked about against every row of a table, in cells of bounded size and without the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.joins import equi_join
from lakeloom.sources.shared import stage

#: Rows asked about that a cell holds, and rows that stream past them.
ASKED_BLOCK, ROW_BLOCK = 4096, 1 << 14
#: The same for cells whose pairs are all given back.
PAIRS_ASKED, PAIRS_ROWS = 256, 4096
#: Cells are dealt to at most so many tasks; a task takes its cells one after the other.
MAX_TASKS = 1 << 14


class Cell(Protocol):
    """What becomes of one cell: all that is asked comes first, then the rows in pieces, which may give results at once."""

    def ask(self, columns: list[pa.Array]) -> None: ...

    def feed(self, columns: list[pa.Array]) -> Iterator[pa.RecordBatch] | None: ...

    def end(self) -> pa.RecordBatch: ...


def _dealt(asked: DataFrame, rows: DataFrame, group: str, asked_block: int, row_block: int) -> tuple[DataFrame, DataFrame, int]:
    """Both sides by cell, ``(g, b, a, kind, task, x0 or x1)``, and the number of tasks."""
    many, few = rows.groupBy(group).agg(F.count("*").alias("__n")), asked.groupBy(group).agg(F.count("*").alias("__m"))
    blocks = lambda c, size: F.ceil(F.col(c) / F.lit(size)).cast("int")
    sizes = stage(many.join(few, group).withColumns({"__nb": blocks("__n", row_block), "__na": blocks("__m", asked_block)}), "sizes")
    cells = F.col("__nb").cast("long") * F.col("__na")
    total = sizes.agg(F.sum(cells), F.sum(F.col("__n").cast("double") * F.col("__m")), F.sum(F.col("__n") * F.col("__na") + F.col("__m") * F.col("__nb"))).first()
    # Small cells share a task; there are enough for the pairs, the rows and the cluster.
    enough = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((total[1] or 0) / (asked_block * row_block)) * 2, (total[2] or 0) // row_block)
    tasks = int(max(1, min(total[0] or 0, enough, MAX_TASKS)))
    sizes = sizes.drop("__n", "__m")

    def dealt(df: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        numbered = df.select(group, F.struct(*df.columns).alias("__x"), F.xxhash64(F.monotonically_increasing_id()).alias("__h"))
        met = equi_join(numbered, sizes, [group])
        mine, every = F.pmod("__h", F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        b, a = (mine, every) if kind else (every, mine)
        put = met.select(F.col(group).cast("long").alias("g"), b.alias("b"), a.alias("a"), F.col("__na"), F.lit(kind).alias("kind"), "__x")
        to = F.pmod(F.xxhash64("g") + F.col("b").cast("long") * F.col("__na") + F.col("a"), F.lit(tasks)).cast("int")
        return put.select("g", "b", "a", "kind", to.alias("task"), F.col("__x").alias(f"x{kind}"))

    return dealt(asked, "__na", "__nb", 0), dealt(rows, "__nb", "__na", 1), tasks


def in_cells(asked: DataFrame, rows: DataFrame, make: Callable[[], Cell], schema: str, *, group: str, asked_block: int | None = None, row_block: int | None = None) -> DataFrame:
    """What ``make()`` finds in each cell of the grid of ``asked`` and ``rows``.

    Only rows that agree in the long column ``group`` meet. In each group both
    sides are cut into blocks, by a hash of the rows' numbers, so that no value
    of the data decides where a row goes. A cell is a block of each side: the
    one asked about, ``asked_block`` rows or so, is held, the other streams
    past it, so a task's memory doesn't grow with the table. Both sides are
    exchanged once for each block of the other; nothing goes to the driver but
    the number of cells. Groups that one side lacks have no cells.
    """
    first, second, tasks = _dealt(asked, rows, group, asked_block or ASKED_BLOCK, row_block or ROW_BLOCK)
    laid = first.unionByName(second, allowMissingColumns=True).repartitionById(tasks, F.col("task"))
    return laid.sortWithinPartitions("g", "b", "a", "kind").select("g", "b", "a", "kind", "x0", "x1").mapInArrow(_run(make), schema)


def pairs(asked: DataFrame, rows: DataFrame, *, group: str) -> DataFrame:
    """``(x0, x1)``: every row asked about with every row of its group, as structs of their columns.

    For results that have a row for each pair anyway. The cells are those of
    ``in_cells``, but are joined by their numbers, so that expressions over
    pairs stay in the JVM.
    """
    first, second, _ = _dealt(asked, rows, group, PAIRS_ASKED, PAIRS_ROWS)
    cell = ["g", "b", "a"]
    return first.select(*cell, "x0").join(second.select(*cell, "x1").hint("merge"), cell).select("x0", "x1")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, list[pa.Array]]]:
    """(cell, kind, columns) wherever one of these changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [batch.column(k).to_numpy() for k in range(4)]
        cuts = np.flatnonzero(np.any([np.diff(m) != 0 for m in marks], axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            kind = int(marks[3][a])
            yield tuple(m[a] for m in marks[:3]), kind, batch.column(4 + kind).slice(a, b - a).flatten()


def _run(make: Callable[[], Cell]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, held = None, None, False
        for mark, kind, columns in _pieces(batches):
            if mark != now:
                if held:
                    yield cell.end()
                now, cell, held = mark, make(), False
            if kind == 0:
                cell.ask(columns)
                held = True
            elif held:
                yield from cell.feed(columns) or ()
        if held:
            yield cell.end()

    return run


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls and of one length as a matrix, not copied by row."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best(who: np.ndarray, score: np.ndarray, order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Indices of the first ``k`` of each ``who``, by descending score and then by ``order``; sorted by ``who`` and rank."""
    by = np.lexsort((*reversed(order), ~score if score.dtype.kind == "i" else -score, who))
    own = who[by]
    start = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
    place = np.arange(len(own)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(own) else np.zeros(0, np.int64)
    return by[place < k]
