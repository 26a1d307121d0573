"""Equi-joins whose physical strategy follows a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side up to which it may be broadcast.
MAX_BROADCAST_ROWS = 100_000
STRATEGIES = ("auto", "broadcast", "merge", "shuffle_hash")
#: Joins that may hold the right side in memory as a whole.
_RIGHT_BUILT = ("inner", "left", "left_semi", "left_anti", "cross")


def fits(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; no more than one row above is counted."""
    return df.limit(rows + 1).count() <= rows


def equi_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", *, strategy: str = "auto", most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``left.join(right, on, how)`` by a stated strategy.

    ``broadcast`` is refused for a right side of more than ``most`` rows and
    for joins that keep unmatched right rows. ``merge`` sorts both sides, so
    it spills and adaptive execution may split a hot key. ``shuffle_hash``
    builds a table of each right partition, for a right side that is much
    smaller than the left but too large to send everywhere. ``auto`` takes
    the broadcast where it is allowed and leaves the rest to the optimizer.
    Null keys match nothing, as in SQL.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}")
    if strategy in ("auto", "broadcast"):
        allowed = how in _RIGHT_BUILT and fits(right, most)
        if strategy == "broadcast" and not allowed:
            raise ValueError(f"the right side may not be broadcast: more than {most} rows, or a {how} join")
        return left.join(F.broadcast(right) if allowed else right, on, how)
    return left.join(right.hint(strategy), on, how)
