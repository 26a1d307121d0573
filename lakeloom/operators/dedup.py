"""Exact duplicates of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_of_each_text(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of all rows with the same text one, all its columns kept: that with the least id.

    Null ids come last; of rows that tie, the one whose columns hash least
    stays. A null text is a text of its own, as is an empty one. Texts are
    told apart by SHA-256. Tasks choose among their own rows before anything
    is exchanged, so a text in a third of the rows is a row for each task.
    """
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*docs.columns))
    digest = F.sha2(F.col(text_col).cast("string"), 256)
    return docs.groupBy(digest.alias("__digest")).agg(F.min_by(F.struct(*docs.columns), order).alias("__row")).select("__row.*")
