"""BM25 ranking (Robertson and Zaragoza, 2009)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import tokens
from lakeloom.sources.shared import stage


def _frequency(toks: Column, term: str) -> Column:
    return F.size(F.filter(toks, lambda x: x == F.lit(term))).cast("double")


def bm25(docs: DataFrame, terms: list[str], *, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every document that holds a query term.

    The inverse document frequency is ``ln(1 + (N - df + 0.5) / (df + 0.5))``,
    N counts documents with a token. Term counts are taken in each row by
    array functions and staged, a few numbers a row, as both the statistics
    and the scores need them: texts are read once, the only exchange is one
    row of statistics, and the corpus is never exploded into tokens. Null and empty texts have no token
    and don't appear; a repeated query term counts once; an id that repeats
    is scored row by row.
    """
    terms = sorted({t.lower() for t in terms})
    toks = docs.select(F.col(id_col).alias("__id"), tokens(F.col(text_col)).alias("__t")).where(F.size("__t") > 0)
    tf = stage(toks.select("__id", F.size("__t").cast("double").alias("__len"), F.array(*[_frequency(F.col("__t"), t) for t in terms]).alias("__f")), "frequencies")
    stats = tf.agg(
        F.count("*").cast("double").alias("__n"),
        F.avg("__len").alias("__avg"),
        F.array(*[F.sum((F.col("__f")[i] > 0).cast("double")) for i in range(len(terms))]).alias("__df"),
    )
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col("__f")[i], F.col("__df")[i]
        idf = F.log(1 + (F.col("__n") - d + 0.5) / (d + 0.5))
        score = score + idf * f * (k1 + 1) / (f + k1 * ((1 - b) + b * F.col("__len") / F.col("__avg")))
    hit = F.exists("__f", lambda x: x > 0)
    # One row of statistics: the broadcast's size is fixed.
    return tf.where(hit).crossJoin(F.broadcast(stats)).select(F.col("__id").alias(id_col), score.alias("score"))
