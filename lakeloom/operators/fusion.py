"""Fusing and diversifying ranked lists, and judging them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(lists: list[DataFrame], k: int = 60, *, id_col: str = "id", rank_col: str = "rank") -> DataFrame:
    """``(id, score)`` by reciprocal rank fusion (Cormack et al., 2009): the sum of 1 / (k + rank)."""
    whole = reduce(DataFrame.unionByName, [x.select(F.col(id_col).alias("id"), F.col(rank_col).alias("rank")) for x in lists])
    return whole.groupBy("id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def mmr(candidates: DataFrame, n: int = 5, weight: float = 0.5) -> DataFrame:
    """``(query, id, rank)`` by maximal marginal relevance (Carbonell and Goldstein, 1998).

    ``candidates`` has query, id, sim (to the query) and v (the vector), a
    top-k list for each query, so a group is bounded. Each step takes the
    candidate with the highest weight * sim - (1 - weight) * its greatest
    cosine to those taken; ties by id. A step depends on all before it, which
    no aggregation expresses, so a query is a pandas group.
    """

    def pick(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id", ignore_index=True)
        v = np.array(x["v"].tolist(), np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        sim, near, taken = x["sim"].to_numpy(), np.full(len(x), -np.inf), []
        for _ in range(min(n, len(x))):
            score = weight * sim - (1 - weight) * np.where(np.isinf(near), 0, near)
            score[taken] = -np.inf
            taken.append(int(score.argmax()))
            near = np.maximum(near, v @ v[taken[-1]])
        return pd.DataFrame({"query": x["query"].iloc[taken].to_numpy(), "id": x["id"].iloc[taken].to_numpy(), "rank": np.arange(1, len(taken) + 1)})

    return candidates.groupBy("query").applyInPandas(pick, "query long, id long, rank int")


def retrieval_metrics(ranked: DataFrame, judged: DataFrame, k: int = 10, relevant: DataFrame | None = None) -> DataFrame:
    """``(query, hit, rr, ndcg)`` at k for each judged query.

    ``ranked`` has query, id and rank; ``judged`` query, id and grade (0: not
    relevant). A query without a retrieved relevant id scores 0; one without
    any relevant id has a null ndcg. Where grades are 0 or 1 and too many ids
    are relevant to list them, ``relevant`` (query, n) says how many there
    are; ``judged`` then needs the retrieved ids only.
    """
    counts, relevant = relevant, judged.where("grade > 0")
    ideal_rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "id"))
    gain = lambda rank: (F.pow(F.lit(2.0), "grade") - 1) / F.log2(rank + 1)
    ideal = relevant.withColumn("r", ideal_rank).where(F.col("r") <= k).groupBy("query").agg(F.sum(gain(F.col("r"))).alias("ideal"))
    if counts is not None:
        best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k))), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
        ideal = counts.where("n > 0").select("query", best.alias("ideal"))
    found = ranked.where(F.col("rank") <= k).join(relevant, ["query", "id"]).groupBy("query").agg(F.min("rank").alias("first"), F.sum(gain(F.col("rank"))).alias("dcg"))
    out = judged.select("query").distinct().join(found, "query", "left").join(ideal, "query", "left")
    return out.select("query", F.col("first").isNotNull().cast("int").alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.when(F.col("ideal").isNotNull(), F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0))).alias("ndcg"))
