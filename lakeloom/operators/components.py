"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.shared import stage, unstage


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (u, v), v < u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    return small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node on an edge; root is the smallest node.

    ``edges`` has long columns u and v. Each round is a few joins and
    aggregations of edges and is written to the shared folder; nothing is
    gathered on the driver but a row count and a checksum. The number of
    rounds grows with the logarithm of the longest chain. Self-loops, nulls
    and repeated edges are ignored.
    """
    own = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stage(own, "edges")
    mark = _mark(now)
    while mark[0]:
        new = stage(_stars(now), "edges")
        unstage(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
