"""The numbers behind the usual plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.joins import fits
from lakeloom.sources.shared import stage

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
#: Pieces that a group's values are cut into each round, and distinct values of a group that are left when rounds end.
PIECES, FEW = 64, 2048
#: Groups whose pivots may be broadcast, a few hundred bytes each.
MAX_GROUPS = 10_000


def _same(*names: str) -> Column:
    """Equality of columns with their namesakes that end in an underscore, nulls alike."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"{n}_"))
    return out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df, MAX_GROUPS) else df


def _narrowed(rows: DataFrame, ranks: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows (v, c times each) near enough to the ranks wanted, counted by value, and the ranks among these.

    Pivots cut each group into pieces, pieces are counted, and those between
    a rank's neighbours are kept: ``rows`` has ``by``, v and c, ``ranks`` g,
    j, low and high, and so have the results, by g and j.
    """
    cuts = F.array(*[F.lit(k / PIECES) for k in range(1, PIECES)])
    pivots = stage(rows.groupBy(*by).agg(F.percentile_approx("v", cuts, 10_000).alias("pivots")).select(*[F.col(n).alias(f"{n}_") for n in by], "pivots"), "pivots")
    placed = rows.join(_small(pivots), _same(*by)).select(*by, "v", "c", F.size(F.filter("pivots", lambda p: p < F.col("v"))).alias("piece"))
    counts = stage(placed.groupBy(*by, "piece").agg(F.sum("c").alias("m")), "pieces")
    # At most PIECES rows of a group meet in this window.
    upto = F.sum("m").over(Window.partitionBy(*by).orderBy("piece"))
    spans = counts.select(*[F.col(n).alias(f"{n}_") for n in by], "piece", (upto - F.col("m")).alias("before"), upto.alias("upto"))
    hit = ranks.join(spans, _same(*by)).where((F.col("before") <= F.col("high")) & (F.col("upto") > F.col("low")))
    chosen = stage(hit.groupBy("g", "j").agg(F.min("piece").alias("first"), F.max("piece").alias("last"), F.min("before").alias("skipped"), F.first("low").alias("low"), F.first("high").alias("high")), "chosen")
    ranks = chosen.select("g", "j", (F.col("low") - F.col("skipped")).alias("low"), (F.col("high") - F.col("skipped")).alias("high"))
    wanted = chosen.select(F.col("g").alias("g_"), F.col("j").alias("j_"), "first", "last")
    kept = placed.join(_small(wanted), _same(*by) & F.col("piece").between(F.col("first"), F.col("last")))
    return stage(kept.select("g", F.col("j_").alias("j"), "v", "c").groupBy("g", "j", "v").agg(F.sum("c").alias("c")), "kept"), ranks


def quantiles(df: DataFrame, by: str, col: str, shares: list[float]) -> DataFrame:
    """``(g, j, value)``: the exact quantile ``shares[j]`` of ``col`` in each group, interpolated between neighbours.

    They are selected by refinement. In a round approximate pivots cut each
    group's values into ``PIECES``, which are counted; only the values of the
    pieces around a rank stay. Pivots and counts are partial aggregates, so a
    group with most of the rows is spread over all tasks, and what is left
    shrinks by a power of ``PIECES``. When no group has more than ``FEW``
    distinct values left, a running sum over these picks the neighbours. The
    driver sees one number a round. Nulls count nowhere; a null group is a
    group; NaN is the greatest value, as in Spark.
    """
    own = df.select(F.col(by).alias("g"), F.col(col).cast("double").alias("v"), F.lit(1).cast("long").alias("c")).where("v is not null")
    sizes = own.groupBy("g").agg(F.sum("c").alias("n"))
    at = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("j") + 1) * (F.col("n") - 1)
    asked = stage(sizes.select("g", "n", F.explode(F.array(*[F.lit(j) for j in range(len(shares))])).alias("j")).select("g", "j", F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("share")), "ranks")
    rows, ranks = _narrowed(own, asked.drop("share"), ["g"])
    while (rows.groupBy("g", "j").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > FEW:
        rows, ranks = _narrowed(rows, ranks, ["g", "j"])
    upto = F.sum("c").over(Window.partitionBy("g", "j").orderBy("v"))
    spans = rows.select(F.col("g").alias("g_"), F.col("j").alias("j_"), "v", (upto - F.col("c")).alias("before"), upto.alias("upto"))
    holds = lambda rank: F.max(F.when((F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("upto")), F.col("v")))
    found = ranks.join(spans, _same("g", "j")).groupBy("g", "j").agg(holds("low").alias("below"), holds("high").alias("above"))
    found = found.select(F.col("g").alias("g_"), F.col("j").alias("j_"), "below", "above")
    return asked.join(found, _same("g", "j")).select("g", "j", F.when(F.col("share") == 0, F.col("below")).otherwise(F.col("below") + (F.col("above") - F.col("below")) * F.col("share")).alias("value"))


def describe(df: DataFrame, by: str, col: str) -> DataFrame:
    """Count, mean, deviation, exact quartiles and extremes of ``col`` for each ``by``.

    Quartiles are ``quantiles``. Null values count nowhere; a null ``by`` is
    a group.
    """
    own = df.select(F.col(by).alias("g"), F.col(col).alias("v"))
    whole = own.groupBy("g").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.round(F.min("v"), 6).alias("min"), F.round(F.max("v"), 6).alias("max"))
    picked = [F.round(F.max(F.when(F.col("j") == j, F.col("value"))), 6).alias(name) for j, name in enumerate(QUARTILES)]
    found = quantiles(df, by, col, list(QUARTILES.values())).groupBy(F.col("g").alias("g_")).agg(*picked)
    return whole.join(found, _same("g"), "left").select(F.col("g").alias(by), "n", "mean", "std", "min", *QUARTILES, "max")


def histogram(df: DataFrame, value: Column, width: float) -> DataFrame:
    """``(bin, n)``: rows in each interval of ``width``; nulls have no bin."""
    return df.select(F.floor(value / width).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
