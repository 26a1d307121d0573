"""As-of and range joins without nested loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.names import spare

#: Doublings of the width after which an interval is filed as one that reaches everywhere.
MAX_LEVEL = 40


def asof_join(left: DataFrame, right: DataFrame, *, by: str, ts: str, value: str, name: str, slot: Callable[[Column], Column] | None = None) -> DataFrame:
    """``left`` with the ``value`` of the latest ``right`` row of the same key at or before its time.

    Both sides are laid out in one sorted sequence of each key, in which the
    last right row seen so far is carried along: no pairs are made. ``slot``
    cuts time into slots (a function of the time that never decreases, such
    as the day): each key's sequence is then sorted slot by slot in tasks of
    their own, and what a slot inherits comes from a window over one summary
    row for each slot, so a key with a third of all rows is spread.

    Rows without a match have null, as have null keys or times, which are
    spread and meet no one. Of right rows with the same time, the greatest
    ``value`` counts.
    """
    when = slot or (lambda t: F.lit(0))
    mark = F.struct(F.col(ts).alias("ts"), F.col(value).alias("value"))
    events = right.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(by).alias("by"), when(F.col(ts)).alias("slot"), F.col(ts).alias("at"), F.lit(0).alias("side"), mark.alias("right"), F.lit(None).cast(left.schema.simpleString()).alias("left")
    )
    asked = left.select(F.col(by).alias("by"), when(F.col(ts)).alias("slot"), F.col(ts).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(events.schema["right"].dataType).alias("right"), F.struct(*left.columns).alias("left"))
    alone = F.when(F.col("by").isNull() | F.col("at").isNull(), F.xxhash64(F.monotonically_increasing_id()))
    whole = events.withColumn("alone", F.lit(None).cast("long")).unionByName(asked.withColumn("alone", alone))
    so_far = Window.partitionBy("by", "slot", "alone").orderBy("at", "side", F.col("right.value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = whole.withColumn("last", F.last("right", ignorenulls=True).over(so_far)).where("side = 1")
    if slot:
        before = Window.partitionBy("by").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        ends = whole.where("by is not null and slot is not null").groupBy("by", "slot").agg(F.max("right").alias("end"))
        inherited = ends.select(F.col("by").alias("key"), F.col("slot").alias("part"), F.last("end", ignorenulls=True).over(before).alias("before")).where("before is not null")
        found = found.join(inherited, (F.col("by") == F.col("key")) & (F.col("slot") == F.col("part")), "left").withColumn("last", F.coalesce("last", "before"))
    return found.select("left.*", F.when(F.col("by").isNotNull() & F.col("at").isNotNull(), F.col("last.value")).alias(name))


def range_join(points: DataFrame, intervals: DataFrame, *, at: Column, start: Column, end: Column, width: float) -> DataFrame:
    """Pairs of a point and an interval with start <= at < end.

    An interval is filed by buckets of ``width`` doubled as often as its
    length asks for, so it touches two buckets at most however long it is,
    and a point looks up one bucket of each level that some interval has. The
    work follows the pairs, and a good width is near the usual length. Null
    or NaN places and ends match nothing; an interval longer than ``width``
    doubled ``MAX_LEVEL`` times, or with an infinite end, is filed under one
    bucket that every point looks up.
    """
    both = points.join(intervals.limit(0), F.lit(False), "left")  # for names that neither side has
    own_level, own_bucket, level_, bucket_, levels_ = (spare(both, n) for n in ("own_level", "own_bucket", "level", "bucket", "levels"))
    span = (end - start) / F.lit(float(width))
    level = F.when(span <= 1, F.lit(0)).when(span <= 2.0**MAX_LEVEL, F.ceil(F.log2(span)).cast("int")).otherwise(F.lit(MAX_LEVEL + 1))
    bucket = lambda x, k: F.when(k > MAX_LEVEL, F.lit(0)).otherwise(F.floor(x / (F.lit(float(width)) * F.pow(F.lit(2.0), k)))).cast("long")
    filed = intervals.where((start < end) & ~F.isnan(start.cast("double")) & ~F.isnan(end.cast("double"))).withColumn(level_, level)
    filed = filed.withColumn(bucket_, F.explode(F.array_distinct(F.array(bucket(start, F.col(level_)), bucket(end, F.col(level_))))))
    # One row: the set of levels, MAX_LEVEL + 2 at most.
    levels = filed.agg(F.collect_set(level_).alias(levels_))
    own = points.where(at.isNotNull() & ~F.isnan(at.cast("double"))).crossJoin(F.broadcast(levels)).withColumn(own_level, F.explode(levels_)).withColumn(own_bucket, bucket(at, F.col(own_level))).drop(levels_)
    return own.join(filed, (F.col(own_level) == F.col(level_)) & (F.col(own_bucket) == F.col(bucket_)) & (at >= start) & (at < end)).drop(own_level, own_bucket, level_, bucket_)
