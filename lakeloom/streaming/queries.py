"""Structured Streaming over the events table, run to the end of its input."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from lakeloom.sources.shared import is_file, scratch


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of ``path`` as a stream; ``ts`` becomes a TIMESTAMP, which watermarks need."""
    folder, _, name = path.rpartition("/")
    own = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = own.option("pathGlobFilter", name).parquet(folder) if is_file(spark, path) else own.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """A query that starts within it keeps its state in RocksDB, as stateful processors need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def drain(stream: DataFrame, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """All that the stream gives until its input ends, as a table.

    Batches are written as Parquet to the shared folder, in complete and
    update mode each to a folder of its own, so that a batch that is run
    again replaces itself. In complete mode the last batch is the table. In
    update mode a batch has the rows that changed, so of all rows with the
    same ``keys`` those of the latest batch count.
    """
    spark = stream.sparkSession
    root = scratch(spark, "stream")
    if mode == "append":
        with _state_in_rocksdb(spark):
            query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of its rows")
    spark.createDataFrame([], stream.schema).write.parquet(f"{root}/out/epoch=-1")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    with _state_in_rocksdb(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    whole = spark.read.schema(StructType([*stream.schema, StructField("epoch", LongType())])).parquet(f"{root}/out")
    if mode == "complete":
        last = whole.agg(F.max("epoch")).first()[0]
        return whole.where(F.col("epoch") == F.lit(-1 if last is None else last)).drop("epoch")
    latest = whole.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "epoch").alias("row"))
    return latest.select("row.*")


def tumbling(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Count and value of each type in each window."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, late: str = "1 hour", width: str = "1 day", slide: str = "12 hours") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "2 hours") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One event of each id, repeats within the watermark dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def joined(left: DataFrame, right: DataFrame, late: str = "1 hour", apart: str = "interval 30 minutes") -> DataFrame:
    """Pairs of a left and a right event of a user, the right one up to ``apart`` later."""
    a = left.withWatermark("ts", late).select(F.col("user_id"), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = right.withWatermark("ts", late).select(F.col("user_id").alias("__u"), F.col("event_id").alias("second_id"), F.col("ts").alias("second_ts"))
    return a.join(b, F.expr(f"user_id = __u and second_ts > first_ts and second_ts <= first_ts + {apart}")).drop("__u")


def joined_outer(left: DataFrame, right: DataFrame, late: str = "1 hour", apart: str = "interval 30 minutes", how: str = "left_outer") -> DataFrame:
    """``joined``, and events that found none on the other side (of the left, the right or either, by ``how``).

    An event without a partner is given out when the watermark, which follows
    the slower side, has passed the last time at which one could have come;
    its state goes then, as does that of events that found theirs.
    """
    a = left.withWatermark("ts", late).select(F.col("user_id").alias("first_user"), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = right.withWatermark("ts", late).select(F.col("user_id").alias("second_user"), F.col("event_id").alias("second_id"), F.col("ts").alias("second_ts"))
    return a.join(b, F.expr(f"first_user = second_user and second_ts > first_ts and second_ts <= first_ts + {apart}"), how)


class RunningTotals(StatefulProcessor):
    """Number and sum of a user's events so far, one value of state for each user."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long, value double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, value = self.total.get() if self.total.exists() else (0, 0.0)
        for x in rows:
            n, value = n + len(x), value + float(x["value"].sum())
        self.total.update((n, value))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "value": [value]})

    def close(self) -> None:
        pass


class IdleUsers(StatefulProcessor):
    """The last event of each user who then was silent for ``gap`` of event time.

    Every later event puts the user's timer off; when the watermark passes
    it, the user is reported and forgotten.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, n = self.last.get() if self.last.exists() else (-1, 0)
        last = before
        for x in rows:
            last, n = max(last, int(x["ms"].max())), n + len(x)
        if last > before:
            if before >= 0:
                self.handle.deleteTimer(before + self.gap_ms)
            self.handle.registerTimer(last + self.gap_ms)
        self.last.update((last, n))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, n = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"user_id": [key[0]], "ms": [last], "n": [n]})

    def close(self) -> None:
        pass


class Funnel(StatefulProcessor):
    """Steps that a user takes in order, each within a time of the first.

    Events wait in a list until the watermark passes them, so that they are
    taken in order of time however they came. A map holds, for each number of
    steps taken, when the latest such attempt began and with which event. An
    attempt that runs out of time is removed by a timer of its own: state
    with a time to live would go by the clock of the machine, and results
    would depend on when a batch runs.
    """

    def __init__(self, steps: tuple[str, ...], within_ms: int):
        self.steps, self.within = steps, within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, event_id long, step int")
        self.begun = handle.getMapState("begun", "steps int", "ms long, event_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for x in rows:
            own = [(int(ms), int(e), self.steps.index(kind)) for ms, e, kind in zip(x["ms"], x["event_id"], x["event_type"], strict=True) if kind in self.steps]
            if own:
                self.waiting.appendList(own)
                for ms in {ms for ms, _, _ in own}:
                    self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in waiting if x[0] <= passed]
        if due:
            self.waiting.put(waiting[len(due) :]) if len(due) < len(waiting) else self.waiting.clear()
        done = []
        for ms, event, step in due:
            if step == 0:
                self.begun.updateValue((1,), (ms, event))
                self.handle.registerTimer(ms + self.within + 1)
            elif self.begun.containsKey((step,)) and ms - (first := self.begun.getValue((step,)))[0] <= self.within:
                self.begun.removeKey((step,))
                if step + 1 == len(self.steps):
                    done.append((key[0], first[1], event, ms - first[0]))
                elif not self.begun.containsKey((step + 1,)) or tuple(self.begun.getValue((step + 1,))) < tuple(first):
                    self.begun.updateValue((step + 1,), tuple(first))
        for steps, (ms, _) in [(k[0], tuple(v)) for k, v in self.begun.iterator()]:
            if passed > ms + self.within:
                self.begun.removeKey((steps,))
        if done:
            yield pd.DataFrame(done, columns=["user_id", "first_id", "last_id", "took_ms"])

    def close(self) -> None:
        pass


def funnels(events: DataFrame, steps: tuple[str, ...] = ("view", "click", "purchase"), within_hours: float = 24.0, late: str = "1 hour") -> DataFrame:
    """``(user_id, first_id, last_id, took_ms)``: users who took all steps in order within a time of the first.

    Of several attempts that have come equally far, the latest goes on; a
    step moves it on and a second one of the same kind needs an attempt of
    its own. Events of one time are taken by id. An attempt is given out when
    the watermark has passed its last step.
    """
    own = events.withWatermark("ts", late).select("user_id", "ts", F.unix_millis("ts").alias("ms"), "event_id", "event_type")
    return own.groupBy("user_id").transformWithStateInPandas(Funnel(steps, int(within_hours * 3_600_000)), "user_id long, first_id long, last_id long, took_ms long", "append", "eventTime")


def running_totals(events: DataFrame) -> DataFrame:
    """``(user_id, n, value)``: all events of a user so far, kept as state from batch to batch."""
    own = events.select("user_id", "value")
    return own.groupBy("user_id").transformWithStateInPandas(RunningTotals(), "user_id long, n long, value double", "update", "none")


def idle_users(events: DataFrame, late: str = "1 hour", gap_hours: float = 24.0) -> DataFrame:
    """``(user_id, last, n)``: users silent for ``gap_hours`` as far as the watermark tells, by event-time timers."""
    own = events.withWatermark("ts", late).select("user_id", "ts", F.unix_millis("ts").alias("ms"))
    out = own.groupBy("user_id").transformWithStateInPandas(IdleUsers(int(gap_hours * 3_600_000)), "user_id long, ms long, n long", "append", "eventTime")
    return out.select("user_id", F.timestamp_millis("ms").alias("last"), "n")
