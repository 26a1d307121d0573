"""A table on disk in hash buckets, of which an upsert rewrites those it changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.vectors import upsert
from lakeloom.sources.shared import stage, unstage


@dataclass(frozen=True)
class StoredTable:
    """Rows by id in folders ``bucket=n``, so that a change opens and rewrites its own bucket alone."""

    spark: SparkSession
    folder: str
    schema: str
    id_col: str
    buckets: int

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.id_col), F.lit(self.buckets)).cast("int")

    def _whole(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.folder)

    def _write(self, rows: DataFrame, mode: str) -> None:
        # A bucket with most of the rows is split over several tasks and files.
        dealt = rows.hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode(mode).parquet(self.folder)

    def rows(self) -> DataFrame:
        """The table as it is."""
        return self._whole().drop("bucket")

    def upsert(self, changes: DataFrame, *, order_col: str = "version") -> int:
        """Applies changes as ``vectors.upsert`` does; how many buckets it rewrote.

        Only buckets that a change falls into are read, and of these only
        those whose rows differ afterwards are replaced, by one dynamic
        overwrite: files of all others keep their names, a second run of the
        same changes writes nothing, and a run that fails before its commit
        leaves the table as it was. A bucket that loses all its rows keeps an
        empty file.
        """
        touched = [r[0] for r in changes.select(self._bucket().alias("b")).distinct().collect()]  # at most the number of buckets
        if not touched:
            return 0
        before = self._whole().where(F.col("bucket").isin(touched))
        after = stage(upsert(before.drop("bucket"), changes, id_col=self.id_col, order_col=order_col).withColumn("bucket", self._bucket()), "upserted")
        mark = lambda df, n, s: df.groupBy("bucket").agg(F.count("*").alias(n), F.sum(F.xxhash64(*self.rows().columns).cast("decimal(38,0)")).alias(s))
        both = mark(before, "n0", "s0").join(mark(after, "n1", "s1"), "bucket", "full")
        same = F.col("n0").eqNullSafe(F.col("n1")) & F.col("s0").eqNullSafe(F.col("s1"))
        changed = both.where(~same).select("bucket", "n1").collect()
        if full := [r.bucket for r in changed if r.n1 is not None]:
            self._write(after.where(F.col("bucket").isin(full)), "overwrite")
        for bucket in [r.bucket for r in changed if r.n1 is None]:
            none = self.spark.createDataFrame([], self.schema)
            none.write.mode("overwrite").parquet(f"{self.folder}/bucket={bucket}")
        unstage(after)
        return len(changed)


def create(rows: DataFrame, folder: str, *, id_col: str = "vec_id", buckets: int = 64) -> StoredTable:
    """``rows``, which have each id once, written to a new folder; ``buckets`` doesn't change afterwards."""
    out = StoredTable(rows.sparkSession, folder, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), id_col, buckets)
    out._write(rows.withColumn("bucket", out._bucket()), "errorifexists")
    return out
