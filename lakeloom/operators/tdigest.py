"""A mergeable aggregate in Python: t-digests (Dunning and Ertl, 2019)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.shared import stage, unstage

#: Centroids of a digest, about; values that a task holds before it digests them; digests that are merged at a time.
SIZE, HELD, FAN_IN = 200, 1 << 17, 256
SCHEMA = "n long, low double, high double, means array<double>, weights array<double>"


def digest(values: np.ndarray, weights: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (mean, weight) of weighted values, by ascending mean.

    Values in order are cut where the scale function passes a whole number.
    It is steep at both ends, so the extremes keep centroids of their own and
    the middle gets heavier ones.
    """
    order = np.argsort(values, kind="stable")
    v, w = values[order], weights[order]
    upto = np.cumsum(w)
    middle = (upto - w / 2) / upto[-1]
    cluster = np.floor(size * (np.arcsin(2 * middle - 1) / np.pi + 0.5))
    first = np.flatnonzero(np.concatenate(([True], cluster[1:] != cluster[:-1])))
    total = np.add.reduceat(w, first)
    return np.add.reduceat(v * w, first) / total, total


def quantile(low: float, high: float, means: np.ndarray, weights: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Values at these shares of the weight, interpolated between the middles of centroids and the extremes."""
    upto = np.cumsum(weights)
    return np.interp(shares, np.concatenate(([0.0], (upto - weights / 2) / upto[-1], [1.0])), np.concatenate(([low], means, [high])))


class _Digests:
    """One digest for each group, of plain values or of digests, merged whenever many numbers are held."""

    def __init__(self, size: int):
        self.size, self.held = size, 0
        self.groups: dict[object, list] = {}

    def add(self, group: object, n: int, low: float, high: float, means: np.ndarray, weights: np.ndarray) -> None:
        own = self.groups.setdefault(group, [0, np.inf, -np.inf, [], []])
        own[:3] = own[0] + n, min(own[1], low), max(own[2], high)
        own[3].append(means)
        own[4].append(weights)
        self.held += len(means)
        if self.held > HELD:
            self.merge()

    def merge(self) -> None:
        for own in self.groups.values():
            if len(own[3]) > 1 or len(own[3][0]) > 2 * self.size:
                means, weights = np.concatenate(own[3]), np.concatenate(own[4])
                own[3:] = ([x] for x in (digest(means, weights, self.size) if len(means) else (means, weights)))
        self.held = sum(len(x) for own in self.groups.values() for x in own[3])

    def rows(self, kind: pa.DataType, name: str) -> pa.RecordBatch:
        self.merge()
        own = list(self.groups.values())
        columns = [pa.array(list(self.groups), kind), pa.array([x[0] for x in own], pa.int64()), *(pa.array([x[c] for x in own], pa.float64()) for c in (1, 2))]
        columns += [pa.array([x[c][0].tolist() for x in own], pa.list_(pa.float64())) for c in (3, 4)]
        return pa.RecordBatch.from_arrays(columns, [name, "n", "low", "high", "means", "weights"])


def tdigest(df: DataFrame, by: str, col: str, size: int = SIZE) -> DataFrame:
    """``(by, n, low, high, means, weights)``: a t-digest of ``col`` for each ``by``.

    A task digests the values of its Arrow batches group by group and passes
    on one digest for each group, or several where it meets very many groups;
    digests of a group are merged ``FAN_IN`` at a time, as a tree, so no task
    sees more of them, whatever share of the rows a group has. Null and NaN
    values count nowhere, infinite ones only as extremes; a group of none has
    no row; a null ``by`` is a group.
    """
    own = df.select(F.col(by).alias("g"), F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    kind = own.schema["g"].dataType

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, arrow = _Digests(size), None
        for batch in batches:
            arrow = batch.schema.field(0).type
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            place, v = codes.indices.to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[order], np.arange(len(codes.dictionary) + 1))
            for group, a, b in zip(codes.dictionary.to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                x = v[order[a:b]]
                inside = x[np.isfinite(x)]
                made.add(group, len(x), float(x.min()), float(x.max()), inside, np.ones(len(inside)))
            if len(made.groups) > HELD // size:
                yield made.rows(arrow, "g")
                made = _Digests(size)
        if made.groups:
            yield made.rows(arrow, "g")

    def merge(table: pa.Table) -> pa.Table:
        made = _Digests(size)
        for r in table.to_pylist():
            made.add(r["g"], r["n"], r["low"], r["high"], np.array(r["means"]), np.array(r["weights"]))
        return pa.Table.from_batches([made.rows(table.schema.field("g").type, "g")])

    schema = f"g {kind.simpleString()}, {SCHEMA}"
    now = stage(own.mapInArrow(build, schema), "digests")
    while (most := now.groupBy("g").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0) > 1:
        leaf = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-most // FAN_IN)))
        before, now = now, stage(now.withColumn("leaf", leaf).groupBy("g", "leaf").applyInArrow(lambda t: merge(t.drop_columns(["leaf"])), schema), "digests")
        unstage(before)
    return now.withColumnRenamed("g", by)


def quantiles_of(digests: DataFrame, shares: list[float], name: str = "quantiles") -> DataFrame:
    """``digests`` with an array of their quantiles at ``shares`` in place of the centroids."""
    kept = [c for c in digests.columns if c not in ("means", "weights", name)]
    own = digests.select(*kept, "means", "weights")
    asked = np.array(shares, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.to_pydict()
            out = [quantile(a, z, np.array(m), np.array(w), asked).tolist() if m else [a] * len(asked) for a, z, m, w in zip(x["low"], x["high"], x["means"], x["weights"], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(out, pa.list_(pa.float64()))], [*kept, name])

    result = own.select(*kept, F.array().cast("array<double>").alias(name)).schema
    return own.mapInArrow(run, result)
