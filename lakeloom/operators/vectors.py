"""Dense vectors: distances, exact nearest neighbours, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators import grid
from lakeloom.operators.grid import best, in_cells, matrix

#: Queries and vectors that are multiplied at a time, and pairs that are summed anew.
QUERIES, VECTORS, PAIRS = 512, 1024, 1 << 14
#: The same for distances of all pairs, so that sums stay in the processor's cache.
TILE_QUERIES, TILE_VECTORS = 16, 512


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double; null for null vectors or of different lengths."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null if a vector has length zero."""
    return inner_product(a, b) / F.nullif(F.sqrt(inner_product(a, a) * inner_product(b, b)), F.lit(0.0))


def by_length(df: DataFrame, id_col: str, vec_col: str, name: str) -> DataFrame:
    """``(name, v, g)``: ids and vectors in double, and their length."""
    return df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias(name), F.col(vec_col).cast("array<double>").alias("v"), F.size(vec_col).cast("long").alias("g"))


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int = 10, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query, id, sim, rank)``: the k nearest by cosine, ties by id.

    Queries and corpus meet in the cells of a grid (``grid.in_cells``), where
    a block of queries is held and vectors stream past it: neither side goes
    to the driver, and a task's memory depends on the sizes of a block and of
    a slice alone. A cell passes on its own k best for each query. Null and
    zero vectors and those with a null, NaN or infinite component are, on
    either side, nobody's neighbour; vectors of different lengths aren't
    compared. A query id that repeats is one query for each row, whose
    results are merged.
    """
    own, asked = by_length(corpus, id_col, vec_col, "id"), by_length(queries, id_col, vec_col, "query")
    out = in_cells(asked, own, lambda: _Nearest(k), "query long, id long, sim double", group="g")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which rows have them: those with a direction."""
    norm = np.linalg.norm(v, axis=1)
    has = np.flatnonzero((norm > 0) & np.isfinite(norm))
    return v[has] / norm[has, None], has


class _Nearest:
    """The k nearest vectors of a cell for each of its queries.

    Products of a slice of queries and a slice of vectors are compared with
    the k-th best so far. Those that reach it, within rounding, are summed
    anew in one fixed order, so that equal vectors have equal similarities
    wherever they stand.
    """

    def __init__(self, k: int):
        self.k, self.held, self.found = k, [], None

    def ask(self, columns: list[pa.Array]) -> None:
        self.held.append((columns[0].to_numpy(), matrix(columns[1])))

    def _begin(self) -> None:
        self.q, has = unit(np.concatenate([v for _, v in self.held]))
        self.names = np.concatenate([n for n, _ in self.held])[has]
        self.least = np.full(len(self.q), -np.inf)
        self.found = {a: (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for a in range(0, len(self.q), QUERIES)}
        self.held = []

    def feed(self, columns: list[pa.Array]) -> None:
        if self.found is None:
            self._begin()
        ids, vectors = columns[0].to_numpy(), matrix(columns[1])
        for r in range(0, len(ids), VECTORS):
            v, has = unit(vectors[r : r + VECTORS])
            own = ids[r : r + VECTORS][has]
            for a in self.found if len(v) else ():
                s = self.q[a : a + QUERIES] @ v.T
                least = self.least[a : a + QUERIES]
                if len(v) > self.k:
                    least = np.maximum(least, np.partition(s, len(v) - self.k, axis=1)[:, -self.k])
                who, what = np.nonzero(s >= (least - 1e-9)[:, None])
                for p in range(0, len(who), PAIRS):
                    self._take(a, a + who[p : p + PAIRS], what[p : p + PAIRS], v, own)

    def _take(self, a: int, who: np.ndarray, what: np.ndarray, v: np.ndarray, ids: np.ndarray) -> None:
        sim = np.einsum("ij,ij->i", self.q[who], v[what])
        whole = [np.concatenate(x) for x in zip(self.found[a], (who, sim, ids[what]), strict=True)]
        top = best(whole[0], whole[1], (whole[2],), self.k)
        self.found[a] = held = tuple(x[top] for x in whole)
        many = np.bincount(held[0] - a)
        self.least[a : a + len(many)] = np.where(many == self.k, held[1][np.cumsum(many) - 1], -np.inf)

    def end(self) -> pa.RecordBatch:
        if self.found is None:
            self._begin()
        who, sim, ids = (np.concatenate([np.zeros(0, t), *(x[c] for x in self.found.values())]) for c, t in enumerate((np.int64, np.float64, np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(self.names[who]), pa.array(ids), pa.array(sim)], ["query", "id", "sim"])


def knn_filtered(queries: DataFrame, corpus: DataFrame, where: Column, k: int = 10, **columns: str) -> DataFrame:
    """``knn_exact`` among the corpus rows that satisfy ``where``, filtered before they are ranked."""
    return knn_exact(queries, corpus.where(where), k, **columns)


def distances(queries: DataFrame, corpus: DataFrame, *, digits: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query, id, cos, l2, ip)``, ``id`` under the name ``id_col``: every query with every vector, a row for each pair of rows.

    The sides meet in the cells of a grid (``grid.in_cells``). Results are those
    of sums component by component, in order and in double, so a pair has the
    same bits wherever it stands. A slice's pairs are passed on at once:
    a task holds a block of queries and a slice of pairs. ``digits`` rounds,
    halves away from zero. Vectors that are null, hold a null or differ in
    length have null for all three, empty ones a null cosine, and beside a
    vector of length zero the cosine is NaN, as in SQL. Null and repeated ids
    are rows like any other.
    """
    whole = F.when(~F.exists(vec_col, lambda x: x.isNull()), F.col(vec_col))
    side = lambda df, name: df.select(F.col(id_col).cast("long").alias(name), whole.alias("v"), F.lit(0).cast("long").alias("g"))
    # The id has its last name at once: renaming it later would copy every pair's row.
    schema = f"query long, `{id_col}` long, cos double, l2 double, ip double"
    return in_cells(side(queries, "query"), side(corpus, "id"), lambda: _Distances(digits, id_col), schema, group="g", asked_block=grid.PAIRS_ASKED, row_block=grid.PAIRS_ROWS)


class _Slice:
    """Some ids and their vectors: by length where they stand, their components as rows, and their squared norms."""

    def __init__(self, ids: pa.Array, column: pa.Array):
        self.ids, self.of = ids, {}
        sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        for n in np.unique(sizes[sizes >= 0]).tolist():
            at = np.flatnonzero(sizes == n)
            flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            v = np.ascontiguousarray(flat.reshape(len(at), n).T, dtype=np.float64)
            norm = np.zeros(len(at))
            for x in v:
                norm += x * x
            self.of[n] = at, v, norm


class _Distances:
    """All pairs of a cell, a slice of queries and a slice of vectors at a time."""

    def __init__(self, digits: int | None, id_col: str = "id"):
        self.digits, self.id_col, self.held = digits, id_col, []

    def ask(self, columns: list[pa.Array]) -> None:
        self.held += _slices(columns, TILE_QUERIES)

    def feed(self, columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        for v in _slices(columns, TILE_VECTORS):
            for q in self.held:
                yield self._pairs(q, v)

    def _pairs(self, q: _Slice, v: _Slice) -> pa.RecordBatch:
        shape = len(q.ids), len(v.ids)
        out, known = np.zeros((3, *shape)), np.zeros((2, *shape), bool)
        for n in q.of.keys() & v.of.keys():
            (a, x, p), (b, y, r) = q.of[n], v.of[n]
            whole = (len(a), len(b)) == shape
            at = (slice(None), slice(None)) if whole else np.ix_(a, b)
            found = _distances(x, y, p, r) if self.digits is None else _rounded_distances(x, y, p, r, self.digits)
            for c, of in enumerate(found):
                out[c][at] = of
            known[0][at], known[1][at] = n > 0, True
        values = [pa.array(x.ravel(), mask=None if k.all() else ~k.ravel()) for x, k in zip(out, (known[0], known[1], known[1]), strict=True)]
        who, what = np.repeat(np.arange(shape[0]), shape[1]), np.tile(np.arange(shape[1]), shape[0])
        return pa.RecordBatch.from_arrays([q.ids.take(pa.array(who)), v.ids.take(pa.array(what)), *values], ["query", self.id_col, "cos", "l2", "ip"])

    def end(self) -> pa.RecordBatch:
        none = _Slice(pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64())))
        return self._pairs(none, none)


def _slices(columns: list[pa.Array], size: int) -> Iterator[_Slice]:
    for r in range(0, len(columns[0]), size):
        yield _Slice(columns[0].slice(r, size), columns[1].slice(r, size))


def _distances(x: np.ndarray, y: np.ndarray, p: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Cosine, Euclidean distance and inner product of all columns of ``x`` and ``y``, whose squared norms are ``p`` and ``r``."""
    return _summed(x[:, :, None], y[:, None, :], p[:, None], r)


def _summed(x: np.ndarray, y: np.ndarray, p: np.ndarray, r: np.ndarray) -> np.ndarray:
    shape = np.broadcast_shapes(x.shape[1:], y.shape[1:])
    out, t = np.zeros((3, *shape)), np.zeros(shape)
    cos, squares, ip = out
    with np.errstate(all="ignore"):
        for a, b in zip(x, y, strict=True):
            ip += np.multiply(a, b, out=t)
            np.subtract(a, b, out=t)
            squares += np.multiply(t, t, out=t)
        np.clip(np.divide(ip, np.sqrt(p * r), out=cos), -1.0, 1.0, out=cos)
        np.sqrt(squares, out=squares)
    return out


def _rounded_distances(x: np.ndarray, y: np.ndarray, p: np.ndarray, r: np.ndarray, digits: int) -> np.ndarray:
    """``_distances`` rounded.

    A product of matrices, whose sums have another order, settles every pair
    that is farther from a half, and from zero, whose sign counts, than its
    error can be; the others, and those that aren't finite, are summed in order.
    """
    n, unit = len(x), 10.0**digits
    with np.errstate(all="ignore"):
        ip, most = x.T @ y, np.sqrt(p[:, None] * r)
        both = p[:, None] + r
        l2 = np.sqrt(both - 2 * ip)
        out = np.stack([ip / most, l2, ip])
        # Bounds of errors, with room: of sums and squares by their lengths, of scaling by the values.
        slack = (n + 8) * 8 * np.finfo(float).eps
        near = np.stack([np.full_like(ip, slack), slack * both / l2, slack * most]) + 4 * np.finfo(float).eps * np.abs(out)
        scaled = out * unit
        away = np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5)
        who, what = np.nonzero(~np.all((away > near * unit) & (np.abs(out) > near), axis=0))
        out = _rounded(out, digits)
    if 8 * len(who) > ip.size:
        return _rounded(_distances(x, y, p, r), digits)
    if len(who):
        out[:, who, what] = _rounded(_summed(x[:, who], y[:, what], p[who], r[what]), digits)
    return out


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero; what is too large to be scaled, or isn't finite, stays."""
    with np.errstate(all="ignore"):
        scaled = x * 10.0**digits
        near = np.trunc(scaled)
        near += np.copysign(np.abs(scaled - near) >= 0.5, scaled)
        near /= 10.0**digits
    return np.where(np.isfinite(near), near, x)


def upsert(base: DataFrame, changes: DataFrame, *, id_col: str = "vec_id", order_col: str = "version") -> DataFrame:
    """``base`` with ``changes`` applied: of an id's changes the one with the highest ``order_col`` counts.

    ``changes`` has the columns of ``base``, ``order_col`` and a boolean
    ``deleted``; deleted ids go. Ids without change stay as they are.
    """
    latest = changes.groupBy(id_col).agg(F.max_by(F.struct(*changes.columns), order_col).alias("c")).select("c.*")
    kept = base.join(latest.select(id_col), id_col, "left_anti")
    return kept.unionByName(latest.where(~F.coalesce("deleted", F.lit(False))).select(base.columns))
