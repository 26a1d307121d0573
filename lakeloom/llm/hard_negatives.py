"""Hard negatives by partial products along principal components, verified with integers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import stage
from lakeloom.operators.grid import best, in_cells, matrix

#: A component is multiplied by this and rounded down.
SCALE = 256
#: Numbers of the sample that the rotation is fitted to, and components up to which vectors are rotated.
SAMPLE_NUMBERS, MAX_ROTATED = 1 << 21, 1024
#: Anchors that a cell holds, rows that stream past them, and how many of each are multiplied at a time.
ANCHOR_BLOCK, ROW_BLOCK, ANCHORS, ROWS, PAIRS = 2048, 1 << 14, 256, 1024, 1 << 14
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Rotation:
    """An orthogonal matrix, and after how many of its leading components pairs are looked at."""

    axes: np.ndarray | None
    cuts: tuple[int, ...]

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return v.astype(np.float64) if self.axes is None else v @ self.axes


def fit(rows: DataFrame) -> dict[int, Rotation]:
    """A rotation for each of the eight most frequent lengths of vectors in the sample.

    It is fitted to the rows of least hash, ``SAMPLE_NUMBERS`` numbers at
    most. Any rotation gives the same result; a good one puts most of a
    product into few components. Other lengths are multiplied unrotated.
    """
    longest = rows.agg(F.max("d")).first()[0]
    if not longest:
        return {}
    sample = rows.where(F.col("d").between(1, MAX_ROTATED)).orderBy(F.xxhash64("row"), "row").limit(max(32, SAMPLE_NUMBERS // min(longest, MAX_ROTATED)))
    by_length: dict[int, list] = {}
    for r in sample.select("d", "v").collect():
        by_length.setdefault(r.d, []).append(r.v)
    out = {}
    for d in sorted(by_length, key=lambda d: -len(by_length[d]))[:8]:
        v = np.array(by_length[d], np.float64).reshape(-1, d)
        weight, axes = np.linalg.eigh(v.T @ v)
        share = np.cumsum(np.maximum(weight[::-1], 0)) / max(weight.sum(), 1e-300)
        out[d] = Rotation(np.ascontiguousarray(axes[:, ::-1]), tuple(sorted({min(d, int(np.searchsorted(share, s)) + 1) for s in (0.5, 0.85)} | {d})))
    return out


class _Search:
    """The best rows of a cell for its anchors, within a band of scores for each.

    The product of an anchor and a row is summed over the leading components
    of both. What the others may add is bounded by the norms of what is left
    (Cauchy and Schwarz), with slack for rounding. A pair that even so can't
    reach the band, or the k-th best found so far, is discarded; for those
    left the sum goes on. The last survivors are multiplied as integers,
    which alone decides.
    """

    def __init__(self, rotations: dict[int, Rotation], k: int, same: bool, band: tuple[int, int] | None):
        self.rotations, self.k, self.same, self.band = rotations, k, same, band
        self.held: list[list[pa.Array]] = []
        self.full: np.ndarray | None = None

    def ask(self, columns: list[pa.Array]) -> None:
        self.held.append(columns)

    def _begin(self) -> None:
        join = lambda c: np.concatenate([x[c].to_numpy(zero_copy_only=False) for x in self.held])
        self.row, self.id, self.label = join(0), join(1), join(2)
        self.v = np.concatenate([matrix(x[3]) for x in self.held]).reshape(len(self.row), -1).astype(np.int64)
        d = self.v.shape[1]
        self.rotation = self.rotations.get(d) or Rotation(None, tuple(sorted({-(-d // 2), d})) if d else ())
        self.y = self.rotation(self.v)
        self.tail, self.norm = _tails(self.y, self.rotation.cuts)
        self.positives = [p for x in self.held for p in x[4].to_pylist()] if self.band else [[None]] * len(self.row)
        n = max(map(len, self.positives), default=0)
        self.low, self.high = np.full((len(self.row), n), _MOST, np.int64), np.full((len(self.row), n), _LEAST, np.int64)
        for a, own in enumerate(self.positives):
            for j, p in enumerate(own):
                # Python's integers: a hundred times a score needn't fit a long.
                self.low[a, j], self.high[a, j] = (-(-self.band[0] * p["score"] // 100), self.band[1] * p["score"] // 100) if p else (_LEAST, _MOST)
        self.full = np.full((len(self.row), n), _LEAST, np.int64)
        self.found = {(a, j): tuple(np.zeros(0, np.int64) for _ in range(4)) for a in range(0, len(self.row), ANCHORS) for j in range(n)}

    def feed(self, columns: list[pa.Array]) -> None:
        if self.full is None:
            self._begin()
        row, ids, label = (columns[c].to_numpy(zero_copy_only=False) for c in range(3))
        v = matrix(columns[3]).reshape(len(row), -1)
        for r in range(0, len(row), ROWS):
            own = v[r : r + ROWS].astype(np.int64)
            y = self.rotation(own)
            tail, norm = _tails(y, self.rotation.cuts)
            for a in range(0, len(self.row), ANCHORS):
                at = slice(a, a + ANCHORS)
                pairs = self._survivors(at, y, tail, norm, label[r : r + ROWS], row[r : r + ROWS])
                for p in range(0, len(pairs[0]), PAIRS):
                    who, what = pairs[0][p : p + PAIRS], pairs[1][p : p + PAIRS]
                    self._take(a, who, np.einsum("ij,ij->i", self.v[who], own[what]), ids[r + what], row[r + what])

    def _survivors(self, at: slice, y: np.ndarray, tail: np.ndarray, norm: np.ndarray, label: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) of the pairs that may still be among the best."""
        low, high = self.low[at].astype(np.float64), self.high[at].astype(np.float64)
        need = np.where(low <= high, np.maximum(low, self.full[at].astype(np.float64)), np.inf)
        slack = self.norm[at] * norm.max(initial=0.0) * (y.shape[1] + 8) * 2.0**-50 + 1e-9
        least, most = need.min(axis=1, initial=np.inf) - slack, high.max(axis=1, initial=-np.inf) + slack
        alive = (self.label[at][:, None] == label) == self.same
        if self.same:
            alive &= self.row[at][:, None] != row
        columns, total, since = np.arange(len(row)), np.zeros(alive.shape), 0
        for k, cut in enumerate(self.rotation.cuts):
            total += self.y[at, since:cut] @ y[columns, since:cut].T
            bound = np.outer(self.tail[at, k], tail[columns, k])
            alive &= (total + bound >= least[:, None]) & (total - bound <= most[:, None])
            since = cut
            left = np.flatnonzero(alive.any(axis=0))
            if 2 * len(left) < len(columns):
                columns, total, alive = columns[left], total[:, left], alive[:, left]
        if not len(columns):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hits, s = np.zeros_like(alive), slack[:, None]
        for j in range(low.shape[1]):
            inside = alive & (total >= need[:, j, None] - s) & (total <= high[:, j, None] + s)
            if total.shape[1] > self.k and inside.any():
                sure = np.where(inside & (total >= low[:, j, None] + s) & (total <= high[:, j, None] - s), total, -np.inf)
                inside &= total >= np.partition(sure, -self.k, axis=1)[:, -self.k, None] - 2 * s
            hits |= inside
        who, what = np.nonzero(hits)
        return who + at.start, columns[what]

    def _take(self, a: int, who: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        """Puts verified pairs of the anchors from ``a`` on among the best."""
        for j in range(self.full.shape[1]):
            fits = (score >= np.maximum(self.low[who, j], self.full[who, j])) & (score <= self.high[who, j])
            if fits.any():
                whole = [np.concatenate(x) for x in zip(self.found[a, j], (who[fits], score[fits], ids[fits], row[fits]), strict=True)]
                top = best(whole[0], whole[1], (whole[2], whole[3]), self.k)
                self.found[a, j] = held = tuple(x[top] for x in whole)
                many = np.bincount(held[0] - a)
                last = held[1][np.cumsum(many) - 1]
                self.full[a : a + len(many), j] = np.where(many == self.k, last, _LEAST)

    def end(self) -> pa.RecordBatch:
        if self.full is None:
            self._begin()
        parts: list[list[np.ndarray]] = []
        for (_, j), (who, score, ids, row) in self.found.items():
            p = [self.positives[a][j] or {"id": 0, "score": 0} for a in who.tolist()]
            parts.append([self.row[who], self.id[who], np.full(len(who), j, np.int32), np.array([x["id"] for x in p], np.int64), np.array([x["score"] for x in p], np.int64), ids, score, row])
        kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in parts]) if parts else [], t) for c, t in enumerate(kinds)], _FOUND_NAMES)


_FOUND = "anchor_row long, anchor_id long, j int, positive_id long, positive_score long, id long, score long, row long"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _tails(y: np.ndarray, cuts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Norms of what is left after each cut, and whole norms, no less than the exact ones."""
    squares = y * y
    up = 1 + (y.shape[1] + 8) * 2.0**-50
    return np.stack([np.sqrt(squares[:, c:].sum(axis=1)) * up for c in cuts], axis=1) if cuts else np.zeros((len(y), 0)), np.sqrt(squares.sum(axis=1)) * up


def taking_part(vectors: DataFrame, anchor: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``(row, id, label, v, d, anchor)`` of the rows that take part, staged; ``v`` holds integers."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.when(finite, x).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    own = own.where("id is not null and label is not null and x is not null").withColumn("v", F.transform("x", lambda c: F.floor(c * scale).cast("long")))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return stage(own.where(square < 2.0**62).select(F.monotonically_increasing_id().alias("row"), "id", "label", "v", F.size("v").alias("d"), "anchor"), "vectors")


def mine(vectors: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A score is the inner product of two rows' components, each multiplied by
    ``scale`` and rounded down to an integer; higher ones come first, ties by
    smaller id. Rows where ``anchor`` is true ask: each for its first
    ``positives`` other rows of its label, and with each of these for the
    first ``negatives`` rows of another label whose score is at least ``low``
    and at most ``high`` per cent of the positive's.

    Every anchor is compared with every row, in cells of bounded size (see
    ``operators.grid``), first within its label and then with the others.
    Partial products along the principal components of a sample discard most
    pairs that can't count, and integers decide the rest, so the result
    doesn't depend on the sample. A label, or a vector, with a third of all
    rows is spread like any other rows; a cell passes on its best few alone.

    Rows with a null id, label, vector or component, with an infinite or NaN
    one, or with an integer vector whose squared length is 2**62 or more (its
    scores needn't fit a long), take no part. Vectors of different lengths
    aren't compared; those of length 0 have score 0. Repeated ids and rows
    are rows of their own: each asks, and each may be found, beside the other.
    Long vectors are held by the block. An empty table, or one without
    anchors, gives no rows. Other columns are not used, whatever their names.
    """
    own = taking_part(vectors, anchor, id_col=id_col, vec_col=vec_col, label_col=label_col, scale=scale)
    sent = vectors.sparkSession.sparkContext.broadcast(fit(own))  # eight rotations at most
    payload = ["row", "id", "label", "v"]

    def search(asked: DataFrame, k: int, same: bool, band: tuple[int, int] | None) -> DataFrame:
        # A group is a length of vectors, and with it a label where only equal labels meet.
        group = F.shiftleft(F.col("d").cast("long"), 40) + F.pmod("label", F.lit(1 << 40)) if same else F.col("d").cast("long")
        rows = own.select(*payload, group.alias("g"))
        found = in_cells(asked.withColumn("g", group).drop("d", "anchor"), rows, lambda: _Search(sent.value, k, same, band), _FOUND, group="g", asked_block=ANCHOR_BLOCK, row_block=ROW_BLOCK)
        rank = F.row_number().over(Window.partitionBy("anchor_row", "j").orderBy(F.desc("score"), "id", "row"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    anchors = own.where("anchor")
    near = search(anchors, positives, True, None)
    listed = near.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    asked = stage(anchors.join(listed.withColumnRenamed("anchor_row", "row"), "row").select(*payload, "positives", "d"), "anchors")
    out = search(asked, negatives, False, (low, high))
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::bigint AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER x)::int AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW x AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER x <= 10
"""
