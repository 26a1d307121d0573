"""Quality classifier: Bradley-Terry ranking learned from preference pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import LOWER, slices, utf8

#: Labelled documents that are fitted at most, those of least hash of the id.
MAX_LABELLED = 20_000
#: Preference pairs drawn from them.
PAIRS = 100_000
_SIGNS = b"!?.,;:|#*$%&<>'\"()[]{}-_/\\@=+~^`"
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
N_FEATURES = 22 + len(_SIGNS)


def features(text: bytes | None) -> np.ndarray:
    """Numbers that describe a whole text; of an empty or null one, zeros."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, words = len(text), text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n = max(1, len(words))
    letters = seen[_UPPER].sum() + seen[_LOWER].sum() + seen[128:].sum()
    lower = text.translate(LOWER).split()
    codes: dict[bytes, int] = {}
    own = np.fromiter((codes.setdefault(w, len(codes)) for w in lower), np.int64, len(lower))
    counts = np.bincount(own)
    _, pair, pairs = np.unique(own[:-1] * max(1, len(codes)) + own[1:], return_inverse=True, return_counts=True)
    triples = np.unique(pair[:-1] * max(1, len(codes)) + own[2:]).size if len(own) > 2 else 0
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    out[:22] = (
        np.log1p(len(words)),
        np.log1p(len(lines)),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        len(counts) / n,
        len(counts) / np.sqrt(n),
        counts.max(initial=0) / n,
        len(pairs) / max(1, n - 1),
        pairs.max(initial=0) / n,
        triples / max(1, n - 2),
        int((own[1:] == own[:-1]).sum()) / n,
        seen[_UPPER].sum() / max(1, letters),
        seen[_DIGIT].sum() / size,
        letters / size,
        seen[[9, 10, 11, 12, 13, 32]].sum() / size,
        seen[128:].sum() / size,
        len(set(lines)) / max(1, len(lines)),
        sum(map(len, set(lines))) / max(1, sum(map(len, lines))),
        np.log1p(len(words) / max(1, len(lines))),
        sum(w[-1:] in _SIGNS for w in words) / n,
        sum(not w.isalnum() and w.isascii() for w in words) / n,
    )
    out[22:] = np.sqrt(seen[list(_SIGNS)] / size)
    return out


class BradleyTerry:
    """Scores whose differences give the odds that one text is preferred.

    P(a before b) is the logistic function of w (x_a - x_b), x being scaled
    features. w minimises the logistic loss over random pairs of a text of
    label 1 and one of label 0, with a small quadratic penalty, by Newton
    steps. A text is accepted if its score reaches the quantile of the
    training scores at which most labels come out right. With one label
    only, all texts score alike and get that label; with none, label 1.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, seed: int = 0):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
        spread = x.std(axis=0) if len(x) else np.ones(N_FEATURES)
        self.scale = np.where(spread > 1e-12, spread, 1.0)
        self.w = np.zeros(N_FEATURES)
        self.cut, self.width = (-1.0 if not len(y) or y.all() else 1.0), 1.0
        if y.any() and not y.all():
            z, rng = self._scaled(x), np.random.default_rng(seed)
            d = z[rng.choice(np.flatnonzero(y), pairs)] - z[rng.choice(np.flatnonzero(~y), pairs)]
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(d @ self.w, -30, 30)))
                step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(N_FEATURES), d.T @ (1 - p) / pairs - penalty * self.w)
                self.w += step
                if np.abs(step).max() < 1e-6:
                    break
            self.cut, self.width = self._quantile(z @ self.w, y)

    @staticmethod
    def _quantile(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        by = np.argsort(s, kind="stable")
        s, y = s[by], y[by]
        wrong = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum(~y[::-1])[::-1], [0]))
        best = np.flatnonzero(wrong == wrong.min())
        edges = np.concatenate(([s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]))
        gap = np.concatenate(([1], s[1:] - s[:-1], [1]))
        return float(edges[best[gap[best].argmax()]]), float(max(1.0, s.std()))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, at least 0.5 from the threshold up."""
        return 1 / (1 + np.exp(-np.clip((self._scaled(x) @ self.w - self.cut) / self.width, -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> BradleyTerry:
    """A ranking fitted to at most ``most`` labelled documents.

    The labels of an id are averaged (a tie counts as 0); null labels and ids
    are left out, as are labels without a document. Of documents of one id,
    one is used. Only ids with their labels are broadcast and only features
    come to the driver, ``most`` rows at most of each.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) > 0.5).alias("y"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(most)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marks), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = [features(t).tolist() for t in utf8(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = own.mapInArrow(run, f"id {kind}, y boolean, x array<double>").groupBy("id").agg(F.min(F.struct("y", "x")).alias("r")).select("id", "r.*").toArrow().sort_by("id")
    x = np.array(found["x"].to_pylist(), np.float64).reshape(-1, N_FEATURES)
    return BradleyTerry(x, np.array(found["y"].to_pylist(), bool))


def score(docs: DataFrame, model: BradleyTerry, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced.

    Whole texts are used, a word taking some 100 bytes; an empty or null text
    has the features of nothing; repeated rows are scored alike; an empty
    table stays empty.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.drop("score", "predicted").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    at = own.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = known.value.score(np.array([features(t) for t in utf8(part.column(at))]))
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=part.schema)

    return own.mapInArrow(run, own.schema)
