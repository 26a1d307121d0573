"""Near-duplicate texts by min-wise signatures, banding and an exact check (Broder, 1997)."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.components import components
from lakeloom.operators.grid import in_cells
from lakeloom.operators.joins import equi_join, fits
from lakeloom.sources.shared import stage

#: Words of a shingle, and the Jaccard similarity of two texts' sets of shingles from which they are near-duplicates.
WIDTH, SIMILARITY = 5, 0.8
#: Bands of a signature and values of a band: a pair of similarity s is found with a chance of 1 - (1 - s**ROWS)**BANDS, 0.996 at 0.8.
BANDS, ROWS = 18, 6
#: Texts that a cell holds, texts that stream past them, and of both how many are compared at a time.
ASKED_BLOCK, ROW_BLOCK, SLICE = 512, 4096, 256
#: Shingles for which a slice's incidence matrices are filled at a time.
_COLUMNS = 8192
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = bytes(range(256)).lower()


def shingles(text: bytes, width: int = WIDTH) -> set[bytes]:
    """The runs of ``width`` words, A-Z lower-cased; the whole of a text with fewer words, nothing of one without."""
    words = text.translate(_LOWERED).split()
    if len(words) <= width:
        return {b" ".join(words)} - {b""}
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    return {joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signatures(width: int, bands: int, rows: int):
    """Adds the number of shingles and a key for each band to (id, digest, row, hashes of words)."""
    rng = np.random.default_rng(1997)
    odd = lambda n: rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    place, times, plus, mark, number = odd(width), odd(bands * rows), odd(bands * rows), odd(rows), odd(bands)

    def keys(w: np.ndarray) -> list[int]:
        n = max(1, len(w) - width + 1)
        own = np.zeros(n, np.uint64)
        for j in range(min(width, len(w))):
            own += w[j : j + n] * place[j]
        own = _mixed(own + np.uint64(min(width, len(w))))
        least = np.full(bands * rows, (1 << 64) - 1, np.uint64)
        for k in range(0, n, 2048):
            np.minimum(least, (own[k : k + 2048, None] * times + plus).min(axis=0), out=least)
        return _mixed((least.reshape(bands, rows) * mark).sum(axis=1, dtype=np.uint64) + number).view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            words, edges = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            found = [keys(words[a:b]) if b > a else [] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["id", "digest", "row", "keys"])

    return run


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, class_id, component_id)``, a row for each row of ``docs``.

    Two texts link if the Jaccard similarity of their sets of shingles is at
    least ``similarity``. ``class_id`` is the smallest id with the same text,
    ``component_id`` the smallest that links lead to. See ``_linked`` for how;
    every link is checked on the shingles themselves, so none is spurious,
    and of those there are, one is missed with the chance that no band agrees.

    A null text is an empty one; texts without words link with nothing but
    their copies. Null ids name a class or component only if it has no
    other, as null. Ids that repeat with another text are documents of their
    own. Very long texts are used whole; an empty table gives no rows; other
    columns aren't used, whatever their names.
    """
    signed, classes, edges = _linked(docs, id_col, text_col, width, similarity, bands, rows)
    roots = components(edges).select(F.col("node").alias("n"), "root")
    rooted = stage(classes.join(roots, F.col("node") == F.col("n"), "left").select("digest", F.col("id").alias("class_id"), F.coalesce("root", "node").alias("root")), "roots")
    named = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"))
    by_class = stage(rooted.join(named, "root").select("digest", "class_id", "component_id"), "named")
    return signed.select("id", "digest").join(by_class, "digest").select(F.col("id").alias("doc_id"), "class_id", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Of each component of ``docs`` one row, all its columns kept: one with the least id, null ids last.

    Rows equal in id and text are one document, of which one row stays; so
    are, of one id, all texts that links join.
    """
    signed, classes, edges = _linked(docs, id_col, text_col, width, similarity, bands, rows)
    roots = components(edges).select(F.col("node").alias("n"), "root")
    rooted = classes.join(roots, F.col("node") == F.col("n"), "left").select(F.struct(F.col("id").isNull(), "id", "digest").alias("x"), F.coalesce("root", "node").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.digest").alias("__digest"), F.col("x.id").alias("__id"))
    times = signed.groupBy("digest", "id").agg(F.count("*").alias("__n"))
    chosen = stage(chosen.join(times, (F.col("__digest") == F.col("digest")) & F.col("__id").eqNullSafe(F.col("id"))).drop("digest", "id"), "chosen")
    own = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(id_col).alias("__own"), _digest(text_col).alias("__text"))
    kept = own.join(chosen, (F.col("__text") == F.col("__digest")) & F.col("__own").eqNullSafe(F.col("__id")))
    # Nearly all rows occur once and needn't be compared.
    return kept.where("__n = 1").unionByName(kept.where("__n > 1").dropDuplicates(["__digest", "__id"])).select("__doc.*")


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(_text(text_col), 256))


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed rows, classes of equal texts, and links (u, v) that join the classes' nodes into components.

    Words are hashed by Spark, shingles and their minima in Arrow batches.
    Equal texts are one class from there on, told apart by SHA-256, so copies
    never multiply. A class is filed under a key for each band; keys of one
    class alone go no further. First every class is compared with the least
    of its bucket, which is linear in the bucket however hot it is and joins
    nearly all groups. Buckets that still hold several components are then
    compared block by block, texts of different components only, each cell
    giving back no more links than join its components. Texts are exchanged
    once, and only those of classes that share a key go on.
    """
    limit = Fraction(similarity).limit_denominator(1000)
    own = docs.select(F.col(id_col).alias("id"), _digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row"), _text(text_col).alias("text"))
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    hashed = own.select("id", "digest", "row", F.transform(words, lambda w: F.xxhash64(w)).alias("w"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = stage(hashed.mapInArrow(_signatures(width, bands, rows), f"id {kind}, digest binary, row long, keys array<long>"), "signatures")
    classes = stage(signed.groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("id"), F.any_value("keys").alias("keys")), "classes")
    filed = classes.select("node", F.explode("keys").alias("key"))
    shared = stage(filed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    met = stage(filed.join(shared, "key"), "met")
    stars = stage(met.where("node <> least").select("least", "node").distinct(), "stars")
    asked = classes.join(met.select("node").distinct(), "node").select("digest", "node")
    asked = stage(asked, "asked")
    texts = docs.select(_digest(text_col).alias("digest"), _text(text_col).alias("text"))
    few = asked.select("digest")
    texts = equi_join(texts, few, ["digest"], "left_semi") if fits(few) else texts
    texts = stage(texts.groupBy("digest").agg(F.any_value("text").alias("text")).join(asked, "digest").select("node", "text"), "texts")

    centres = stars.select(F.col("least").alias("node")).distinct().join(texts, "node").select(F.col("node").alias("g"), "node", "text")
    members = stars.join(texts, "node").select(F.col("least").alias("g"), "node", "text")
    near = stage(in_cells(centres, members, lambda: _Star(width, limit), _LINK, group="g", row_block=ROW_BLOCK), "links")
    roots = components(near).select(F.col("node").alias("n"), "root")
    placed = stage(met.join(roots, F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed")
    still = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    open_ = placed.join(still, "key").join(texts, "node").select(F.col("key").alias("g"), "node", "root", "text")
    open_ = stage(open_, "open")
    more = stage(in_cells(open_, open_, lambda: _Block(width, limit), _LINK, group="g", asked_block=ASKED_BLOCK, row_block=ROW_BLOCK), "links")
    return signed, classes, near.unionByName(more)


_LINK = "u long, v long"


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["u", "v"])


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


class _Star:
    """Links of one text with those that are near enough to it."""

    def __init__(self, width: int, limit: Fraction):
        self.width, self.limit, self.found = width, limit, []

    def ask(self, columns: list[pa.Array]) -> None:
        self.node, self.own = columns[1][0].as_py(), shingles(_bytes(columns[2])[0], self.width)

    def feed(self, columns: list[pa.Array]) -> None:
        for k in range(0, len(columns[1]), SLICE):
            for node, text in zip(columns[1].slice(k, SLICE).to_pylist(), _bytes(columns[2].slice(k, SLICE)), strict=True):
                other = shingles(text, self.width)
                if (self.limit.numerator + self.limit.denominator) * len(self.own & other) >= self.limit.numerator * (len(self.own) + len(other)):
                    self.found.append((node, self.node))

    def end(self) -> pa.RecordBatch:
        return _links(self.found)


class _Block:
    """Links that join the components of one bucket's texts, a block of them with another."""

    def __init__(self, width: int, limit: Fraction):
        self.width, self.limit, self.found = width, limit, []
        self.held: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        self.parent: dict[int, int] = {}

    def _sets(self, columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Nodes, roots and sorted sets, ``SLICE`` texts at a time; within a process equal shingles have equal hashes."""
        for k in range(0, len(columns[1]), SLICE):
            own = [shingles(t, self.width) for t in _bytes(columns[3].slice(k, SLICE))]
            yield columns[1].slice(k, SLICE).to_numpy(), columns[2].slice(k, SLICE).to_numpy(), [np.sort(np.fromiter(map(hash, x), np.int64, len(x))) for x in own]

    def _root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def ask(self, columns: list[pa.Array]) -> None:
        self.held += self._sets(columns)

    def feed(self, columns: list[pa.Array]) -> None:
        for node, root, sets in self._sets(columns):
            for own, base, held in self.held:
                left, right = np.array([self._root(x) for x in base.tolist()]), np.array([self._root(x) for x in root.tolist()])
                apart = (left[:, None] != right) & (own[:, None] < node)
                if apart.any():
                    self._compare(apart, own, base, held, node, root, sets)

    def _compare(self, apart: np.ndarray, own, base, held, node, root, sets) -> None:
        sizes = np.array([len(x) for x in held])[:, None] + np.array([len(x) for x in sets])
        p, q = self.limit.numerator, self.limit.denominator
        near = apart & ((p + q) * _common(held, sets) >= p * sizes)
        for a, b in zip(*np.nonzero(near), strict=True):
            x, y = self._root(int(base[a])), self._root(int(root[b]))
            if x != y:
                self.parent[x] = y
                self.found.append((int(own[a]), int(node[b])))

    def end(self) -> pa.RecordBatch:
        return _links(self.found)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets on the left shares with each on the right."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    at = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    place = [np.searchsorted(both, v) for v in (a, b)]
    has = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == v) for p, v in zip(place, (a, b), strict=True)] if len(both) else None
    for k in range(0, len(both), _COLUMNS):
        marks = []
        for j, n in enumerate((len(left), len(right))):
            own = has[j] & (place[j] >= k) & (place[j] < k + _COLUMNS)
            marks.append(np.zeros((n, min(_COLUMNS, len(both) - k)), np.float32))
            marks[j][at[j][own], place[j][own] - k] = 1
        out += marks[0] @ marks[1].T
    return out.astype(np.int64)
