"""SimHash fingerprints and near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import LOWER, slices, spare, stage, utf8
from lakeloom.operators.components import components

#: Words of a shingle.
WIDTH = 3
#: Differing bits up to which two fingerprints link.
RADIUS = 3
#: Distinct fingerprints of one bucket that a task compares at a time.
BLOCK = 512
_SEED = 42
_LOW = (1 << 32) - 1


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit fingerprint over shingles of ``width`` words.

    Words are runs of anything but ASCII white space, after A-Z are
    lower-cased. A text of fewer words is one shingle, one of none is 0. A
    bit is set if it is set in over half of the shingles' XXH64 values.
    """
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        return _majority([xxhash.xxh64_intdigest(b" ".join(words), _SEED)])
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return _majority([digest(joined[a:b], _SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])


def _majority(hashes: list[int]) -> int:
    values, counts = np.array(hashes, "<u8"), np.zeros(64, np.int64)
    for start in range(0, len(values), 8192):
        part = values[start : start + 8192]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fp", width: int = WIDTH) -> DataFrame:
    """``docs`` with each text's fingerprint as a signed long; a column of that name is replaced.

    A null text has fingerprint 0.
    """
    own = docs.drop(name).withColumn(name, F.lit(0).cast("long"))
    at = own.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint(t, width) for t in utf8(part.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fps)], schema=part.schema)

    return own.mapInArrow(run, own.schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)``, a row for each row of ``docs``."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_fingerprints(own, width=width).select("doc_id", "fp")


def _group_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """(member, least) for all but the least of each component of ``fps``."""
    if len(fps) == 2:
        a, b = sorted(map(int, fps))
        return [(b, a)] if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= RADIUS else []
    left, out = np.unique(fps), []
    while len(left) > 1:
        least, front, left = int(left[0]), left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for x in front:
                near |= np.bitwise_count((left ^ x).view(np.uint64)) <= RADIUS
            front, left = left[near], left[~near]
            out += [(int(x), least) for x in front]
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each (key, i, j) group; the rows come sorted by these."""
    held: list[np.ndarray] = []
    mark = None

    def flush() -> list[tuple[int, int]]:
        return _group_links(np.concatenate(held)) if held else []

    for batch in batches:
        key, i, j, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        out: list[tuple[int, int]] = []
        for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if b > a:
                if (now := (key[a], i[a], j[a])) != mark:
                    out += flush()
                    held, mark = [], now
                held.append(fp[a:b])
        yield _edges(out)
    yield _edges(flush())


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["u", "v"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that join all fingerprints within ``RADIUS`` bits.

    Multi-index hashing over two segments of 32 bits: of three differing
    bits, one segment has at most one. Each fingerprint is filed under both
    segments and looks up the Hamming ball of radius 1 around each. A pair
    whose segments differ in a bit is found from the side where that bit is
    0, so half of the ball is enough. Lookups that meet no table key are
    dropped before anything is gathered. A bucket is compared in blocks of
    about ``BLOCK`` fingerprints, each pair of blocks in a group of its own,
    which verifies whole distances and returns a spanning forest: no group
    grows with the data and no bucket is expanded into its pairs.
    """
    masks = F.array(*[F.lit(1 << k) for k in range(32)])
    low, high = F.col("fp").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned("fp", 32)
    tag = F.lit(1 << 32)

    def ball(segment: Column) -> Column:
        return F.filter(F.transform(masks, lambda m: segment.bitwiseOR(m)), lambda x: x != segment)

    filed = distinct.select(F.explode(F.array(low, high.bitwiseOR(tag))).alias("key"), "fp")
    probes = distinct.select(F.explode(F.concat(ball(low), F.transform(ball(high), lambda x: x.bitwiseOR(tag)))).alias("key"), "fp")
    met = stage(probes.join(filed.select("key"), "key", "left_semi"), "met")
    entries = filed.unionByName(met)
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        entries.join(sizes, "key")
        .withColumn("nb", blocks)
        .withColumn("b", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "fp")
    )
    grouped = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return grouped.mapInArrow(_bucket_links, "u long, v long")


def _rooted(fps: DataFrame, rep: Column) -> DataFrame:
    """``(fp, rep, root)``: the least ``rep`` of each fingerprint's rows and the least fingerprint of its component."""
    classes = stage(fps.groupBy("fp").agg(F.min(rep).alias("rep")), "classes")
    roots = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp, component_id)``, a row for each row of ``docs``.

    ``component_id`` is the smallest id among the documents whose
    fingerprints can be reached by links of ``RADIUS`` bits or fewer. Equal
    fingerprints are one class, so copies never multiply. Texts without words
    share fingerprint 0 and link like any other. Null ids never name a
    component unless it has no other id; then ``component_id`` is null.
    Repeated rows have a row each; long texts are hashed whole; an empty
    table gives no rows; other columns aren't used, whatever their names.
    """
    fps = stage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    rooted = _rooted(fps, F.col("doc_id"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(by_class, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH) -> DataFrame:
    """Of each component of ``docs`` one row, all its columns kept: the one of least (id, text hash), null ids last.

    Rows are told apart by id and text, so two texts of one id may both stay
    if nothing links them. Of rows equal in both one stays, whatever their
    other columns hold.
    """
    a, b, n, c, d = (spare(docs, x) for x in "abncd")
    own = docs.withColumns({a: F.xxhash64(text_col), b: F.xxhash64(F.lit("b"), F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull())})
    asked = own.select(F.col(id_col).alias("id"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(text_col).cast("string").alias("text"))
    fps = stage(with_fingerprints(asked, width=width).drop("text"), "fingerprints")
    rooted = _rooted(fps, F.struct(F.col("id").isNull().alias("none"), "id", "a", "b"))
    chosen = rooted.groupBy("root").agg(F.min("rep").alias("r")).select("r.a", "r.b")
    times = fps.groupBy("a", "b").agg(F.count("*").alias("n"))
    kept = stage(chosen.join(times, ["a", "b"]).select(F.col("a").alias(c), F.col("b").alias(d), F.col("n").alias(n)), "kept")
    found = own.join(kept, (F.col(a) == F.col(c)) & (F.col(b) == F.col(d))).drop(c, d)
    # Rows that occur once, nearly all, needn't be compared; copies are dropped in their tasks before they are exchanged.
    once, more = found.where(F.col(n) == 1), found.where(F.col(n) > 1).dropDuplicates([a, b])
    return once.unionByName(more).select(docs.columns)
