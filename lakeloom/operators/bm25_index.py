"""BM25 over an inverted index on disk: postings in blocks with their maxima, top k by skipping blocks (Ding and Suel, 2011)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.text import tokens
from lakeloom.sources.shared import scratch, stage

#: Documents of a block and blocks of a shard, as powers of two, and folders by term that the blocks' maxima are in.
BLOCK_BITS, SHARD_BITS, BUCKETS = 7, 9, 64
#: Blocks of the highest bounds that are scored first, and blocks up to which the rest is named to the scan one by one.
FIRST, NAMED = 16, 4096
#: Documents that a task inverts at a time, and those of a block that isn't whole.
HELD = 1024


@dataclass(frozen=True)
class Index:
    """Where an index is, how many documents it has and how many tokens these have on average.

    ``postings`` has by shard a row for each term of each block: the
    documents' places in the block, how often they have the term, and their
    lengths. The row of the empty term has the ids of all documents of the
    block. ``blocks`` has (term, block, n, peak) by bucket of the term: in how
    many documents it is, and the most that it adds to a score, but for the
    inverse document frequency.
    """

    folder: str
    documents: int
    mean: float
    k1: float
    b: float
    id_kind: str
    shard_bits: int

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{_ROW}, ids array<{self.id_kind}>, shard long").parquet(f"{self.folder}/postings")

    def weight(self, f: Column, length: Column) -> Column:
        return f.cast("double") * (self.k1 + 1) / (f.cast("double") + self.k1 * ((1 - self.b) + self.b * length.cast("double") / self.mean))


_ROW = "term string, block long, places array<int>, often array<int>, lengths array<int>"


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _invert(bits: int, shard_bits: int):
    """Rows of ``postings``, shard last, from (number, id, tokens) by ascending number."""

    def inverted(batch: pa.RecordBatch) -> pa.RecordBatch:
        number, tokens_ = batch.column(0).to_numpy(), batch.column(2)
        lengths = np.diff(tokens_.offsets.to_numpy())
        flat = tokens_.flatten().dictionary_encode()
        blocks, at = np.unique(number >> bits, return_inverse=True)
        row = np.repeat(np.arange(len(number)), lengths)
        key, often = np.unique((at[row] * len(flat.dictionary) + flat.indices.to_numpy()) * len(number) + row, return_counts=True)
        group, row = key // len(number), key % len(number)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
        edges = pa.array(np.concatenate((first, [len(group)])).astype(np.int32))
        lists = lambda e, v: pa.ListArray.from_arrays(e, pa.array(v.astype(np.int32)))
        terms = flat.dictionary.take(pa.array(group[first] % max(1, len(flat.dictionary))))
        own = blocks[group[first] // max(1, len(flat.dictionary))]
        place = number & ((1 << bits) - 1)
        ids = pa.nulls(len(first), pa.list_(batch.column(1).type))
        columns = [terms, own, lists(edges, place[row]), lists(edges, often), lists(edges, lengths[row]), ids]
        start = pa.array(np.searchsorted(at, np.arange(len(blocks) + 1)).astype(np.int32))
        whole = [pa.array([""] * len(blocks), pa.string()), blocks, lists(start, place), lists(start, lengths), lists(start, lengths), pa.ListArray.from_arrays(start, batch.column(1))]
        both = [pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in pair]) for pair in zip(columns, whole, strict=True)]
        both.append(pa.array(both[1].to_numpy() >> shard_bits))
        return pa.RecordBatch.from_arrays(both, ["term", "block", "places", "often", "lengths", "ids", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for k in range(0, batch.num_rows, HELD):
                more = pa.Table.from_batches([batch.slice(k, HELD)])
                held = pa.concat_tables([held, more]) if held is not None else more
                block = held.column(0).to_numpy() >> bits
                done = int(np.searchsorted(block, block[-1]))  # the last block may go on
                if done:
                    yield inverted(held.slice(0, done).combine_chunks().to_batches()[0])
                    held = held.slice(done)
        if held is not None and held.num_rows:
            yield inverted(held.combine_chunks().to_batches()[0])

    return run


def build(docs: DataFrame, folder: str | None = None, *, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Indexes every token of every document; ``folder`` defaults to one in the shared scratch folder.

    Documents get numbers task by task; 2**BLOCK_BITS of them in a row are a
    block, and so many blocks a shard. A task inverts its own blocks and
    writes its own shards, sorted by term, so texts are read once and
    postings aren't exchanged; a word that every document has is a row for
    each block. Only the blocks' maxima are sorted by term. Null and empty
    texts have no token and aren't indexed; rows whose id repeats are
    documents of their own.
    """
    spark, id_kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    folder = folder or scratch(spark, "index")
    index = Index(folder, 0, 1.0, k1, b, id_kind, SHARD_BITS)
    number = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    rows = number.mapInArrow(_invert(BLOCK_BITS, SHARD_BITS), f"{_ROW}, ids array<{id_kind}>, shard long")
    rows.sortWithinPartitions("shard", "term", "block").write.partitionBy("shard").option("parquet.block.size", 4 << 20).parquet(f"{folder}/postings")
    whole = index.postings(spark).where("term = ''").agg(F.sum(F.size("places")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    index = Index(folder, whole[0] or 0, whole[1] / whole[0] if whole[0] else 1.0, k1, b, id_kind, SHARD_BITS)
    peak = F.array_max(F.zip_with("often", "lengths", index.weight))
    peaks = index.postings(spark).where("term <> ''").select("term", "block", F.size("often").alias("n"), peak.alias("peak"))
    bucket = (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int")
    peaks = peaks.repartitionByRange(bucket, F.col("term"), F.col("block")).withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "block")
    peaks.write.partitionBy("bucket").parquet(f"{folder}/blocks")
    return index


def _sum(terms: list[str], idf: dict[str, float], value: str) -> Column:
    """Of a group's rows the terms' values times their weights, added in one fixed order, so that greater values never have a lesser sum."""
    return reduce(lambda a, x: a + x, [F.coalesce(F.max(F.when(F.col("term") == t, F.col(value))), F.lit(0.0)) * F.lit(idf[t]) for t in terms])


def topk(spark: SparkSession, index: Index, terms: list[str], k: int = 10, *, digits: int | None = None) -> DataFrame:
    """``(id, score)``: the k documents of the highest scores, ties by id, the same as ranking all of them.

    A block's bound is the sum of its terms' peaks. The ``FIRST`` (or k)
    blocks of the highest bounds are scored; then only those whose bound
    reaches the k-th best score found. No other posting is read: folders of
    shards, row groups and pages of other blocks and terms are passed over.
    ``digits`` rounds scores before they are ranked. Absent terms add
    nothing, repeated ones count once; an empty index gives no rows.
    """
    terms = sorted({t.lower() for t in terms})
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    peaks = spark.read.schema("term string, block long, n int, peak double, bucket int").parquet(f"{index.folder}/blocks")
    peaks = stage(peaks.where(F.col("bucket").isin([_bucket(t) for t in terms]) & F.col("term").isin(terms)), "peaks")
    often = {r.term: r.n for r in peaks.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term asked
    idf = {r.term: r.idf for r in spark.createDataFrame([(t, float(d)) for t, d in often.items()], "term string, d double").select("term", F.log(1 + (F.lit(float(index.documents)) - F.col("d") + 0.5) / (F.col("d") + 0.5)).alias("idf")).collect()}
    terms = [t for t in terms if t in idf]
    if not terms:
        return spark.createDataFrame([], f"id {index.id_kind}, score double")
    bounds = stage(peaks.groupBy("block").agg(_sum(terms, idf, "peak").alias("bound")), "bounds")

    def scored(own: DataFrame) -> DataFrame:
        one = own.where(F.col("term").isin(terms)).select("term", "block", F.explode(F.arrays_zip("places", "often", "lengths")).alias("p"))
        one = one.select("term", "block", "p.places", index.weight(F.col("p.often"), F.col("p.lengths")).alias("w"))
        score = one.groupBy("block", "places").agg(rounded(_sum(terms, idf, "w")).alias("score"))
        ids = own.where("term = ''").select(F.col("block").alias("of"), F.explode(F.arrays_zip("places", "ids")).alias("d")).select("of", F.col("d.places").alias("at"), F.col("d.ids").alias("id"))
        return score.join(ids, (F.col("block") == F.col("of")) & (F.col("places") == F.col("at"))).select("id", "score")

    def named(blocks: list) -> DataFrame:
        by_place = F.col("shard").isin(sorted({r.block >> index.shard_bits for r in blocks})) & F.col("block").isin(sorted({r.block for r in blocks}))
        return index.postings(spark).where(by_place)

    begun = bounds.orderBy(F.desc("bound"), "block").limit(max(FIRST, k)).collect()
    found = stage(scored(named(begun)), "found")
    last = found.orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
    rest = bounds if last.n < k else bounds.where(rounded(F.col("bound")) >= F.lit(last.score))
    rest = rest.where(~F.col("block").isin([r.block for r in begun]))
    left = rest.limit(NAMED + 1).select("block").collect()
    if len(left) > NAMED:
        found = found.unionByName(scored(index.postings(spark).join(rest.select("block"), "block", "left_semi")))
    elif left:
        found = found.unionByName(scored(named(left)))
    return found.orderBy(F.desc("score"), "id").limit(k).select("id", "score")
