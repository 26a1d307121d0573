"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each result as Parquet to the shared folder and gives it to the next.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontaminate, line_dedup, packing, quality, simhash
from lakeloom.llm.common import bucket_of
from lakeloom.operators import minhash
from lakeloom.sources.shared import cleared, stage, unstage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking accepts.

    It is fitted to the labels of documents whose crc32 modulo 3 isn't 1, as
    in the operator's own query, and judges every document by its text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels.where(bucket_of(F.col("doc_id"), 3) != 1))
    return quality.score(docs.select(COLUMNS), model).where("predicted = 1").select(COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by shingles of five words the document with the smallest id.

    Three differing bits find copies and little else, so of the documents
    that SimHash leaves, those of a Jaccard similarity of 0.8 or more are
    found by MinHash and checked.
    """
    with cleared(spark) as keep:  # it is read three times
        left = keep(stage(simhash.one_of_each(docs.select(COLUMNS), width=5), "simhash"))
    return minhash.one_of_each(left)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that an earlier document has; ``n_chars`` follows.

    A document of which nothing is left goes.
    """
    out = line_dedup.dedup_units(docs.select(COLUMNS))
    left = F.size("removed_spans").eqNullSafe(F.lit(0)) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(left).withColumn("n_chars", F.when(F.size("removed_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    found = decontaminate.find_benchmark(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.verdict(found).where("not contaminated").select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("substring dedup", line_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the ranking, the fingerprints or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, all stages applied to ``documents``.

    What a stage stages on its way goes when its result is written, and that
    when the next one's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, apply in STAGES[:-1]:
        with cleared(spark) as keep:
            docs = keep(stage(apply(spark, docs, sf_dir), name.replace(" ", "-")))
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
