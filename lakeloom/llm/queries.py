"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import byte_bpe, chat_template, decontaminate, filter_audit, hard_negatives, host_rules, langid, line_dedup, lm_scoring, packing, quality, sharding, simhash
from lakeloom.llm.common import bucket_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    profiles = langid.learn(docs.where(~held_out))
    out = langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.verdict(decontaminate.find_benchmark(docs, _table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(bucket_of(F.col("doc_id"), 3) != 1))
    out = quality.score(docs.withColumn("held_out", bucket_of(F.col("doc_id"), 3) == 1), model)
    return out.select("doc_id", "held_out", "score", "predicted")


def op5_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], own.schema)
    return chat_template.read_back(chat_template.format_conversations(own.unionByName(more)))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules of every document and the verdict by its host."""
    out = host_rules.host_verdicts(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, counts at most one apart."""
    out = sharding.assign_shards(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by word counts and by PPM."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (bucket_of(F.col("doc_id"), 5) == 1).alias("held_out"))
    model = lm_scoring.learn(docs.where("not held_out"))
    out = lm_scoring.score(docs, model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines and passages, and where these stood."""
    return _cut_figures(line_dedup.dedup_units(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def _cut_figures(out: DataFrame) -> DataFrame:
    chars = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    at = F.array_join(F.transform("removed_spans", lambda s: s["start"].cast("string")), ",")
    return out.select("doc_id", F.size("removed_spans").cast("long").alias("n_removed"), chars.alias("removed_chars"), at.alias("removed_at"), "text")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each anchor and positive the first ten rows of another label in the band of scores."""
    label = F.col("label").cast("long")
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep and remove by source, in every order."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, by digest."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.decode_ids(byte_bpe.encode_texts(docs).drop("text"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_QUERIES = (op1_best_fit_packing, op2_rank_order_langid, op3_benchmark_decontamination, op4_bradley_terry_quality, op5_chat_template, op6_host_rules, op7_ring_sharding, op8_ppm_scoring, op9_simhash_near_dedup, op10_line_dedup, op11_hard_negatives, op12_filter_audit, op13_byte_bpe)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline``, one after the other."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*_QUERIES, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": decontaminate.SQL, "op5_chat_template": chat_template.SQL, "op6_host_rules": host_rules.SQL, "op10_line_dedup": line_dedup.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_filter_audit": filter_audit.SQL}
