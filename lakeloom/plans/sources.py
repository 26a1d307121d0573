"""Scans and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.query import Query
from lakeloom.sources.files import read_table, write_table
from lakeloom.sources.jsonl import JsonLinesSource
from lakeloom.sources.log import LogSource
from lakeloom.sources.shared import scratch
from lakeloom.sources.tables import table

TABLES = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey",
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id",
}


def scan_tables(spark, sf_dir):
    """Rows of every table, and the distinct values and the extremes of its key."""

    def summary(t: str) -> DataFrame:
        own = table(spark, sf_dir, t)
        key = F.col(TABLES[t])
        return own.agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.min(key).cast("long").alias("low"), F.max(key).cast("long").alias("high"))

    return reduce(DataFrame.unionAll, [summary(t) for t in TABLES])


def _round_trip(kind: str):
    def run(spark, sf_dir):
        own = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
        path = scratch(spark, "files") + "/rows"
        if kind == "text":
            write_table(own.select(F.concat_ws("|", "c_custkey", "c_name").alias("value")), path, kind)
            parts = F.split("value", r"\|")
            return read_table(spark, path, kind).select(parts[0].cast("long").alias("c_custkey"), parts[1].alias("c_name"))
        write_table(own, path, kind)
        return read_table(spark, path, kind, "c_custkey long, c_name string, c_acctbal double")

    return run


def python_source(spark, sf_dir):
    """Purchases of some users by the source in Python, which takes both filters over and skips row groups by them."""
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    events = spark.read.format(LogSource.name()).option("path", path).option("columns", "event_id,user_id,event_type,value").load()
    return events.where("event_type = 'purchase' and user_id < 1000000 and value > 10").select("event_id", "user_id", "value")


def jsonl_round_trip(spark, sf_dir):
    """Customers written and read by a source in Python, in a folder that every task can open."""
    spark.dataSource.register(JsonLinesSource)
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = scratch(spark, "jsonl").removeprefix("file://")
    own.write.format(JsonLinesSource.name()).mode("append").save(path)
    return spark.read.format(JsonLinesSource.name()).schema(own.schema).load(path)


_WHOLE = "SELECT c_custkey, c_name, c_acctbal FROM customer"

QUERIES = {
    "scan_tables": Query(scan_tables, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, count(DISTINCT {k}) AS keys, min({k})::bigint AS low, max({k})::bigint AS high FROM {t}" for t, k in TABLES.items())),
    "csv_round_trip": Query(_round_trip("csv"), _WHOLE),
    "json_round_trip": Query(_round_trip("json"), _WHOLE),
    "orc_round_trip": Query(_round_trip("orc"), _WHOLE),
    "jsonl_round_trip": Query(jsonl_round_trip, _WHOLE),
    "text_round_trip": Query(_round_trip("text"), "SELECT c_custkey, c_name FROM customer"),
    "python_source": Query(python_source, "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND user_id < 1000000 AND value > 10"),
}
