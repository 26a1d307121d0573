"""Streaming queries, each run over the whole events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.plans.query import Query
from lakeloom.plans.relational import SESSIONS_SQL
from lakeloom.sources.log import LogSource
from lakeloom.streaming import queries as streaming


def _stream(spark, sf_dir):
    return streaming.event_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet")


def tumbling(spark, sf_dir):
    """Complete mode, so that windows the watermark hasn't passed are there too."""
    out = streaming.drain(streaming.tumbling(_stream(spark, sf_dir)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 6).alias("value"))


def sliding(spark, sf_dir):
    out = streaming.drain(streaming.sliding(_stream(spark, sf_dir)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(spark, sf_dir):
    out = streaming.drain(streaming.sessions(_stream(spark, sf_dir)), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def totals(spark, sf_dir):
    out = streaming.drain(streaming.running_totals(_stream(spark, sf_dir)), "update", ("user_id",))
    return out.withColumn("value", F.round("value", 4))


def idle_users(spark, sf_dir):
    """Users silent for a day before the watermark, which stays an hour behind the last event."""
    return streaming.drain(streaming.idle_users(_stream(spark, sf_dir))).withColumn("last", F.col("last").cast("timestamp_ntz"))


def deduplicated(spark, sf_dir):
    events = _stream(spark, sf_dir)
    return streaming.drain(streaming.deduplicated(events.unionByName(events)).select("event_id", "event_type"))


def stream_join(spark, sf_dir):
    events = _stream(spark, sf_dir)
    return streaming.drain(streaming.joined(events, _stream(spark, sf_dir))).select("first_id", "second_id")


def outer_join(spark, sf_dir):
    """Purchases and the views of their user within the half hour after, or null where none came before the watermark passed."""
    events = _stream(spark, sf_dir)
    out = streaming.joined_outer(events.where("event_type = 'purchase'"), _stream(spark, sf_dir).where("event_type = 'view'"))
    return streaming.drain(out.select("first_id", "second_id"))


def funnels(spark, sf_dir):
    """View, click and purchase in order within a day, by state, so without SQL; a test has a plain version."""
    return streaming.drain(streaming.funnels(_stream(spark, sf_dir)))


def log_stream(spark, sf_dir):
    """All events by the source in Python, followed as a stream."""
    spark.dataSource.register(LogSource)
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    return streaming.drain(spark.readStream.format(LogSource.name()).option("path", path).option("columns", "event_id,event_type,value").load())


QUERIES = {
    "stream_tumbling": Query(tumbling, "SELECT date_trunc('day', ts)::timestamp AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2"),
    "stream_sliding": Query(
        sliding,
        """SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2024-01-01') - INTERVAL 12 HOURS]) AS start FROM events) GROUP BY 1, 2""",
    ),
    "stream_sessions": Query(sessions, SESSIONS_SQL),
    "stream_running_totals": Query(totals, "SELECT user_id, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY user_id"),
    "stream_idle_users": Query(
        idle_users,
        "SELECT user_id, date_trunc('millisecond', max(ts))::timestamp AS last, count(*) AS n FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    ),
    "stream_dedup": Query(deduplicated, "SELECT event_id, event_type FROM events"),
    "stream_join": Query(stream_join, "SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE"),
    "stream_outer_join": Query(
        outer_join,
        """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'),
        w AS (SELECT date_trunc('millisecond', least((SELECT max(ts) FROM p), (SELECT max(ts) FROM v))) - INTERVAL 1 HOUR AS w)
        SELECT p.event_id AS first_id, v.event_id AS second_id FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.ts > p.ts AND v.ts <= p.ts + INTERVAL 30 MINUTE, w
        WHERE v.event_id IS NOT NULL OR p.ts + INTERVAL 30 MINUTE <= w""",
    ),
    "stream_funnels": Query(funnels),
    "log_stream": Query(log_stream, "SELECT event_id, event_type, value FROM events"),
}
