"""Streaming queries: each runs its stream over all of ``events`` and returns what came out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import scratch_dir
from lodestone.streaming import events as ev

from . import model as m

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return put


def _events(spark: SparkSession, d: str, files_per_trigger: int | None = 16) -> DataFrame:
    e = ev.source(spark, f"{d}/events.parquet", m.table(spark, d, "events"), files_per_trigger)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_timeline", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS bucket, count(*) AS n FROM events GROUP BY 1")
def stream_timeline(spark, d):
    return ev.drain(ev.timeline(_events(spark, d)), "complete", scratch_dir(spark)).withColumn("bucket", F.unix_seconds("bucket"))


@query("stream_trailing_hour", "SELECT epoch(u)::BIGINT AS until, count(*) AS n FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 15 MINUTES, ts) + INTERVAL 15 MINUTES, time_bucket(INTERVAL 15 MINUTES, ts) + INTERVAL 60 MINUTES, INTERVAL 15 MINUTES)) AS u FROM events) GROUP BY 1")
def stream_trailing(spark, d):
    return ev.drain(ev.trailing(_events(spark, d)), "complete", scratch_dir(spark)).withColumn("until", F.unix_seconds("until"))


@query("stream_error_window", """SELECT cc_pair_id, epoch(u)::BIGINT AS until, count(*) AS n FROM (
  SELECT user_id % 20 + 101 AS cc_pair_id, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 24 HOURS, INTERVAL 1 HOUR)) AS u
  FROM events WHERE event_type = 'error') GROUP BY ALL""")
def stream_error_window(spark, d):
    """Failures of each pair in the 24 hours up to every full hour; one batch, as files need not be in the order of time."""
    errors = _events(spark, d, None).filter("event_type = 'error'").select((F.col("user_id") % 20 + 101).alias("cc_pair_id"), "ts")
    return ev.drain(ev.trailing_by(errors, "cc_pair_id"), "complete", scratch_dir(spark)).withColumn("until", F.unix_seconds("until"))


@query("stream_sessions", "SELECT user_id, floor(epoch(min(ts)))::BIGINT AS first, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 45 MINUTES THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s")
def stream_sessions(spark, d):
    e = _events(spark, d, None)  # one batch: a session's rows may be late by any time, and late rows are left out
    return ev.drain(ev.sessions(e, "user_id"), "complete", scratch_dir(spark)).select("user_id", F.unix_seconds("first").alias("first"), "n")


@query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, d):
    e = _events(spark, d, None)  # one batch: files need not be in the order of time
    return ev.drain(ev.deduplicated(e.union(e), "event_id"), "append", scratch_dir(spark)).select("event_id")


@query("stream_grace_timers", "SELECT user_id, min(ts) + INTERVAL 24 HOURS AS due_at FROM events WHERE event_type = 'error' GROUP BY user_id HAVING epoch_ms(min(ts)) + 86400000 < (SELECT epoch_ms(max(ts)) FROM events WHERE event_type = 'error')")
def stream_grace(spark, d):
    return ev.drain(ev.grace_timers(_events(spark, d, None).filter("event_type = 'error'").select("user_id", "ts"), "user_id", "ts", 24), "append", scratch_dir(spark))
