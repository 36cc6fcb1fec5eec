"""Crawl telemetry: attempts, stalls, rates, timelines, facets, per-source counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALL_MINUTES = 45
PARKED = ("first-pass already complete", "park done")
RUNNING = "IN_PROGRESS"


def at(now: datetime | str) -> Column:
    return F.lit(now).cast("timestamp")


def parked(error: Column) -> Column:
    return F.coalesce(error.contains(PARKED[0]) | error.contains(PARKED[1]), F.lit(False))


def with_progress(attempts: DataFrame, now: datetime | str) -> DataFrame:
    """Add ``stalled`` and ``pages_per_min`` (null unless running for over 0.05 minutes)."""
    seconds = lambda c: c.cast("double")
    quiet = seconds(at(now)) - seconds(F.coalesce("last_heartbeat_time", "time_updated"))
    minutes = (seconds(at(now)) - seconds(F.col("time_started"))) / 60
    docs = F.coalesce("total_docs_indexed", "new_docs_indexed")
    running = F.col("status") == RUNNING
    return attempts.withColumn("stalled", running & (quiet > STALL_MINUTES * 60)).withColumn(
        "pages_per_min", F.when(running & (minutes > 0.05), F.round(docs / minutes, 2)))


def list_attempts(attempts: DataFrame, now: datetime | str, cc_pair_id: int | None = None, statuses: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    df = attempts if cc_pair_id is None else attempts.filter(F.col("cc_pair_id") == cc_pair_id)
    if statuses:
        df = df.filter(F.upper("status").isin(*[s.upper() for s in statuses]))
    df = with_progress(df, now).orderBy(F.col("time_created").desc(), F.col("id").desc())
    return df if limit is None else df.limit(limit)


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """One row a cc-pair: its latest attempt."""
    fields = F.struct("time_updated", "id", "status", "error_msg")
    return attempts.groupBy("cc_pair_id").agg(F.max(fields).alias("a")).select("cc_pair_id", "a.*")


def fleet_summary(pairs: DataFrame, connectors: DataFrame, attribution: DataFrame, attempts: DataFrame) -> DataFrame:
    """cc-pairs with display name, documents, latest attempt and whether parked; most documents first."""
    counts = attribution.groupBy("connector_id", "credential_id").agg(F.count("*").alias("doc_count"))
    last = latest_attempts(attempts).select(F.col("cc_pair_id").alias("id"), F.col("status").alias("last_status"), F.col("error_msg").alias("last_error"))
    named = pairs.join(connectors.select(F.col("id").alias("connector_id"), F.col("name").alias("connector_name"), "source"), "connector_id")
    rows = named.join(counts, ["connector_id", "credential_id"], "left").join(last, "id", "left")
    return rows.select(
        F.col("id").alias("cc_pair_id"), F.when(F.trim("name") == "", F.col("connector_name")).otherwise(F.col("name")).alias("display_name"), "source", "status",
        F.coalesce("doc_count", F.lit(0)).alias("doc_count"), "last_status", parked(F.col("last_error")).alias("parked"),
    ).orderBy(F.col("doc_count").desc(), "cc_pair_id")


def status_counts(attempts: DataFrame, by: str | None = None) -> DataFrame:
    """Counts by status in fixed columns; both spellings of cancelled are one, others are ``other``."""
    s = F.upper("status")
    names = {"success": ["SUCCESS"], "failed": ["FAILED"], "in_progress": [RUNNING], "canceled": ["CANCELED", "CANCELLED"]}
    known = [x for v in names.values() for x in v]
    aggs = [F.count_if(s.isin(*v)).alias(k) for k, v in names.items()] + [F.count_if(~s.isin(*known)).alias("other")]
    return (attempts.groupBy(by) if by else attempts.groupBy()).agg(*aggs, F.count("*").alias("total"), F.min(F.when(s == RUNNING, F.col("time_created"))).alias("oldest_running"))


def daily_history(attempts: DataFrame, cc_pair_id: int) -> DataFrame:
    """New documents by day, days without attempts left out."""
    day = F.date_format(F.date_trunc("day", "time_created"), "yyyy-MM-dd").alias("day")
    return attempts.filter(F.col("cc_pair_id") == cc_pair_id).groupBy(day).agg(F.sum(F.coalesce("new_docs_indexed", F.lit(0))).alias("docs"), F.count("*").alias("attempts")).orderBy("day")


def timeline(events: DataFrame, ts: str, now: datetime | str, window: str = "24h", bucket: str = "1h") -> DataFrame:
    """Counts per bucket over the window before ``now``, empty buckets as zero."""
    span = {"24h": "1 day", "7d": "7 days", "30d": "30 days"}[window]
    unit, step = {"1h": ("hour", "1 hour"), "1d": ("day", "1 day")}[bucket]
    one = events.sparkSession.range(1)
    start, end = F.date_trunc(unit, at(now) - F.expr(f"INTERVAL {span}")), F.date_trunc(unit, at(now))
    calendar = one.select(F.explode(F.sequence(start, end, F.expr(f"INTERVAL {step}"))).alias("bucket"))
    counted = events.filter((F.col(ts) >= start) & (F.col(ts) < end + F.expr(f"INTERVAL {step}"))).groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.count("*").alias("n"))
    return calendar.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n")).orderBy("bucket")


def recent_counts(events: DataFrame, ts: str, now: datetime | str, minutes: tuple[int, ...] = (15, 1440)) -> DataFrame:
    """How many events the last so many minutes hold, in one pass."""
    return events.agg(*[F.count_if((F.col(ts) > at(now) - F.expr(f"INTERVAL {m} MINUTES")) & (F.col(ts) <= at(now))).alias(f"last_{m}_min") for m in minutes])


def sources(documents: DataFrame, attribution: DataFrame, connectors: DataFrame) -> DataFrame:
    """Distinct connectors and documents of each source."""
    own = connectors.select(F.col("id").alias("connector_id"), "source").join(attribution, "connector_id", "left")
    return own.groupBy("source").agg(F.countDistinct("connector_id").alias("connectors"), F.countDistinct("id").alias("documents")).orderBy(F.col("documents").desc(), "source")


def facets(tags: DataFrame, prefix: str | None = None, key: str | None = None, limit: int = 100) -> DataFrame:
    """Documents by tag, most first."""
    df = tags if key is None else tags.filter(F.col("tag_key") == key)
    if prefix:
        df = df.filter(F.lower("tag_value").startswith(prefix.replace("%", "").replace("_", "").lower()))
    return df.groupBy("tag_key", "tag_value").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag_key", "tag_value").limit(limit)


def facet_keys(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag_key").agg(F.countDistinct("tag_value").alias("n_values")).orderBy("tag_key")


def busy_pairs(attempts: DataFrame) -> DataFrame:
    return attempts.filter(F.col("status") == RUNNING).select("cc_pair_id").distinct()


def stall_sessions(events: DataFrame, key: str, ts: str, gap_minutes: int = STALL_MINUTES) -> DataFrame:
    """Stretches of activity without a gap of ``gap_minutes``, by key."""
    w = Window.partitionBy(key).orderBy(ts)
    fresh = F.col(ts).cast("double") - F.lag(F.col(ts).cast("double")).over(w) >= gap_minutes * 60
    numbered = events.withColumn("_fresh", F.coalesce(fresh.cast("int"), F.lit(0)))
    numbered = numbered.withColumn("session", F.sum("_fresh").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))


def nearest_rank(df: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """The ceil(q n)-th value for each share q."""
    return df.agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})").alias(f"p{q * 100:g}".replace(".", "_")) for q in shares])
