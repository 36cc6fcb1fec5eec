"""Structured Streaming over crawl events: timelines, sessions, dedup, trailing windows, grace timers.

Each function takes a streaming (or batch) DataFrame; ``drain`` runs a stream over
what is there and returns its rows, with the checkpoint and output in shared storage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = 16) -> DataFrame:
    """A file stream of a table (one file or a folder), so many files a micro-batch, or all in one."""
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drain(stream: DataFrame, mode: str, where: str) -> DataFrame:
    """Run the stream over all input there is; its rows, written exactly once."""
    spark, at = stream.sparkSession, f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{at}/rows")
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows")

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(replace).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def timeline(events: DataFrame, ts: str = "ts", bucket: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling counts."""
    w = F.window(ts, bucket)
    return events.withWatermark(ts, late).groupBy(w).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), "n")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "45 minutes", late: str = "1 day") -> DataFrame:
    """Activity by key without a gap; what follows a session is a stall.

    Rows behind the watermark are left out, even where all sessions are shown; over files in no
    order of time, read all of them in one batch, or set ``late`` to the span of the table.
    """
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("first"), F.col("w.end").alias("stalled_at"), "n")


def deduplicated(events: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first arrival of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def trailing(events: DataFrame, ts: str = "ts", length: str = "1 hour", step: str = "15 minutes", late: str = "1 day") -> DataFrame:
    """Counts over a sliding window, for rate budgets."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, step)).agg(F.count("*").alias("n")).select(F.col("window.end").alias("until"), "n")


def trailing_by(events: DataFrame, key: str, ts: str = "ts", length: str = "24 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by key over a sliding window: what failed in the last day, hour by hour."""
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, length, step)).agg(F.count("*").alias("n")).select(key, F.col("window.end").alias("until"), "n")


def grace_timers(staged: DataFrame, key: str, ts: str, grace_hours: int) -> DataFrame:
    """(key, due_at) once a document's grace has passed in event time, by state with a timeout."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def each(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (due,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "due_at": [pd.Timestamp(due, unit="us")]})
            return
        first = min(int(b["_at"].min()) for b in batches)
        due = min(first + grace_hours * 3_600_000_000, state.get[0]) if state.exists else first + grace_hours * 3_600_000_000
        state.update((due,))
        state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [], "due_at": pd.Series([], dtype="datetime64[us]")})

    kind = staged.schema[key].dataType.simpleString()
    rows = staged.withWatermark(ts, "0 seconds").withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    return rows.groupBy(key).applyInPandasWithState(each, f"{key} {kind}, due_at timestamp", "due long", "append", GroupStateTimeout.EventTimeTimeout)
