"""A stream as the writer of a versioned table: every batch is merged once, however often it is played."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestone.sources.versions import Tables


def upsert_stream(stream: DataFrame, tables: Tables, name: str, keys: list[str], order: list[str], checkpoint: str, writer: str = "stream") -> None:
    """Merge all rows there are into the table ``name``; the greatest row by ``order`` of each key stays.

    Spark plays a batch again after a failure, with the same number.  Its number is committed
    with its rows, so a batch that was merged before the failure is left out.
    """
    def merge(batch: DataFrame, number: int) -> None:
        tables.upsert(name, batch, keys, order, (f"{writer}/{name}", number))

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
