"""Tables laid out for keyset pages: sorted files and the last row of each, so a page opens the files its cursor names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.cursor import SORTS, Cursor, after, ordering, parse_sort


def write_sorted(rows: DataFrame, path: str, sort: str, files: int | None = None) -> None:
    """Write ``rows`` (with ``id`` and the sort's key) in the order of ``sort``: files by ranges, rows in order, and an index with one row a file.

    Spark chooses the number of files by their size unless it is given.
    """
    sort = parse_sort(sort)
    key = SORTS[sort][0] or "id"
    dealt = rows.repartitionByRange(*([files] if files else []), *ordering(sort))
    placed = dealt.sortWithinPartitions(*ordering(sort)).withColumn("_place", F.monotonically_increasing_id())
    placed.write.option("compression", "zstd").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    last = F.max_by(F.struct(F.col(key).alias("key"), F.col("id")), "_place").alias("last")
    index = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("_place").alias("place"), F.count("*").alias("n"), last)
    index.select("file", "place", "n", F.col("last.key").alias("key"), F.col("last.id").alias("id")).coalesce(1).sortWithinPartitions("place").write.parquet(f"{path}/files")


def files_of(spark: SparkSession, path: str, sort: str, cursor: str | None, limit: int) -> list[str]:
    """The files that hold the page after ``cursor``: the one it ends in or stands before, and as many more as the page needs."""
    sort = parse_sort(sort)
    key = SORTS[sort][0]
    index = spark.read.parquet(f"{path}/files")
    index = index.drop("key") if key is None else index.withColumnRenamed("key", key)
    index = index if cursor is None else index.filter(after(Cursor.decode(cursor, sort)))
    found, rows = [], 0
    for r in index.orderBy("place").limit(limit + 1).collect():  # each file holds a row at least
        found.append(r["file"])
        rows += r["n"] if cursor is None or len(found) > 1 else 1
        if rows >= limit + (cursor is not None):
            break
    return found


def page(spark: SparkSession, path: str, sort: str, cursor: str | None = None, limit: int = 50) -> DataFrame:
    """The ``limit`` rows after ``cursor``, in order."""
    sort = parse_sort(sort)
    everything = spark.read.parquet(f"{path}/rows")
    files = files_of(spark, path, sort, cursor, limit)
    rows = spark.read.schema(everything.schema).parquet(*files) if files else everything.limit(0)
    rows = rows if cursor is None else rows.filter(after(Cursor.decode(cursor, sort)))
    return rows.orderBy("_place").limit(limit).drop("_place")
