"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the cluster names no shared folder (single-machine tests).
LOCAL_SCRATCH = "file:///tmp/checkpoints/lodestone"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``, else the test folder, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or LOCAL_SCRATCH


#: Folders that this process has written, for ``forget``.
_KEPT: list[str] = []


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This fixes generated ids, cuts lineage and survives the loss of executors:
    the files belong to no executor.  They stay until ``forget``, as results read them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _KEPT.append(path)
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept = path
    return kept


def keep_dealt(df: DataFrame, tag: str, key: str) -> DataFrame:
    """``keep``, dealt out by ``key``: joins on it shuffle the other side only.

    ``df`` is to read kept tables, as generated ids must be fixed before they are dealt out.
    """
    spark = df.sparkSession
    name = f"{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark).rstrip('/')}/{name}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _KEPT.append(path)
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("compression", "zstd").option("path", path).saveAsTable(name)
    kept = spark.table(name)
    kept._kept = path
    return kept


def release(*frames: DataFrame) -> None:
    """Delete tables that ``keep`` returned, once all that reads them has been written itself."""
    for df in frames:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        _KEPT.remove(df._kept)


def forget(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process, once the results that read them are written; how many went."""
    gone = 0
    while _KEPT:
        at = spark._jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        gone += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return gone
