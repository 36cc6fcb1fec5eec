"""Dealing out small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it comes in fewer partitions with rows than there are cores.

    A plan of many partitions is left alone without a look, so nothing large is ever
    read or shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > 8 * cores:
        return df
    parts = df.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count()
    return df.repartition(cores) if parts < cores else df
