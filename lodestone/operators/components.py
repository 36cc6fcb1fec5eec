"""Connected components of links, without a task that holds a hub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import keep


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of (a, b) that has a neighbour, with the least node it is connected to.

    Alternating star steps.  Each is a grouped minimum, combined before the shuffle and
    written, and a join of two plain tables, which Spark splits at a node with many links.
    """
    def step(now: DataFrame, large: bool) -> DataFrame:
        both = now.union(now.select("b", "a")) if large else now
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "component-minima")
        moved = both.join(low, "a")
        if large:
            return moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.filter("a <> m").select("a", F.col("m").alias("b")))

    down = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, before = keep(down.distinct(), "component-links"), None
    while True:
        now = keep(step(now, True).distinct(), "component-large")
        now = keep(step(now, False).filter("a <> b").distinct(), "component-small")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = seen
