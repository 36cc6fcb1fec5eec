"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Each source asks for a share of all words in proportion to its weight, clamped at
``max_epochs`` times its own words; what a clamp frees goes to the other sources
by weight, again and again until no share is above its clamp.  Only three sums a
round reach the driver.

A source whose target is q whole passes and a remainder takes every document q
times, and once more the documents that come first in a seeded order until the
remainder is used up; the document at the border goes in if that is the nearer
choice.  The running sum is taken in four steps, over groups of buckets of the order,
buckets, slices of an id's rows, and rows, so no task holds a whole source, nor all
rows of one id.

Edge cases: null text has size 0; null is a source of its own, ranked last; a
very long text goes in or stays out whole; extra columns are ignored, whatever their names; a
source without words has target 0; rows that repeat a doc_id count separately; an
empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)
SEED = 42
#: Rows that one bucket of a source's seeded order holds on average, at most.
BUCKET_ROWS = 256
#: Rows of one id are summed in slices of this many bits of their number.
SLICE_BITS = 10


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to (source_size, weight, ...), a row per source."""
    cap = F.col("source_size") * max_epochs
    full = sources.agg(F.sum("source_size")).first()[0] or 0
    clamped = F.lit(False)
    rate = 0.0
    while True:
        spent, weight = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        if not weight:
            break
        rate = float(full - (spent or 0)) / weight
        above = clamped | (F.col("weight") * F.lit(rate) > cap)
        if sources.filter(above & ~clamped).isEmpty():
            break
        clamped = above
    return sources.withColumn(
        "target", F.when(clamped, cap.cast("double")).otherwise(F.col("weight") * F.lit(rate)))


def _ahead(by: list[str], order: list[str]) -> Column:
    """The sizes of all rows before this one."""
    return F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        row_col: str | None = None) -> DataFrame:
    """One row per row of ``df``: row, doc_id, size, source_size, target, copies, taken."""
    size = F.regexp_count("text", F.lit(common.WORD)).cast("long")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = common.text_rows(df, id_col, text_col, F.col(source_col).alias("source"), row_col=row_col).select(
        "row", "doc_id", "source", size.alias("size"), order.alias("seeded"))
    docs = common.keep(docs, "mix-sizes")

    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    sources = sources.withColumn("rank", rank)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = common.keep(sources.withColumn("weight", pick), "mix-sources")
    sources = common.keep(water_fill(sources, max_epochs), "mix-targets")
    sources = sources.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    sources = sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    most = sources.agg(F.max("source_rows")).first()[0] or 0
    digits = next(d for d in range(1, 9) if d == 8 or most <= BUCKET_ROWS * 16 ** d)
    docs = docs.join(sources.drop("source_rows"), docs["source"].eqNullSafe(sources["source"])).drop("source")
    # Running sums in four steps, so that no task holds a source, nor all rows of one id.
    docs = docs.withColumn("high", F.substring("seeded", 1, (digits + 1) // 2)).withColumn("bucket", F.substring("seeded", 1, digits))
    docs = docs.withColumn("slice", F.shiftright("row", SLICE_BITS))
    levels = (["rank"], ["high"]), (["rank", "high"], ["bucket"]), (["rank", "bucket"], ["seeded", "doc_id", "slice"]), (["rank", "bucket", "seeded", "doc_id", "slice"], ["row"])
    sums = [docs.groupBy("rank", "high").agg(F.sum("size").alias("size")), docs.groupBy("rank", "high", "bucket").agg(F.sum("size").alias("size")),
            docs.groupBy("rank", "bucket", "seeded", "doc_id", "slice").agg(F.sum("size").alias("size")), docs]
    sums = [s.withColumn(f"ahead{i}", _ahead(*by)) for i, (s, by) in enumerate(zip(sums, levels, strict=True))]
    docs = sums[3]
    for i, (by, order) in enumerate(levels[:3]):
        other = sums[i].drop("size").withColumnsRenamed({c: f"{c}_" for c in by + order})
        docs = docs.join(other, reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by + order])).drop(*[f"{c}_" for c in by + order])
    docs = docs.withColumn("ahead", F.col("ahead0") + F.col("ahead1") + F.col("ahead2") + F.col("ahead3"))
    extra = (F.col("ahead") + F.col("size") / 2 < F.col("rest")).cast("long")
    return docs.select("row", "doc_id", "size", "source_size", "target",
                       (F.col("whole") + extra).alias("copies"),
                       (F.col("size") * (F.col("whole") + extra)).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    found = mix(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS seeded,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k FROM w),
p AS (
  SELECT k, weight, source_size,
         coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_weight,
         (SELECT sum(source_size) FROM s)::BIGINT AS full_size
  FROM o),
r AS (
  SELECT k AS from_k, (full_size - spent)::DOUBLE / open_weight AS rate FROM p
  WHERE (full_size - spent)::DOUBLE / open_weight * weight <= 3 * source_size ORDER BY k LIMIT 1),
t AS (
  SELECT o.source, o.source_size,
         CASE WHEN r.rate IS NULL OR o.k < r.from_k THEN (3 * o.source_size)::DOUBLE ELSE o.weight * r.rate END AS target
  FROM o LEFT JOIN r ON true),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY seeded, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN before + size / 2 < rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
