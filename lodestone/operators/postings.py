"""An inverted index as a table: a query reads the partitions of its terms, and filters act before scores.

Postings (term, keys, tf, length, kept columns) lie in partitions by a hash of the term and
are sorted by term inside, so both the partition and the term reach the scan.  Scores are those
of ``search.bm25``: document frequencies count all postings of a term, filtered out or not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import B, K1, tokens

BUCKETS = 64
#: A bucket is written by so many tasks, so that a term of all documents is no single task's load.
WRITERS = 8
KEYS = ("document_id", "chunk_index")


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(chunks: DataFrame, field: str, path: str, keys: tuple[str, ...] = KEYS, kept: tuple[str, ...] = (), buckets: int = BUCKETS) -> None:
    """Write the postings of ``field`` and the number and mean length of all chunks; ``kept`` columns can be filtered by."""
    rows = chunks.select(F.monotonically_increasing_id().alias("_row"), *keys, *kept, tokens(F.col(field)).alias("_t"))
    rows.agg(F.count("*").cast("double").alias("n"), F.avg(F.size("_t")).alias("mean")).write.parquet(f"{path}/stats")
    found = rows.select("_row", *keys, *kept, F.size("_t").alias("length"), F.explode("_t").alias("term"))
    found = found.groupBy("_row", "term", "length", *keys, *kept).agg(F.count("*").alias("tf")).select("term", "tf", "length", *keys, *kept)
    found = found.withColumn("bucket", bucket(F.col("term"), buckets))
    dealt = found.repartition("bucket", F.pmod(F.xxhash64(*keys), F.lit(WRITERS))).sortWithinPartitions("bucket", "term")
    dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")


def terms_of(query: str) -> list[str]:
    return sorted({t for t in re.split(r"[\W_]+", query.lower()) if t})


def read(spark: SparkSession, path: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of the terms; other buckets are not listed, other terms' row groups not read."""
    own = spark.range(1).select(F.array(*[bucket(F.lit(t), buckets) for t in terms])).first()[0] if terms else []
    return spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(*sorted(set(own))) & F.col("term").isin(*terms))


def search(spark: SparkSession, path: str, query: str, where: Column | None = None, keys: tuple[str, ...] = KEYS, k1: float = K1, b: float = B, buckets: int = BUCKETS) -> DataFrame:
    """(keys, score) of the chunks that hold a term and pass ``where``, which is applied before they are scored."""
    terms = terms_of(query)
    found = read(spark, path, terms, buckets)
    n, mean = spark.read.parquet(f"{path}/stats").first()
    held = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row a term of the query
    df = F.lit(0)
    for t, own in held.items():
        df = F.when(F.col("term") == t, own).otherwise(df)
    idf = F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))
    tf = F.col("tf").cast("double")
    score = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
    rows = found if where is None else found.filter(where)
    return rows.select(*keys, score.alias("s")).groupBy(*keys).agg(F.sum("s").alias("score"))
