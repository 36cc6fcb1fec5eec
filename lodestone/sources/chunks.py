"""Chunks of documents: fetch in order, cap, rebuild texts, update by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def of_document(chunks: DataFrame, document_id: str, vectors: bool = False) -> DataFrame:
    """A document's chunks in order, without vectors unless asked for."""
    rows = chunks.filter(F.col("document_id") == document_id)
    return (rows if vectors else rows.drop("content_vector")).orderBy("chunk_index")


def capped(chunks: DataFrame, cap: int = 20) -> DataFrame:
    """The first ``cap`` chunks of each document, with its true count and whether it was clipped."""
    rows = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index"))).filter(F.col("_n") <= cap).drop("_n")
    totals = chunks.groupBy("document_id").agg(F.count("*").alias("total"))
    return rows.join(totals, "document_id").withColumn("clipped", F.col("total") > cap)


def texts(chunks: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(document_id, text): contents in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("document_id").agg(ordered.alias("c")).select("document_id", F.array_join(F.col("c.content"), separator).alias("text"))


def counts(chunks: DataFrame, by: str = "document_id") -> DataFrame:
    return chunks.groupBy(by).agg(F.count("*").alias("n_chunks"))


def vector_of(chunks: DataFrame, document_id: str, chunk_index: int, field: str = "content_vector") -> DataFrame:
    """One chunk's vector; no row if it has none."""
    return chunks.filter((F.col("document_id") == document_id) & (F.col("chunk_index") == chunk_index) & F.col(field).isNotNull()).select("document_id", "chunk_index", field)


def upsert(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("document_id", "chunk_index")) -> DataFrame:
    """Rows of ``new`` in place of those with their keys; writing the same rows twice changes nothing."""
    return stored.join(new.select(*keys), list(keys), "left_anti").unionByName(new.dropDuplicates(list(keys)), allowMissingColumns=True)


def delete(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("document_id").distinct(), "document_id", "left_anti")


def retitle(stored: DataFrame, document_id: str, title: str) -> DataFrame:
    hit = F.col("document_id") == document_id
    return stored.withColumns({c: F.when(hit, F.lit(title)).otherwise(F.col(c)) for c in ("title", "semantic_identifier") if c in stored.columns})


def set_hidden(stored: DataFrame, ids: list[str], hidden: bool) -> DataFrame:
    return stored.withColumn("hidden", F.when(F.col("document_id").isin(*ids), F.lit(hidden)).otherwise(F.col("hidden")))


def live_index(settings: DataFrame) -> DataFrame:
    """The settings row in force: PRESENT, the highest id."""
    return settings.filter("status = 'PRESENT'").orderBy(F.col("id").desc()).limit(1)
