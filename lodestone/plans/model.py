"""The reference schema's tables, derived from the given ones, row for row.

Everything is a projection of a whole given table, so a query's work grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which relative times are taken.
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    place = F.when(n % 3 == 0, "doc/").when(n % 3 == 1, "page/").otherwise("")
    now = F.lit(NOW).cast("timestamp")
    return d.select(
        F.concat(F.lit("https://"), "source", F.lit(".example/"), place, n.cast("string")).alias("id"),
        F.concat(F.lit("Document "), n.cast("string")).alias("semantic_id"), F.lit(None).cast("string").alias("link"), (n % 5 - 2).cast("int").alias("boost"), (n % 17 == 0).alias("hidden"),
        F.when(n % 3 != 0, now - F.make_dt_interval(hours=(n % 2000).cast("int"))).alias("doc_updated_at"), (now - F.make_dt_interval(mins=(n % 3000).cast("int"))).alias("last_modified"),
        F.when(n % 11 != 0, F.when(n % 13 == 0, 0).otherwise(F.ceil(F.col("n_chars") / 2000))).cast("int").alias("chunk_count"),
        F.sha2("text", 256).alias("content_hash"), (F.substring("source", 4, 10).cast("int") + 1).alias("connector_id"), "doc_id", "lang", *(["text"] if text else []))


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    own = F.array(F.col("connector_id"), F.when(F.col("doc_id") % 10 == 0, F.col("connector_id") % 20 + 1))
    return d.select("id", F.explode(F.array_compact(own)).alias("connector_id"), F.lit(1).alias("credential_id"))


def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir).select(F.col("connector_id").alias("id")).distinct()
    kind = F.when(F.col("id") % 3 == 0, "WEB").when(F.col("id") % 3 == 1, "GITHUB").otherwise("WIKIPEDIA")
    return c.select("id", F.concat(F.lit("connector "), F.col("id").cast("string")).alias("name"), kind.alias("source"))


def cc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    status = F.when(i % 4 == 0, "ACTIVE").when(i % 4 == 1, "PAUSED").when(i % 4 == 2, "INITIAL_INDEXING").otherwise("DELETING")
    return connectors(spark, sf_dir).select((i + 100).alias("id"), i.alias("connector_id"), F.lit(1).alias("credential_id"),
                                            F.when(i % 4 == 0, " ").otherwise(F.concat(F.lit("pair "), i.cast("string"))).alias("name"), status.alias("status"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    kinds = {"click": "SUCCESS", "view": "IN_PROGRESS", "error": "FAILED", "purchase": "CANCELED"}
    status = F.lit("COMPLETED_WITH_ERRORS")
    for k, v in kinds.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    minutes = lambda m: F.make_dt_interval(mins=F.lit(m))
    docs = F.floor("value").cast("int")
    return e.select(n.alias("id"), (F.col("user_id") % 20 + 101).cast("int").alias("cc_pair_id"), status.alias("status"), ts.alias("time_created"), ts.alias("time_started"),
                    (ts + minutes(5)).alias("time_updated"), F.when(n % 5 != 0, ts + minutes(10)).alias("last_heartbeat_time"), docs.alias("new_docs_indexed"),
                    F.when(n % 7 != 0, docs + 3).alias("total_docs_indexed"),
                    F.when(F.col("event_type") == "error", F.when(n % 9 == 0, "first-pass already complete").otherwise("boom")).alias("error_msg"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    both = F.array(F.struct(F.lit("lang").alias("k"), F.col("lang").alias("v")), F.struct(F.lit("boost").alias("k"), F.col("boost").cast("string").alias("v")))
    return d.select(F.col("id").alias("document_id"), F.explode(both).alias("t")).select("document_id", F.col("t.k").alias("tag_key"), F.col("t.v").alias("tag_value"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as the chunks of a document."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("document_id"), F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("content"), F.col("role").alias("title"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("int").alias("label"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


#: The same tables for DuckDB.
PRELUDE = """WITH document AS (
  SELECT 'https://' || source || '.example/' || CASE doc_id % 3 WHEN 0 THEN 'doc/' WHEN 1 THEN 'page/' ELSE '' END || doc_id AS id,
    'Document ' || doc_id AS semantic_id, NULL::VARCHAR AS link, (doc_id % 5 - 2)::INT AS boost, doc_id % 17 = 0 AS hidden,
    CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - to_hours((doc_id % 2000)::INT) END AS doc_updated_at,
    TIMESTAMP '2024-01-31 00:00:00' - to_minutes((doc_id % 3000)::INT) AS last_modified,
    CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN doc_id % 13 = 0 THEN 0 ELSE ceil(n_chars / 2000)::INT END END AS chunk_count,
    sha256(text) AS content_hash, substr(source, 4)::INT + 1 AS connector_id, doc_id, lang, text,
    coalesce(CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - to_hours((doc_id % 2000)::INT) END, TIMESTAMP '2024-01-31 00:00:00' - to_minutes((doc_id % 3000)::INT)) AS sort_ts
  FROM documents),
attribution AS (
  SELECT id, connector_id, 1 AS credential_id FROM document UNION ALL
  SELECT id, connector_id % 20 + 1, 1 FROM document WHERE doc_id % 10 = 0),
connector AS (
  SELECT DISTINCT connector_id AS id, 'connector ' || connector_id AS name,
    CASE connector_id % 3 WHEN 0 THEN 'WEB' WHEN 1 THEN 'GITHUB' ELSE 'WIKIPEDIA' END AS source FROM document),
cc_pair AS (
  SELECT id + 100 AS id, id AS connector_id, 1 AS credential_id, CASE WHEN id % 4 = 0 THEN ' ' ELSE 'pair ' || id END AS name,
    CASE id % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'PAUSED' WHEN 2 THEN 'INITIAL_INDEXING' ELSE 'DELETING' END AS status FROM connector),
attempt AS (
  SELECT event_id AS id, (user_id % 20 + 101)::INT AS cc_pair_id,
    CASE event_type WHEN 'click' THEN 'SUCCESS' WHEN 'view' THEN 'IN_PROGRESS' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'CANCELED' ELSE 'COMPLETED_WITH_ERRORS' END AS status,
    ts AS time_created, ts AS time_started, ts + INTERVAL 5 MINUTES AS time_updated, CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 10 MINUTES END AS last_heartbeat_time,
    floor(value)::INT AS new_docs_indexed, CASE WHEN event_id % 7 <> 0 THEN floor(value)::INT + 3 END AS total_docs_indexed,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 9 = 0 THEN 'first-pass already complete' ELSE 'boom' END END AS error_msg FROM events),
tag AS (
  SELECT id AS document_id, 'lang' AS tag_key, lang AS tag_value FROM document UNION ALL SELECT id, 'boost', boost::VARCHAR FROM document),
chunk AS (
  SELECT 'conv/' || conv_id AS document_id, turn::INT AS chunk_index, text AS content, role AS title FROM conversations),
first_connector AS (
  SELECT a.id, min(a.connector_id) AS connector_id FROM attribution a JOIN connector c ON a.connector_id = c.id GROUP BY a.id)
"""
