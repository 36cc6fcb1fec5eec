"""Queries of the versioned tables: stream upserts, scans that go on, trash and restore in one commit, near links that are kept up; near clusters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators import clusters, duplicates, lsh_store, scan, trash
from lodestone.sources.scratch import scratch_dir
from lodestone.sources.spread import spread
from lodestone.sources.versions import Change, Tables
from lodestone.streaming import events as ev
from lodestone.streaming import merge

from . import model as m
from . import near_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, bare: bool = False):
    def put(f):
        QUERIES[name] = f
        ORACLES[name] = sql if bare else m.PRELUDE + sql
        return f
    return put


def _tables(spark) -> Tables:
    return Tables(spark, f"{scratch_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}")


@query("stream_upsert_latest", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id", bare=True)
def stream_upsert_latest(spark, d):
    tables = _tables(spark)
    e = ev.source(spark, f"{d}/events.parquet", m.table(spark, d, "events"))
    merge.upsert_stream(e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type"), tables, "latest", ["user_id"], ["ts", "event_id"], f"{tables.root}/checkpoint")
    return tables.read("latest")


PHASES = [
    scan.Phase("stub", lambda df: df.filter("chunk_count = 0").select(F.col("id").alias("document_id"), F.lit("no chunks").alias("reason"))),
    scan.Phase("uncounted", lambda df: df.filter("chunk_count is null").select(F.col("id").alias("document_id"), F.lit("count unknown").alias("reason"))),
    scan.Phase("exact_duplicate", lambda df: duplicates.groups(df, "content_hash", "hash").filter("not is_keeper").select("document_id", F.col("keeper_id").alias("reason")), paged=False),
]


@query("scan_resumed", """, keeper AS (SELECT content_hash, arg_min(id, (strlen(id), id)) AS keeper_id FROM document WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT id AS document_id, 'stub' AS phase, 'no chunks' AS reason FROM document WHERE chunk_count = 0 UNION ALL
SELECT id, 'uncounted', 'count unknown' FROM document WHERE chunk_count IS NULL UNION ALL
SELECT id, 'exact_duplicate', keeper_id FROM document JOIN keeper USING (content_hash) WHERE id <> keeper_id""")
def scan_resumed(spark, d):
    """A scan of all documents that stops in the second phase and is taken up by another process's handle."""
    tables = _tables(spark)
    assert not scan.run(tables, "findings", m.documents(spark, d), PHASES, pages=4, most=5)
    again = Tables(spark, tables.root)
    scan.run(again, "findings", m.documents(spark, d), PHASES, pages=4)
    return again.read("findings")


def _trashed(spark, d):
    """All hidden documents discarded; of those of odd connectors, some crawled again, the rest brought back."""
    tables = _tables(spark)
    docs = m.documents(spark, d, text=True)
    chunks = docs.filter("chunk_count > 0").select(F.col("id").alias("document_id"), "text", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)).alias("chunk_index"))
    chunks = chunks.select("document_id", "chunk_index", F.expr("substring(text, chunk_index * 2000 + 1, 2000)").alias("content"))
    trash.create(tables, docs.drop("text"), m.tags(spark, d), m.attribution(spark, d), chunks)
    hidden = docs.filter("hidden").select(F.col("id").alias("document_id"), "connector_id", "boost")
    trash.discard(tables, hidden, m.NOW, batch=("discard", 1))
    asked = hidden.filter("connector_id % 2 = 1")
    crawled = docs.drop("text").join(asked.filter("boost = 1"), F.col("id") == F.col("document_id"), "left_semi")
    tables.commit({"document": Change(crawled, ["id"], append=True)}, batch=("crawl", 1))
    connectors = m.connectors(spark, d).filter("id <> 3")
    known = m.tags(spark, d).filter("tag_value <> 'fr'")
    return tables, trash.bring_back(tables, asked, connectors, known, m.NOW, batch=("restore", 1))


ASKED = """, asked AS (SELECT *, boost = 1 AS refused FROM document WHERE hidden AND connector_id % 2 = 1)
"""


@query("trash_restore_report", ASKED + """, per AS (
  SELECT refused, CASE WHEN refused THEN 0 ELSE 1 + (lang <> 'fr')::INT END AS tags, CASE WHEN refused THEN 0 ELSE (lang = 'fr')::INT END AS skipped_tags,
    CASE WHEN refused THEN 0 ELSE (SELECT count(*) FROM attribution a WHERE a.id = asked.id AND a.connector_id <> 3 AND a.connector_id IN (SELECT id FROM connector)) END AS links,
    CASE WHEN refused THEN 0 ELSE (SELECT count(*) FROM attribution a WHERE a.id = asked.id AND (a.connector_id = 3 OR a.connector_id NOT IN (SELECT id FROM connector))) END AS skipped_links,
    CASE WHEN refused THEN 0 ELSE coalesce(chunk_count, 0) END AS chunks FROM asked)
SELECT CASE WHEN refused THEN 'refused_exists' ELSE 'restored' END AS outcome, count(*) AS n, sum(tags)::BIGINT AS tags, sum(skipped_tags)::BIGINT AS skipped_tags, sum(links)::BIGINT AS links,
  sum(skipped_links)::BIGINT AS skipped_links, sum(chunks)::BIGINT AS chunks FROM per GROUP BY 1""")
def trash_restore_report(spark, d):
    _, report = _trashed(spark, d)
    return report.groupBy("outcome").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("tags", "skipped_tags", "links", "skipped_links", "chunks")])


@query("trash_committed", ASKED + """
SELECT (SELECT count(*) FROM document WHERE NOT hidden) + (SELECT count(*) FROM asked) AS documents,
  (SELECT coalesce(sum(chunk_count), 0) FROM document WHERE NOT hidden)::BIGINT + (SELECT coalesce(sum(chunk_count), 0) FROM asked WHERE NOT refused)::BIGINT AS chunks,
  (SELECT count(*) FROM document WHERE hidden) - (SELECT count(*) FROM asked WHERE NOT refused) AS items, (SELECT count(*) FROM asked WHERE NOT refused) AS restored_total""")
def trash_committed(spark, d):
    tables, _ = _trashed(spark, d)
    size = lambda name, alias: tables.read(name).agg(F.count("*").alias(alias))
    return size("document", "documents").crossJoin(size("chunk", "chunks")).crossJoin(trash.totals(tables, m.NOW).select("items", "restored_total"))  # one row each


@query("near_dup_clusters", m.PRELUDE.replace("WITH ", "WITH RECURSIVE ", 1) + near_sql.PAIRS + """
, link AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(id, r) AS (SELECT id, id FROM signed UNION SELECT l.b, x.r FROM reach x JOIN link l ON l.a = x.id),
own AS (SELECT id, min(r) AS cluster_id FROM reach GROUP BY id)
SELECT s.id AS document_id, o.id AS representative, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM signed s JOIN one o ON o.sig = s.sig JOIN own ON own.id = s.id""", bare=True)
def near_dup_clusters(spark, d):
    return clusters.near_clusters(duplicates.signatures(spread(m.documents(spark, d, text=True))))


@query("lsh_incremental_pairs", near_sql.PAIRS + "SELECT a, b, similarity FROM scored WHERE similarity >= 0.8")
def lsh_incremental_pairs(spark, d):
    """The documents in three batches: most of them, some with another's text; the rest, and strangers; then what was wrong is put right."""
    docs = m.documents(spark, d, text=True).select("id", "text", "doc_id")
    wrong = (F.col("doc_id") % 10 == 1).alias("wrong")
    tables = _tables(spark)
    lsh_store.create(tables)
    own = docs.select("id", "text", wrong, (F.col("doc_id") % 3 == 2).alias("later"))
    lsh_store.update(tables, own.filter("not later").select("id", F.when(F.col("wrong"), F.concat(F.lit("draft of "), "id")).otherwise(F.col("text")).alias("text")), batch=("documents", 1))
    strangers = own.filter("wrong").select(F.concat("id", F.lit("/old")).alias("id"), "text")
    lsh_store.update(tables, own.filter("later").select("id", "text").union(strangers), batch=("documents", 2))
    lsh_store.update(tables, own.filter("wrong").select("id", "text"), strangers.select("id"), ("documents", 3))
    return lsh_store.pairs(tables)
