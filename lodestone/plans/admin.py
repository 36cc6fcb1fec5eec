"""Queries of the selection, fleet and store operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import fleet, lifecycle, selection, stores

from . import curation as cu
from . import model as m

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, bare: bool = False):
    def put(f):
        QUERIES[name] = f
        ORACLES[name] = sql if bare else m.PRELUDE + sql
        return f
    return put


ERRORS = """, error AS (
  SELECT event_id AS id, (user_id % 20 + 101)::INT AS cc_pair_id, event_id % 4 = 0 AS is_resolved, ts AS time_created FROM events WHERE event_type = 'error')
"""


def _errors(spark, d):
    """A per-document failure for every error event."""
    e = m.table(spark, d, "events").filter("event_type = 'error'")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 20 + 101).cast("int").alias("cc_pair_id"), (F.col("event_id") % 4 == 0).alias("is_resolved"), F.col("ts").cast("timestamp").alias("time_created"))


@query("attempt_errors_unresolved", ERRORS + "SELECT id, cc_pair_id, floor(epoch(time_created))::BIGINT AS time_created FROM error WHERE cc_pair_id = 105 AND NOT is_resolved ORDER BY time_created DESC, id DESC")
def attempt_errors_unresolved(spark, d):
    return fleet.attempt_errors(_errors(spark, d), 105, True).select("id", "cc_pair_id", F.unix_seconds("time_created").alias("time_created"))


@query("attempt_error_counts", ERRORS + "SELECT cc_pair_id, count(*) AS errors, count(*) FILTER (NOT is_resolved) AS unresolved FROM error GROUP BY 1")
def attempt_error_counts(spark, d):
    return fleet.error_counts(_errors(spark, d))


@query("attempt_errors_24h", ERRORS + ", latest AS (SELECT max(time_created) AS t FROM error) SELECT id FROM error, latest WHERE time_created > t - INTERVAL 24 HOURS AND time_created <= t")
def attempt_errors_24h(spark, d):
    errors = _errors(spark, d)
    return fleet.recent_errors(errors, errors.agg(F.max("time_created")).first()[0]).select("id")


FLEET = """, docs AS (SELECT connector_id, count(*) AS doc_count FROM document GROUP BY 1),
fleet AS (
  SELECT p.id AS cc_pair_id, p.connector_id, c.name, p.status, c.source, coalesce(doc_count, 0) AS doc_count, p.status = 'PAUSED' AS parked, p.connector_id % 5 = 0 AS stalled
  FROM cc_pair p JOIN connector c ON c.id = p.connector_id LEFT JOIN docs USING (connector_id))
"""


def _fleet(spark, d):
    docs = m.documents(spark, d).groupBy("connector_id").agg(F.count("*").alias("doc_count"))
    c = m.connectors(spark, d).select(F.col("id").alias("connector_id"), F.col("name"), "source")
    p = m.cc_pairs(spark, d).select(F.col("id").alias("cc_pair_id"), "connector_id", "status")
    return p.join(c, "connector_id").join(docs, "connector_id", "left").select(
        "cc_pair_id", "connector_id", "name", "status", "source", F.coalesce("doc_count", F.lit(0).cast("long")).alias("doc_count"), (F.col("status") == "PAUSED").alias("parked"), (F.col("connector_id") % 5 == 0).alias("stalled"))


@query("fleet_filtered", FLEET + "SELECT name, doc_count, status FROM fleet WHERE contains(lower(name), 'connector 1') AND upper(source) = 'GITHUB' ORDER BY status, doc_count DESC, cc_pair_id")
def fleet_filtered(spark, d):
    return fleet.columns(fleet.ordered(fleet.filtered(_fleet(spark, d), query="Connector 1", source="github"), "status"), ["name", "doc_count", "status"])


@query("fleet_totals", FLEET + "SELECT source, count(*) AS connectors, sum(doc_count)::BIGINT AS documents, count(*) FILTER (parked) AS parked, count(*) FILTER (stalled) AS stalled, count(*) FILTER (parked OR stalled) AS at_risk FROM fleet GROUP BY 1")
def fleet_totals(spark, d):
    return fleet.totals(_fleet(spark, d), "source")


@query("connector_resolution", FLEET + """, ref AS (
  SELECT DISTINCT r AS reference FROM (SELECT name AS r FROM fleet UNION ALL SELECT upper(name) FROM fleet UNION ALL SELECT cc_pair_id::VARCHAR FROM fleet UNION ALL SELECT connector_id::VARCHAR FROM fleet
    UNION ALL SELECT 'tor 1' UNION ALL SELECT 'nothing' UNION ALL SELECT '9999' UNION ALL SELECT ' CONNECTOR 2 ')),
met AS (
  SELECT reference, cc_pair_id, name, CASE WHEN name = trim(reference) THEN 1 WHEN lower(name) = lower(trim(reference)) THEN 2 WHEN cc_pair_id = try_cast(trim(reference) AS INT) THEN 3
    WHEN connector_id = try_cast(trim(reference) AS INT) THEN 4 WHEN try_cast(trim(reference) AS INT) IS NULL AND contains(lower(name), lower(trim(reference))) THEN 5 END AS step FROM ref, fleet),
best AS (SELECT r.reference, min(step) AS step FROM ref r LEFT JOIN met USING (reference) GROUP BY 1),
n AS (SELECT b.reference, b.step, count(m.cc_pair_id) AS n, min(m.cc_pair_id) AS pair, list_sort(list(DISTINCT m.name)) AS names FROM best b LEFT JOIN met m ON m.reference = b.reference AND m.step = b.step GROUP BY ALL)
SELECT reference, CASE WHEN step < 5 OR n = 1 THEN pair END AS cc_pair_id, CASE WHEN step IS NULL THEN 'not found' WHEN step < 5 OR n = 1 THEN 'found' ELSE 'ambiguous' END AS outcome,
  CASE WHEN step = 5 AND n > 1 THEN array_to_string(names[:10], ',') END AS listed FROM n""")
def connector_resolution(spark, d):
    rows = _fleet(spark, d)
    typed = spark.createDataFrame([("tor 1",), ("nothing",), ("9999",), (" CONNECTOR 2 ",)], "reference string")
    of = lambda c: rows.select(F.col(c).cast("string").alias("reference"))
    asked = of("name").union(rows.select(F.upper("name"))).union(of("cc_pair_id")).union(of("connector_id")).union(typed).distinct()
    return fleet.resolve(rows, asked).withColumn("listed", F.array_join("listed", ","))


@query("stats_overview", """, latest AS (SELECT max(time_started) AS t FROM attempt),
a AS (SELECT count(*) AS attempts, count(*) FILTER (status = 'FAILED') AS failed, sum(CASE WHEN time_started > t - INTERVAL 15 MINUTES THEN new_docs_indexed ELSE 0 END)::BIGINT AS docs_15m,
  sum(CASE WHEN time_started > t - INTERVAL 24 HOURS THEN new_docs_indexed ELSE 0 END)::BIGINT AS docs_24h, count(*) FILTER (status IN ('IN_PROGRESS', 'NOT_STARTED')) AS running FROM attempt, latest)
SELECT (SELECT count(*) FROM document) AS documents, (SELECT count(*) FROM cc_pair) AS connectors, (SELECT count(*) FROM cc_pair WHERE status = 'ACTIVE') AS active, a.* FROM a""")
def stats_overview(spark, d):
    attempts = m.attempts(spark, d)
    return fleet.overview(m.documents(spark, d), m.cc_pairs(spark, d), attempts, attempts.agg(F.max("time_started")).first()[0])


@query("selection_confirmed", cu.CANDIDATES + "SELECT candidate_id, state FROM cand WHERE state IN ('candidate', 'staged') AND list_contains(detectors, 'thin')")
def selection_confirmed(spark, d):
    rows = selection.resolve(cu._candidates(spark, d), allowed=("candidate", "staged"), detector="thin")
    return selection.confirmed(rows, rows.count()).select("candidate_id", "state")


@query("selection_by_ids", cu.CANDIDATES + "SELECT candidate_id, state FROM cand WHERE candidate_id IN (1, 2, 3, 100, 90000000)")
def selection_by_ids(spark, d):
    return selection.resolve(cu._candidates(spark, d), ids=[1, 2, 3, 100, 90000000]).select("candidate_id", "state")


@query("commands_first_wins", cu.CANDIDATES + """, cmd AS (SELECT candidate_id, CASE WHEN state = 'candidate' THEN 'stage' ELSE 'restore' END AS command FROM cand)
SELECT candidate_id, command, CASE WHEN state IN ('candidate', 'staged') THEN 'done' ELSE 'conflict' END AS outcome FROM cand JOIN cmd USING (candidate_id)""")
def commands_first_wins(spark, d):
    c = cu._candidates(spark, d)
    first = c.select("candidate_id", F.when(F.col("state") == "candidate", "stage").otherwise("restore").alias("command"), F.lit(1).alias("seq"))
    later = c.select("candidate_id", F.lit("dismiss").alias("command"), F.lit(2).alias("seq"))
    _, outcomes = lifecycle.transition(c, later.union(first), m.NOW)
    return outcomes.select("candidate_id", "command", "outcome")


EXCLUDED = cu.CANDIDATES + ", excl AS (SELECT document_id, 'deleted_with_remember' AS reason, detectors[1] || '/' || codes[1] AS note, created_at FROM cand WHERE state = 'deleted')"


@query("exclusions_remembered", EXCLUDED + """, held AS (SELECT document_id, 'by hand' AS reason, created_at - INTERVAL 1 HOUR AS created_at FROM cand WHERE candidate_id % 4 = 0)
SELECT document_id, coalesce(e.reason, h.reason) AS reason, e.note, epoch(coalesce(h.created_at, e.created_at))::BIGINT AS created_at FROM excl e FULL JOIN held h USING (document_id)""")
def exclusions_remembered(spark, d):
    c = cu._candidates(spark, d)
    held = c.filter("candidate_id % 4 = 0").select("document_id", F.lit("by hand").alias("reason"), F.lit(None).cast("string").alias("note"), (F.col("created_at") - F.make_dt_interval(hours=F.lit(1))).alias("created_at"))
    rows = selection.exclude(held, selection.remembered(c.filter("state = 'deleted'")))
    return rows.withColumn("created_at", F.unix_seconds("created_at"))


@query("exclusions_page", EXCLUDED + " SELECT document_id, note, (SELECT count(*) FROM excl) AS total FROM excl ORDER BY created_at DESC, document_id LIMIT 50 OFFSET 10")
def exclusions_page(spark, d):
    rows = selection.remembered(cu._candidates(spark, d).filter("state = 'deleted'"))
    return selection.exclusions_page(rows, 50, 10).select("document_id", "note", "total")


@query("exclusions_removed", EXCLUDED + " SELECT document_id FROM excl WHERE document_id NOT IN (SELECT id FROM document WHERE lang = 'en')")
def exclusions_removed(spark, d):
    rows = selection.remembered(cu._candidates(spark, d).filter("state = 'deleted'"))
    return selection.allow_again(rows, m.documents(spark, d).filter("lang = 'en'").select(F.col("id").alias("document_id"))).select("document_id")


@query("duplicate_evidence", """SELECT id AS document_id, CASE WHEN doc_id % 3 <> 1 THEN 'kept-' || doc_id % 10 END AS kept,
  CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE WHEN doc_id % 3 = 2 THEN (doc_id % 100) / 100 END AS similarity FROM document""")
def duplicate_evidence(spark, d):
    n = F.col("doc_id")
    kept = F.concat(F.lit("kept-"), (n % 10).cast("string"))
    evidence = F.when(n % 3 == 0, F.to_json(F.struct(kept.alias("kept")))).when(n % 3 == 2, F.to_json(F.struct(kept.alias("kept"), ((n % 100) / 100).alias("similarity"))))
    reasons = F.array(*[F.struct(F.lit(det).alias("detector"), e.alias("evidence")) for det, e in (("quality", evidence), ("duplicate", F.lit('{"x": 1}')), ("duplicate", evidence))])
    found = selection.duplicate_evidence(reasons)
    return m.documents(spark, d).select(F.col("id").alias("document_id"), found["kept"].alias("kept"), found["similarity"].alias("similarity"))


@query("hidden_flags", """SELECT id, doc_id % 2 = 0 AS present, CASE WHEN doc_id % 2 = 0 THEN hidden END AS hidden FROM document""")
def hidden_flags(spark, d):
    docs = m.documents(spark, d)
    return selection.hidden_flags(docs, docs.filter("doc_id % 2 = 0"))


@query("trash_restored", """SELECT id, semantic_id, boost, hidden, epoch(doc_updated_at)::BIGINT AS doc_updated_at, chunk_count FROM document""")
def trash_restored(spark, d):
    docs = m.documents(spark, d).select("id", "semantic_id", "boost", "hidden", "doc_updated_at", "chunk_count")
    gone = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    back = selection.restore(docs.filter(~gone), selection.snapshot(docs.filter(gone).union(docs.filter("boost = 2")), "id"), "id")
    return back.withColumn("doc_updated_at", F.unix_seconds("doc_updated_at"))


@query("trash_preview", """SELECT document_id, length(string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY chunk_index))::INT AS n_chars,
  md5(string_agg(substr(coalesce(content, ''), 1, 240), '|' ORDER BY chunk_index)) AS previews FROM chunk GROUP BY 1""")
def trash_preview(spark, d):
    rows = selection.trash_preview(m.chunks(spark, d).dropDuplicates(["document_id", "chunk_index"]))
    return rows.withColumn("previews", F.md5(F.array_join("previews", "|")))


@query("pairs_upserted", """SELECT least(id, other) AS a, greatest(id, other) AS b, 'minhash' AS method, CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE ELSE (doc_id % 100) / 100 END AS estimated,
  CASE WHEN doc_id % 3 = 0 THEN 0.9::DOUBLE END AS verified FROM (SELECT *, 'https://other/' || doc_id AS other FROM document)""")
def pairs_upserted(spark, d):
    docs, n = m.documents(spark, d), F.col("doc_id")
    other, none = F.concat(F.lit("https://other/"), n.cast("string")), F.lit(None)
    pair = lambda a, b, e, v: docs.select(a.alias("a"), b.alias("b"), F.lit("minhash").alias("method"), e.alias("estimated"), v.alias("verified"), none.cast("double").alias("cosine"), none.cast("boolean").alias("same_connector"))
    held = pair(F.col("id"), other, (n % 100) / 100, F.when(n % 3 == 0, F.lit(0.1).cast("double")))
    new = pair(other, F.col("id"), F.when(n % 2 == 0, F.lit(0.5).cast("double")), F.when(n % 3 == 0, F.lit(0.9).cast("double")))
    return stores.upsert_pairs(held, new).select("a", "b", "method", "estimated", "verified")


@query("groups_set", """SELECT id AS document_id, 'hash' AS method, CASE WHEN doc_id % 2 = 0 THEN 'new-' || doc_id % 7 ELSE 'old' END AS group_key, doc_id % 2 = 0 AS is_keeper FROM document""")
def groups_set(spark, d):
    docs, n = m.documents(spark, d), F.col("doc_id")
    row = lambda key, keeper, seq: docs.select(F.col("id").alias("document_id"), F.lit("hash").alias("method"), key.alias("group_key"), F.lit(2).alias("group_size"), F.lit(keeper).alias("is_keeper"), F.lit(seq).alias("seq"), "doc_id")
    new = row(F.lit("first"), False, 1).union(row(F.concat(F.lit("new-"), (n % 7).cast("string")), True, 2)).filter("doc_id % 2 = 0")
    return stores.set_groups(row(F.lit("old"), False, 0), new).select("document_id", "method", "group_key", "is_keeper")


@query("unsigned_documents", "SELECT id FROM document WHERE NOT (doc_id % 4 = 0 AND doc_id % 8 <> 0)")
def unsigned_documents(spark, d):
    docs, n = m.documents(spark, d), F.col("doc_id")
    signed = docs.filter(n % 4 == 0).select(F.col("id").alias("document_id"), F.when(n % 8 == 0, "stale").otherwise(F.col("content_hash")).alias("fingerprint"), F.lit("v2").alias("config_hash"))
    other = docs.select(F.col("id").alias("document_id"), F.col("content_hash").alias("fingerprint"), F.lit("v1").alias("config_hash"))
    return stores.unsigned(docs, signed.union(other), "v2").select("id")


@query("narration_parsed", r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Title ' || doc_id WHEN 1 THEN 'Inner ' || doc_id END AS title, CASE WHEN doc_id % 4 < 2 THEN 'about ' || lang END AS summary FROM documents""", bare=True)
def narration_parsed(spark, d):
    docs, n = m.table(spark, d, "documents"), F.col("doc_id")
    whole = lambda t: F.to_json(F.struct(F.concat(F.lit(t), n.cast("string")).alias("title"), F.concat(F.lit(" about "), "lang").alias("summary")))
    wrapped = F.regexp_extract(F.to_json(F.struct(whole("Inner ").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    answer = F.when(n % 4 == 0, whole("Title ")).when(n % 4 == 1, wrapped).when(n % 4 == 2, '{"title": "x", "summary": 3}').otherwise("no json {")
    found = tx.narration(answer)
    return docs.select("doc_id", found["title"].alias("title"), found["summary"].alias("summary"))


@query("text_clamped", r"""WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents), c AS (SELECT *, substr(t, 1, 199) AS cut FROM f),
h AS (SELECT *, regexp_extract(cut, '^(.*) ', 1) AS head FROM c)
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN length(head) * 4 >= 600 THEN head || '…' ELSE rtrim(cut) || '…' END AS clamped FROM h""", bare=True)
def text_clamped(spark, d):
    return m.table(spark, d, "documents").select("doc_id", tx.clamp_words(F.coalesce("text", F.lit("")), 200).alias("clamped"))


@query("source_links_parsed", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"0":"https://' || source || '"}' WHEN 1 THEN '"plain ' || source || '"' END AS links FROM documents""", bare=True)
def source_links_parsed(spark, d):
    n = F.col("doc_id")
    raw = F.when(n % 3 == 0, F.concat(F.lit('{"0": "https://'), "source", F.lit('"}'))).when(n % 3 == 1, F.concat(F.lit("plain "), "source"))
    return m.table(spark, d, "documents").select("doc_id", tx.source_links(raw).alias("links"))
