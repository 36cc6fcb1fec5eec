"""Queries of the listing and telemetry families, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import listing as ls
from lodestone.operators import telemetry as tm
from lodestone.operators.cursor import Cursor
from lodestone.sources import chunks as ch

from . import model as m

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, bare: bool = False):
    """Register a query; its SQL follows the shared tables unless ``bare``."""
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql if bare else m.PRELUDE + sql
        return f
    return put


def _seconds(df: DataFrame, *columns: str) -> DataFrame:
    """Times as epoch seconds, so that engines' time types do not matter."""
    return df.withColumns({c: F.unix_seconds(F.col(c)) for c in columns})


ROWS = "d.id, semantic_id, boost, hidden, epoch(sort_ts)::BIGINT AS sort_ts, chunk_count, f.connector_id, 1 AS credential_id, c.name AS connector_name, c.source"
JOINED = "d LEFT JOIN first_connector f ON f.id = d.id LEFT JOIN connector c ON c.id = f.connector_id"
PAGE = "SELECT " + ROWS + " FROM (SELECT * FROM document {where} ORDER BY {order} LIMIT {n}) " + JOINED


def _list(spark: SparkSession, d: str, **options) -> DataFrame:
    return _seconds(ls.list_documents(m.documents(spark, d), m.attribution(spark, d), m.connectors(spark, d), **options), "sort_ts")


@query("list_updated_desc", PAGE.format(where="", order="sort_ts DESC, id DESC", n=50))
def list_updated_desc(spark, d):
    return _list(spark, d)


@query("list_chunks_nulls_last", PAGE.format(where="", order="chunk_count ASC NULLS LAST, id DESC", n=200))
def list_chunks(spark, d):
    return _list(spark, d, sort="chunks_asc", limit=200)


@query("list_boost_desc", PAGE.format(where="", order="boost DESC, id DESC", n=50))
def list_boost(spark, d):
    return _list(spark, d, sort="boost_desc")


@query("list_keyset_page", PAGE.format(where="WHERE (chunk_count < 2 OR (chunk_count = 2 AND id < 'https://src5') OR chunk_count IS NULL)", order="chunk_count DESC NULLS LAST, id DESC", n=100))
def list_keyset(spark, d):
    return _list(spark, d, sort="chunks_desc", cursor=Cursor("chunks_desc", 2, "https://src5").encode(), limit=100)


@query("list_keyset_null_tail", PAGE.format(where="WHERE chunk_count IS NULL AND id < 'https://src5'", order="id DESC", n=100))
def list_null_tail(spark, d):
    return _list(spark, d, sort="chunks_desc", cursor=Cursor("chunks_desc", None, "https://src5").encode(), limit=100)


@query("list_offset_page", PAGE.format(where="", order="id", n="25 OFFSET 50"))
def list_offset(spark, d):
    return _list(spark, d, sort="id", page=3, limit=25)


@query("filter_search", "SELECT id FROM document WHERE semantic_id ILIKE '%MENT 12%' OR id ILIKE '%MENT 12%'")
def filter_search(spark, d):
    return ls.filter_documents(m.documents(spark, d), ls.DocumentFilter(search="MENT 12")).select("id")


@query("filter_ranges_null_excluding", "SELECT id, chunk_count FROM document WHERE chunk_count >= 1 AND chunk_count <= 3 AND hidden = false AND sort_ts >= TIMESTAMP '2024-01-20' AND sort_ts <= TIMESTAMP '2024-01-30'")
def filter_ranges(spark, d):
    f = ls.DocumentFilter(chunk_min=1, chunk_max=3, hidden=False, updated_after="2024-01-20", updated_before="2024-01-30")
    return ls.filter_documents(m.documents(spark, d), f).select("id", "chunk_count")


@query("semi_join_source", "SELECT id FROM document d WHERE EXISTS (SELECT 1 FROM attribution a JOIN connector c ON c.id = a.connector_id WHERE a.id = d.id AND upper(c.source) = 'WEB')")
def semi_join_source(spark, d):
    return ls.filter_documents(m.documents(spark, d), ls.DocumentFilter(source="web"), m.attribution(spark, d), m.connectors(spark, d)).select("id")


@query("unknown_source_empty", "SELECT id FROM document WHERE false")
def unknown_source(spark, d):
    return ls.filter_documents(m.documents(spark, d), ls.DocumentFilter(source="nowhere"), m.attribution(spark, d), m.connectors(spark, d)).select("id")


@query("scope_url_prefix", "SELECT count(*) AS total FROM document WHERE id LIKE 'https://src1.%'")
def scope_prefix(spark, d):
    return ls.in_scope(m.documents(spark, d), "url_prefix", "https://src1.").agg(F.count("*").alias("total"))


@query("attribution_top1", "SELECT d.id, f.connector_id, p.id AS cc_pair_id, coalesce(p.status IN ('ACTIVE', 'INITIAL_INDEXING'), false) AS recrawl_risk FROM document d LEFT JOIN first_connector f ON f.id = d.id LEFT JOIN cc_pair p ON p.connector_id = f.connector_id")
def attribution_top1(spark, d):
    rows = ls.attribute(m.documents(spark, d).drop("connector_id"), m.attribution(spark, d), m.connectors(spark, d), m.cc_pairs(spark, d))
    return rows.select("id", "connector_id", "cc_pair_id", ls.recrawl_risk(F.col("cc_status")).alias("recrawl_risk"))


@query("document_detail", "SELECT d.id, f.connector_id, p.status AS cc_status, (SELECT string_agg(tag_key || '=' || tag_value, ',' ORDER BY tag_key || '=' || tag_value) FROM tag t WHERE t.document_id = d.id) AS tags FROM document d LEFT JOIN first_connector f ON f.id = d.id LEFT JOIN cc_pair p ON p.connector_id = f.connector_id WHERE d.id IN ('https://src1.example/doc/21', 'https://src3.example/page/43', 'https://src0.example/doc/0')")
def document_detail(spark, d):
    rows = ls.document_detail(m.documents(spark, d).drop("connector_id"), m.attribution(spark, d), m.connectors(spark, d), m.cc_pairs(spark, d), m.tags(spark, d), ["https://src1.example/doc/21", "https://src3.example/page/43", "https://src0.example/doc/0"])
    return rows.select("id", "connector_id", "cc_status", F.array_join("tags", ",").alias("tags"))


@query("count_exact", "SELECT count(*) AS total FROM document WHERE hidden = true")
def count_exact(spark, d):
    return ls.count_documents(m.documents(spark, d), ls.DocumentFilter(hidden=True))


@query("count_bounded", "SELECT least(count(*), 100)::BIGINT AS total, count(*) <= 100 AS exact FROM (SELECT 1 FROM document LIMIT 101)")
def count_bounded(spark, d):
    return ls.count_documents(m.documents(spark, d), bound=100)


@query("page_with_total", "SELECT id, (SELECT count(*) FROM document WHERE hidden) AS total FROM document WHERE hidden ORDER BY id LIMIT 20")
def page_with_total(spark, d):
    return ls.page_with_total(m.documents(spark, d).filter("hidden").select("id"), [F.col("id")], 20)


@query("top_connectors", "SELECT c.id AS connector_id, c.name, count(DISTINCT a.id) AS docs, epoch(max(d.sort_ts))::BIGINT AS latest FROM connector c LEFT JOIN attribution a ON a.connector_id = c.id LEFT JOIN document d ON d.id = a.id GROUP BY ALL ORDER BY docs DESC, connector_id LIMIT 8")
def top_connectors(spark, d):
    return _seconds(ls.leaderboard(m.documents(spark, d), m.attribution(spark, d), m.connectors(spark, d), limit=8), "latest")


@query("fleet_summary", "SELECT p.id AS cc_pair_id, CASE WHEN trim(p.name) = '' THEN c.name ELSE p.name END AS display_name, c.source, p.status, (SELECT count(*) FROM attribution a WHERE a.connector_id = p.connector_id) AS doc_count, l.status AS last_status, coalesce(contains(l.error_msg, 'first-pass already complete') OR contains(l.error_msg, 'park done'), false) AS parked FROM cc_pair p JOIN connector c ON c.id = p.connector_id LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cc_pair_id ORDER BY time_updated DESC, id DESC) AS r FROM attempt) WHERE r = 1) l ON l.cc_pair_id = p.id")
def fleet_summary(spark, d):
    return tm.fleet_summary(m.cc_pairs(spark, d), m.connectors(spark, d), m.attribution(spark, d), m.attempts(spark, d))


@query("latest_attempt_per_pair", "SELECT cc_pair_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY cc_pair_id ORDER BY time_updated DESC, id DESC) AS r FROM attempt) WHERE r = 1")
def latest_attempts(spark, d):
    return tm.latest_attempts(m.attempts(spark, d)).select("cc_pair_id", "id", "status")


@query("status_counts", "SELECT cc_pair_id, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'IN_PROGRESS') AS in_progress, count(*) FILTER (status IN ('CANCELED', 'CANCELLED')) AS canceled, count(*) FILTER (status NOT IN ('SUCCESS', 'FAILED', 'IN_PROGRESS', 'CANCELED', 'CANCELLED')) AS other, count(*) AS total, floor(epoch(min(time_created) FILTER (status = 'IN_PROGRESS')))::BIGINT AS oldest_running FROM attempt GROUP BY 1")
def status_counts(spark, d):
    return _seconds(tm.status_counts(m.attempts(spark, d), "cc_pair_id"), "oldest_running")


@query("stalled_attempts", "SELECT id, status = 'IN_PROGRESS' AND epoch(TIMESTAMP '2024-01-31') - epoch(coalesce(last_heartbeat_time, time_updated)) > 2700 AS stalled, CASE WHEN status = 'IN_PROGRESS' AND (epoch(TIMESTAMP '2024-01-31') - epoch(time_started)) / 60 > 0.05 THEN round(coalesce(total_docs_indexed, new_docs_indexed) / ((epoch(TIMESTAMP '2024-01-31') - epoch(time_started)) / 60), 2) END AS pages_per_min FROM attempt")
def stalled_attempts(spark, d):
    return tm.with_progress(m.attempts(spark, d), m.NOW).select("id", "stalled", "pages_per_min")


@query("attempts_filtered", "SELECT id, status FROM attempt WHERE cc_pair_id = 105 AND status IN ('FAILED', 'CANCELED') ORDER BY time_created DESC, id DESC LIMIT 50")
def attempts_filtered(spark, d):
    return tm.list_attempts(m.attempts(spark, d), m.NOW, 105, ("failed", "canceled"), 50).select("id", "status")


@query("history_daily", "SELECT strftime(time_created, '%Y-%m-%d') AS day, sum(coalesce(new_docs_indexed, 0))::BIGINT AS docs, count(*) AS attempts FROM attempt WHERE cc_pair_id = 105 GROUP BY 1")
def history_daily(spark, d):
    return tm.daily_history(m.attempts(spark, d), 105)


@query("timeline_zero_filled", "SELECT epoch(b)::BIGINT AS bucket, count(id) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)) AS b) LEFT JOIN attempt ON time_created >= b AND time_created < b + INTERVAL 1 HOUR GROUP BY 1")
def timeline(spark, d):
    return _seconds(tm.timeline(m.attempts(spark, d), "time_created", m.NOW, "7d", "1h"), "bucket")


@query("recent_rate", "SELECT count(*) FILTER (time_created > TIMESTAMP '2024-01-31' - INTERVAL 15 MINUTES AND time_created <= TIMESTAMP '2024-01-31') AS last_15_min, count(*) FILTER (time_created > TIMESTAMP '2024-01-31' - INTERVAL 10080 MINUTES AND time_created <= TIMESTAMP '2024-01-31') AS last_10080_min FROM attempt")
def recent_rate(spark, d):
    return tm.recent_counts(m.attempts(spark, d), "time_created", m.NOW, (15, 10080))


@query("sources_distinct", "SELECT c.source, count(DISTINCT c.id) AS connectors, count(DISTINCT a.id) AS documents FROM connector c LEFT JOIN attribution a ON a.connector_id = c.id GROUP BY 1")
def sources_distinct(spark, d):
    return tm.sources(m.documents(spark, d), m.attribution(spark, d), m.connectors(spark, d))


@query("facets", "SELECT tag_key, tag_value, count(*) AS n FROM tag GROUP BY ALL")
def facets(spark, d):
    return tm.facets(m.tags(spark, d))


@query("facets_prefix", "SELECT tag_key, tag_value, count(*) AS n FROM tag WHERE tag_key = 'lang' AND tag_value ILIKE 'E%' GROUP BY ALL")
def facets_prefix(spark, d):
    return tm.facets(m.tags(spark, d), "E%", "lang")


@query("facet_keys", "SELECT tag_key, count(DISTINCT tag_value) AS n_values FROM tag GROUP BY 1")
def facet_keys(spark, d):
    return tm.facet_keys(m.tags(spark, d))


@query("busy_pairs", "SELECT DISTINCT cc_pair_id FROM attempt WHERE status = 'IN_PROGRESS'")
def busy(spark, d):
    return tm.busy_pairs(m.attempts(spark, d))


@query("stall_sessions", "SELECT user_id, s AS session, floor(epoch(min(ts)))::BIGINT AS first, floor(epoch(max(ts)))::BIGINT AS last, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS s FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 2700 THEN 1 ELSE 0 END AS f FROM events)) GROUP BY 1, 2", bare=True)
def stall_sessions(spark, d):
    e = m.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _seconds(tm.stall_sessions(e, "user_id", "ts"), "first", "last")


@query("nearest_rank_percentiles", "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events", bare=True)
def nearest_rank(spark, d):
    return tm.nearest_rank(m.table(spark, d, "events"), "value")


@query("json_merge_patch", "SELECT event_id, json_extract_string(props, '$.k') AS k, 'yes' AS seen FROM events", bare=True)
def merge_patch(spark, d):
    e = m.table(spark, d, "events").withColumn("old", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("seen"), F.lit("no"))))
    new = ls.merge_patch(F.col("old"), F.create_map(F.lit("seen"), F.lit("yes")))
    return e.select("event_id", new["k"].alias("k"), new["seen"].alias("seen"))


@query("text_reconstruct", "SELECT document_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM chunk GROUP BY 1")
def text_reconstruct(spark, d):
    return ch.texts(m.chunks(spark, d))


@query("chunk_cap_clipped", "SELECT document_id, chunk_index, total, total > 3 AS clipped FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS r, count(*) OVER (PARTITION BY document_id) AS total FROM chunk) WHERE r <= 3")
def chunk_cap(spark, d):
    return ch.capped(m.chunks(spark, d), 3).select("document_id", "chunk_index", "total", "clipped")


@query("chunk_counts", "SELECT title, count(*) AS n_chunks FROM chunk GROUP BY 1")
def chunk_counts(spark, d):
    return ch.counts(m.chunks(spark, d), "title")


@query("chunk_upsert", "SELECT document_id, chunk_index, CASE WHEN chunk_index = 0 THEN 'new' ELSE title END AS title FROM chunk")
def chunk_upsert(spark, d):
    stored = m.chunks(spark, d).select("document_id", "chunk_index", "title")
    return ch.upsert(stored, stored.filter("chunk_index = 0").withColumn("title", F.lit("new")))


@query("relational_listing", "SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", bare=True)
def relational_listing(spark, d):
    o, c, n = (m.table(spark, d, t) for t in ("orders", "customer", "nation"))
    top = o.filter("o_orderstatus = 'O'").join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return top.select("o_orderkey", "c_name", "n_name", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query("relational_lateral_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest FROM customer", bare=True)
def lateral_count(spark, d):
    o, c = m.table(spark, d, "orders"), m.table(spark, d, "customer")
    own = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max(F.struct("o_orderdate", "o_orderkey")).alias("l"))
    return c.select("c_custkey").join(own, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.col("l.o_orderkey").alias("latest"))


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2", bare=True)
def pricing_summary(spark, d):
    li = m.table(spark, d, "lineitem").filter(F.col("l_shipdate") <= "1998-09-02")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
