"""Queries of the curation families (text, URLs, duplicates, policy, lifecycle, search, vectors), with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import language, minhash, url
from lodestone.functions import text as tx
from lodestone.functions import textquality as tq
from lodestone.operators import detect, duplicates, lifecycle, policy, search, stores, triage
from lodestone.operators import listing as ls
from lodestone.operators import vectors as vec
from lodestone.sources.scratch import keep
from lodestone.sources.spread import spread

from . import model as m
from . import near_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, bare: bool = False):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql if bare else m.PRELUDE + sql
        return f
    return put


# --- text quality ---------------------------------------------------------------------------------------------------

_TRIM = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
_BARE = r"lower(regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))"
MEASURES = rf"""
, base AS (
  SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words,
         list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM}), lambda x: x <> '') AS lines
  FROM documents),
parts AS (
  SELECT *, len(words) AS n, greatest(len(lines), 1) AS ln, list_transform(words, lambda w: {_BARE}) AS bare, list_distinct(lines) AS dl,
         coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS lc FROM base),
shares AS (
  SELECT doc_id, source, text, bare, n::INT AS word_count,
    CASE WHEN n > 0 THEN list_sum(list_transform(words, lambda w: length(w))) / n ELSE 0 END AS mean_word_length,
    CASE WHEN n > 0 THEN (len(regexp_extract_all(text, '[#…]')) + len(regexp_extract_all(text, '\.\.\.'))) / n ELSE 0 END AS symbol_word_ratio,
    CASE WHEN n > 0 THEN len(list_filter(words, lambda w: regexp_matches(w, '\p{{L}}'))) / n ELSE 0 END AS alpha_word_fraction,
    len(list_intersect(['the', 'be', 'to', 'of', 'and', 'that', 'have', 'with'], list_distinct(bare)))::INT AS stopword_hits,
    CASE WHEN n > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '^(•|-|\*|‣|◦|· )'))) / ln ELSE 0 END AS bullet_line_fraction,
    CASE WHEN n > 0 THEN len(list_filter(lines, lambda x: x LIKE '%...' OR x LIKE '%…')) / ln ELSE 0 END AS ellipsis_line_fraction,
    CASE WHEN n > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '[.!?"”’।]$'))) / ln ELSE 0 END AS punct_line_fraction,
    CASE WHEN n > 0 THEN len(list_filter(lines, lambda x: length(x) < 30)) / ln ELSE 0 END AS short_line_fraction,
    CASE WHEN n > 0 AND len(lines) > 0 THEN (len(lines) - len(dl)) / len(lines) ELSE 0 END AS dup_line_fraction,
    CASE WHEN n > 0 AND lc > 0 THEN (lc - list_sum(list_transform(dl, lambda x: length(x)))) / lc ELSE 0 END AS dup_line_char_fraction,
    CASE WHEN n > 0 THEN (length(text) - length(replace(text, chr(10), ''))) / n ELSE 0 END AS newline_word_ratio,
    regexp_matches(lower(text), 'lorem ipsum|javascript is disabled|enable cookies') AS has_boilerplate_marker
  FROM parts)"""


def _top(n: int) -> str:
    return f"""
, grams{n} AS (SELECT doc_id, bare[i:i + {n - 1}] AS g FROM (SELECT doc_id, bare, unnest(range(1, len(bare) - {n - 2})) AS i FROM shares)),
counts{n} AS (SELECT doc_id, g, count(*) AS c, strlen(array_to_string(g, ' ')) AS b, list_sum(list_transform(g, lambda w: length(w))) AS k FROM grams{n} GROUP BY doc_id, g),
top{n} AS (SELECT doc_id, arg_max(c * k, (c, b, k)) AS hit FROM counts{n} GROUP BY doc_id)"""


def _dup(n: int) -> str:
    return f"""
, at{n} AS (SELECT doc_id, i, bare[i:i + {n - 1}] AS g FROM (SELECT doc_id, bare, unnest(range(1, len(bare) - {n - 2})) AS i FROM shares)),
rep{n} AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM at{n}) WHERE c > 1),
cov{n} AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + {n})) AS p FROM rep{n})),
dup{n} AS (SELECT v.doc_id, sum(length(s.bare[p])) AS hit FROM cov{n} v JOIN shares s ON s.doc_id = v.doc_id GROUP BY v.doc_id)"""


NGRAMS = "".join(_top(n) for n in (2, 3, 4)) + "".join(_dup(n) for n in (5, 10)) + """
, totals AS (SELECT doc_id, coalesce(list_sum(list_transform(bare, lambda w: length(w))), 0) AS total FROM shares),
measured AS (
  SELECT s.*, """ + ", ".join(f"CASE WHEN total > 0 THEN least(1.0::DOUBLE, coalesce({k}{n}.hit, 0) / total) ELSE 0.0 END AS {k}_{n}" for k, n in (("top", 2), ("top", 3), ("top", 4), ("dup", 5), ("dup", 10))) + """
  FROM shares s JOIN totals t ON t.doc_id = s.doc_id """ + " ".join(f"LEFT JOIN {k}{n} ON {k}{n}.doc_id = s.doc_id" for k, n in (("top", 2), ("top", 3), ("top", 4), ("dup", 5), ("dup", 10))) + ")"

GATE_SQL = """
, gated AS (
  SELECT *, CASE WHEN word_count = 0 THEN [] ELSE list_filter([
    CASE WHEN word_count < 50 THEN 'word_count_low' END, CASE WHEN word_count > 100000 THEN 'word_count_high' END,
    CASE WHEN mean_word_length::FLOAT < 3.0::FLOAT OR mean_word_length::FLOAT > 10.0::FLOAT THEN 'mean_word_length' END,
    CASE WHEN symbol_word_ratio::FLOAT > 0.1::FLOAT THEN 'symbol_ratio' END, CASE WHEN bullet_line_fraction::FLOAT > 0.9::FLOAT THEN 'bullet_lines' END,
    CASE WHEN ellipsis_line_fraction::FLOAT > 0.3::FLOAT THEN 'ellipsis_lines' END, CASE WHEN alpha_word_fraction::FLOAT < 0.8::FLOAT THEN 'alpha_words' END,
    CASE WHEN word_count >= 50 AND stopword_hits < 2 THEN 'stopwords' END,
    CASE WHEN dup_line_fraction::FLOAT > 0.3::FLOAT OR dup_line_char_fraction::FLOAT > 0.2::FLOAT THEN 'dup_lines' END,
    CASE WHEN word_count >= 100 AND (top_2::FLOAT > 0.20::FLOAT OR top_3::FLOAT > 0.18::FLOAT OR top_4::FLOAT > 0.16::FLOAT OR dup_5::FLOAT > 0.15::FLOAT OR dup_10::FLOAT > 0.10::FLOAT) THEN 'repeated_ngrams' END,
    CASE WHEN word_count >= 50 AND punct_line_fraction::FLOAT < 0.12::FLOAT THEN 'unterminated_lines' END,
    CASE WHEN short_line_fraction::FLOAT > 0.67::FLOAT THEN 'short_lines' END, CASE WHEN newline_word_ratio::FLOAT > 0.3::FLOAT THEN 'newline_ratio' END,
    CASE WHEN has_boilerplate_marker THEN 'boilerplate_marker' END], lambda g: g IS NOT NULL) END AS gates FROM measured),
judged AS (
  SELECT *, list_distinct(list_transform(gates, lambda g: CASE
      WHEN g IN ('word_count_low', 'word_count_high') THEN 'length' WHEN g IN ('mean_word_length', 'symbol_ratio', 'alpha_words', 'stopwords') THEN 'composition'
      WHEN g IN ('dup_lines', 'repeated_ngrams') THEN 'repetition' WHEN g = 'boilerplate_marker' THEN 'marker' ELSE 'line_shape' END)) AS families FROM gated),
candidates AS (SELECT *, len(gates) >= 3 AND len(families) >= 2 AS is_candidate FROM judged)"""
QUALITY = "WITH one AS (SELECT 1)" + MEASURES + NGRAMS + GATE_SQL
SWEEP = "WITH one AS (SELECT 1)" + MEASURES + NGRAMS + GATE_SQL.replace("WHEN word_count >= 50 AND stopword_hits", "WHEN word_count >= stop_word_floor AND stopword_hits").replace(
    "FROM measured)", "FROM measured, (SELECT unnest([50, 75, 100, 150])::INT AS stop_word_floor))")
SHARES = ("mean_word_length", "symbol_word_ratio", "alpha_word_fraction", "bullet_line_fraction", "ellipsis_line_fraction", "punct_line_fraction", "short_line_fraction", "dup_line_fraction", "dup_line_char_fraction", "newline_word_ratio")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return tq.measure(spread(m.table(spark, d, "documents").select("doc_id", "source", "text")))


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    return tq.evaluate(_measured(spark, d))


@query("quality_metrics", QUALITY + " SELECT doc_id, word_count, stopword_hits, has_boilerplate_marker, " + ", ".join(f"round({c}, 4) AS {c}" for c in SHARES) + " FROM shares", bare=True)
def quality_metrics(spark, d):
    return _measured(spark, d).select("doc_id", "word_count", "stopword_hits", "has_boilerplate_marker", *[F.round(c, 4).alias(c) for c in SHARES])


@query("ngram_metrics", QUALITY + " SELECT doc_id, " + ", ".join(f"round({k}_{n}, 6) AS {k}_{n}gram_char_fraction" for k, n in (("top", 2), ("top", 3), ("top", 4), ("dup", 5), ("dup", 10))) + " FROM measured", bare=True)
def ngram_metrics(spark, d):
    return _measured(spark, d).select("doc_id", *[F.round(f"{k}_{n}gram_char_fraction", 6).alias(f"{k}_{n}gram_char_fraction") for k, n in (("top", 2), ("top", 3), ("top", 4), ("dup", 5), ("dup", 10))])


@query("quality_gates", QUALITY + " SELECT doc_id, array_to_string(gates, ',') AS gates, len(families)::INT AS n_families FROM candidates", bare=True)
def quality_gates(spark, d):
    return _evaluated(spark, d).select("doc_id", F.array_join("gates", ",").alias("gates"), F.size("families").alias("n_families"))


@query("quality_candidates", QUALITY + " SELECT doc_id, round(least(0.55 + 0.1 * greatest(len(gates) - 3, 0), 0.85), 4)::DOUBLE AS confidence FROM candidates WHERE is_candidate", bare=True)
def quality_candidates(spark, d):
    return _evaluated(spark, d).filter("is_candidate").select("doc_id", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


@query("quality_funnel", QUALITY + " SELECT source, count(*) AS docs, count(*) FILTER (is_candidate) AS candidates, sum(len(gates))::BIGINT AS failures FROM candidates GROUP BY 1", bare=True)
def quality_funnel(spark, d):
    return _evaluated(spark, d).groupBy("source").agg(F.count("*").alias("docs"), F.count_if("is_candidate").alias("candidates"), F.sum(F.size("gates")).alias("failures"))


@query("gate_report", QUALITY + " SELECT gate, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share, min(doc_id) AS example FROM (SELECT doc_id, unnest(gates) AS gate FROM candidates) GROUP BY 1", bare=True)
def gate_report(spark, d):
    return triage.gate_report(_evaluated(spark, d).withColumn("id", F.col("doc_id"))).withColumn("share", F.round("share", 6))


@query("gate_examples", QUALITY + " SELECT gate, array_to_string(list_sort(list(doc_id))[1:3], ',') AS examples FROM (SELECT doc_id, unnest(gates) AS gate FROM candidates) GROUP BY 1", bare=True)
def gate_examples(spark, d):
    return triage.gate_examples(_evaluated(spark, d).withColumn("id", F.col("doc_id"))).withColumn("examples", F.array_join("examples", ","))


@query("gate_sweep", SWEEP + " SELECT stop_word_floor, min_families::INT AS min_families, avg((len(gates) >= 3 AND len(families) >= min_families)::INT) AS flagged FROM judged, (SELECT unnest([2, 3]) AS min_families) GROUP BY ALL", bare=True)
def gate_sweep(spark, d):
    return triage.gate_sweep(_measured(spark, d))


@query("gate_vs_labels", QUALITY + " SELECT quality, is_candidate, count(*) AS n FROM candidates JOIN labels USING (doc_id) GROUP BY ALL", bare=True)
def gate_vs_labels(spark, d):
    return _evaluated(spark, d).join(m.table(spark, d, "labels"), "doc_id").groupBy("quality", "is_candidate").agg(F.count("*").alias("n"))


EXPLAINED = """ SELECT doc_id, array_to_string(list_filter([
  CASE WHEN list_contains(gates, 'word_count_low') THEN word_count || ' words, fewer than 50' END, CASE WHEN list_contains(gates, 'word_count_high') THEN word_count || ' words, more than 100000' END,
  CASE WHEN list_contains(gates, 'mean_word_length') THEN 'mean word length ' || round(mean_word_length, 2) || ', outside 3.0-10.0' END,
  CASE WHEN list_contains(gates, 'symbol_ratio') THEN round(symbol_word_ratio, 2) || ' symbols a word, more than 0.1' END,
  CASE WHEN list_contains(gates, 'bullet_lines') THEN round(bullet_line_fraction, 2) || ' of lines are bullets, more than 0.9' END,
  CASE WHEN list_contains(gates, 'ellipsis_lines') THEN round(ellipsis_line_fraction, 2) || ' of lines end in an ellipsis, more than 0.3' END,
  CASE WHEN list_contains(gates, 'alpha_words') THEN round(alpha_word_fraction, 2) || ' of words have a letter, fewer than 0.8' END,
  CASE WHEN list_contains(gates, 'stopwords') THEN stopword_hits || ' of the stop words occur, fewer than 2' END,
  CASE WHEN list_contains(gates, 'dup_lines') THEN round(dup_line_fraction, 2) || ' of lines repeat, more than 0.3' END,
  CASE WHEN list_contains(gates, 'repeated_ngrams') THEN round(dup_5, 2) || ' of characters in repeated 5-grams, bound 0.15' END,
  CASE WHEN list_contains(gates, 'unterminated_lines') THEN round(punct_line_fraction, 2) || ' of lines end in a mark, fewer than 0.12' END,
  CASE WHEN list_contains(gates, 'short_lines') THEN round(short_line_fraction, 2) || ' of lines are short, more than 0.67' END,
  CASE WHEN list_contains(gates, 'newline_ratio') THEN round(newline_word_ratio, 2) || ' line ends a word, more than 0.3' END,
  CASE WHEN list_contains(gates, 'boilerplate_marker') THEN 'a boilerplate marker occurs: true' END], lambda x: x IS NOT NULL), '; ') AS why FROM candidates WHERE is_candidate"""


@query("gate_explanations", QUALITY + EXPLAINED, bare=True)
def gate_explanations(spark, d):
    return _evaluated(spark, d).filter("is_candidate").select("doc_id", F.array_join(tq.explain(), "; ").alias("why"))


# --- URLs -----------------------------------------------------------------------------------------------------------

_KEY = r"""
, p AS (SELECT page_id, url, regexp_extract(trim(url), '^([^#]+?)://([^/#]*)(/[^?#]*)?(\?[^#]*)?', ['scheme', 'auth', 'path', 'query']) AS s FROM pages),
h AS (SELECT *, lower(regexp_replace(regexp_replace(s.auth, '^.*@', ''), ':[^:]*$', '')) AS host, regexp_extract(s.auth, ':([^:@]*)$', 1) AS port,
             list_filter(string_split(s.path, '/'), lambda x: x NOT IN ('', '.')) AS seg,
             list_sort(list_transform(list_filter(string_split(substr(s.query, 2), '&'), lambda q: q <> ''), lambda q: {'k': lower(split_part(q, '=', 1)), 'v': CASE WHEN contains(q, '=') THEN regexp_replace(q, '^[^=]*=', '') ELSE '' END})) AS pairs FROM p),
k AS (SELECT *, regexp_replace(regexp_replace(host, '^(www\.|m\.|mobile\.|amp\.)', ''), '\.+$', '') AS bare,
             CASE WHEN lower(seg[-1]) IN ('index.html', 'index.htm', 'index.php', 'index.asp', 'index.aspx', 'default.aspx') THEN seg[:-2] ELSE seg END AS path,
             array_to_string(list_transform(list_filter(pairs, lambda q: q.k <> '' AND NOT starts_with(q.k, 'utm_') AND NOT starts_with(q.k, 'pk_') AND NOT starts_with(q.k, 'piwik_')
               AND q.k NOT IN ('fbclid', 'gclid', 'gbraid', 'wbraid', 'dclid', 'msclkid', 'yclid', 'twclid', 'ttclid', 'igshid', 'mc_cid', 'mc_eid', '_ga', '_gl', 'ref_src', 'ref_url', 'scid', 'vero_id', 'wickedid', 'oly_anon_id', 'oly_enc_id', '__s', 'rb_clickid', 's_cid', 'sessionid', 'session_id', 'jsessionid', 'phpsessid', 'aspsessionid', 'sid')),
               lambda q: CASE WHEN q.v = '' THEN q.k ELSE q.k || '=' || q.v END), '&') AS q FROM h),
keys AS (SELECT page_id, url, s, seg, 'http://' || bare || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || array_to_string(list_transform(path, lambda x: '/' || x), '') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url FROM k)
"""
URLS = "WITH one AS (SELECT 1)" + _KEY


@query("canonical_url", URLS + "SELECT page_id, canonical_url FROM keys", bare=True)
def canonical_url(spark, d):
    return m.pages(spark, d).select("page_id", url.canonical_key(F.col("url")).alias("canonical_url"))


@query("url_class", r"""SELECT page_id, CASE WHEN x IN ('jpg','jpeg','png','gif','svg','webp','bmp','ico','tif','tiff','avif','heic') THEN 'image' WHEN x IN ('mp4','webm','mov','avi','mkv','mp3','wav','ogg','flac','m4a','m4v','wmv') THEN 'media'
  WHEN x IN ('zip','gz','tgz','bz2','xz','7z','rar','tar','iso','dmg') THEN 'archive' WHEN x IN ('pdf','doc','docx','ppt','pptx','xls','xlsx','epub') THEN 'binary_document' ELSE 'page' END AS url_class
  FROM (SELECT page_id, lower(regexp_extract(regexp_extract(url, '^[^#]+?://[^/#]*(/[^?#]*)?', 1), '\.([^./]*)$', 1)) AS x FROM pages)""", bare=True)
def url_class(spark, d):
    return m.pages(spark, d).select("page_id", url.url_class(F.col("url")).alias("url_class"))


@query("url_shape", URLS + "SELECT page_id, len(list_filter(string_split(s.path, '/'), lambda x: x <> ''))::INT AS path_depth, s.query <> '' AS has_query FROM keys", bare=True)
def url_shape(spark, d):
    return m.pages(spark, d).select("page_id", url.path_depth(F.col("url")).alias("path_depth"), url.has_query(F.col("url")).alias("has_query"))


EDITIONS = r"""WITH cut AS (SELECT page_id, regexp_extract(trim(url), '^([^#]+?)://([^/#]*)(/[^?#]*)?', ['scheme', 'auth', 'path']) AS s FROM pages),
editions AS (
  SELECT page_id, s.scheme || '://' || lower(regexp_replace(regexp_replace(s.auth, '^.*@', ''), ':[^:]*$', '')) || s.path AS url FROM cut WHERE len(list_filter(string_split(s.path, '/'), lambda x: x <> '')) > 0)
"""


@query("url_archive_edition", EDITIONS + _KEY.replace("FROM pages)", "FROM editions)") + "SELECT page_id, canonical_url AS archive_of FROM pages LEFT JOIN keys USING (page_id)", bare=True)
def url_archive(spark, d):
    edition = F.regexp_replace("url", r"^([^#]+?://[^/#]*)/", "$1/archives/spr2011/")
    return m.pages(spark, d).select("page_id", url.archive_edition_of(edition).alias("archive_of"))


@query("url_variant_groups", URLS + ", g AS (SELECT *, count(*) OVER (PARTITION BY canonical_url) AS n, row_number() OVER (PARTITION BY canonical_url ORDER BY strlen(url), url) AS r, first_value(url) OVER (PARTITION BY canonical_url ORDER BY strlen(url), url) AS keeper_id FROM keys) SELECT url AS document_id, keeper_id, r = 1 AS is_keeper, n AS group_size FROM g WHERE n > 1", bare=True)
def url_variant_groups(spark, d):
    p = m.pages(spark, d).select(F.col("url").alias("id"), F.lit(None).cast("string").alias("link"), url.canonical_key(F.col("url")).alias("canonical_url"), F.lit(1).alias("connector_id"))
    return duplicates.groups(p, "canonical_url", "url").select("document_id", "keeper_id", "is_keeper", "group_size")


# --- duplicates -----------------------------------------------------------------------------------------------------

def _groups_sql(order: str) -> str:
    return f"""SELECT id AS document_id, first_value(id) OVER w AS keeper_id, count(*) OVER (PARTITION BY content_hash) AS group_size,
      (SELECT count(DISTINCT connector_id) > 1 FROM document x WHERE x.content_hash = d.content_hash) AS cross_connector
      FROM document d WHERE content_hash IN (SELECT content_hash FROM document GROUP BY 1 HAVING count(*) > 1) WINDOW w AS (PARTITION BY content_hash ORDER BY {order}, id)"""


def _register_exact(name: str, policy_name: str, order: str) -> None:
    @query(name, _groups_sql(order))
    def run(spark, d):
        docs = ls.effective_recency(m.documents(spark, d))
        return duplicates.groups(docs, "content_hash", "hash", policy_name).select("document_id", "keeper_id", "group_size", "cross_connector")


_register_exact("exact_dup_groups", "shortest_url", "strlen(coalesce(link, id))")
_register_exact("dup_keeper_longest", "longest_content", "-coalesce(chunk_count, -1)")
_register_exact("dup_keeper_newest", "newest", "sort_ts IS NULL, -epoch_us(sort_ts)")


def _signed(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.signatures(spread(m.documents(spark, d, text=True)))


@query("shingles_count", r"SELECT id, CASE WHEN n = 0 THEN 0 WHEN n <= 5 THEN 1 ELSE n - 4 END::INT AS n_shingles FROM (SELECT id, len(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '')) AS n FROM document)")
def shingles_count(spark, d):
    return m.documents(spark, d, text=True).select("id", F.size(minhash.shingle_text(F.col("text"))).alias("n_shingles"))


@query("minhash_signature", near_sql.SIGNATURE)
def minhash_signature(spark, d):
    return _signed(spark, d).select("id", F.array_join("sig", ",").alias("sig"))


@query("minhash_bands", near_sql.BANDED)
def minhash_bands(spark, d):
    return _signed(spark, d).select("id", F.posexplode("bands").alias("band", "hash"))


@query("near_dup_pairs", near_sql.NEAR_PAIRS)
def near_dup_pairs(spark, d):
    return duplicates.near_pairs(_signed(spark, d))


@query("verified_jaccard", near_sql.VERIFIED)
def verified_jaccard(spark, d):
    pairs = duplicates.near_pairs(_signed(spark, d))
    return duplicates.verify_pairs(pairs, m.documents(spark, d, text=True)).select("a", "b", F.round("verified", 6).alias("verified"))


@query("max_similarity", near_sql.STRONGEST)
def max_similarity(spark, d):
    return duplicates.max_similarity(duplicates.near_pairs(_signed(spark, d)))


@query("near_dup_reasons", near_sql.REASONS)
def near_dup_reasons(spark, d):
    return duplicates.near_reasons(duplicates.near_pairs(_signed(spark, d)), m.documents(spark, d))


# --- detectors ------------------------------------------------------------------------------------------------------

RULES = (detect.Rule("odd sources", "url_rule", r"src1[0-9]\.", 0.7), detect.Rule("deep pages", "url_rule", "/page/"), detect.Rule("french", "tag_rule", "^lang=fr$", 0.9), detect.Rule("boosted", "tag_rule", "^2$"))


def _tagged(spark: SparkSession, d: str, text: bool = False) -> DataFrame:
    tags = m.tags(spark, d).groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.concat_ws("=", "tag_key", "tag_value"))).alias("tags"))
    return ls.effective_recency(m.documents(spark, d, text)).join(tags, "id", "left")


@query("stub_docs", "SELECT id, floor((epoch(TIMESTAMP '2024-01-31') - epoch(sort_ts)) / 86400)::INT AS age FROM document WHERE chunk_count = 0 AND epoch(TIMESTAMP '2024-01-31') - epoch(sort_ts) >= 7 * 86400")
def stub_docs(spark, d):
    found = detect.reasons(ls.effective_recency(m.documents(spark, d)), detect.stub(m.NOW))
    return found.select("id", F.col("reasons")[0]["detail"].cast("int").alias("age"))


@query("thin_docs", r"SELECT id, n::INT AS words FROM (SELECT id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM document) WHERE n > 0 AND n < 40")
def thin_docs(spark, d):
    docs = m.documents(spark, d, text=True).select("id", tq.word_count(F.col("text")).alias("word_count"), F.lit(False).alias("clipped"))
    return detect.reasons(docs, detect.thin()).select("id", F.col("word_count").alias("words"))


@query("stale_docs", "SELECT d.id FROM document d JOIN first_connector f ON f.id = d.id JOIN cc_pair p ON p.connector_id = f.connector_id WHERE p.status IN ('ACTIVE', 'INITIAL_INDEXING') AND epoch(TIMESTAMP '2024-01-31') - epoch(sort_ts) >= 30 * 86400")
def stale_docs(spark, d):
    rows = ls.attribute(ls.effective_recency(m.documents(spark, d)).drop("connector_id"), m.attribution(spark, d), m.connectors(spark, d), m.cc_pairs(spark, d))
    rows = rows.withColumn("recrawl_risk", ls.recrawl_risk(F.col("cc_status")))
    return detect.reasons(rows, detect.stale(m.NOW, days=30)).select("id")


@query("asset_urls", r"""SELECT id, chunk_count FROM (SELECT url || CASE WHEN page_id % 7 = 0 THEN '.png' ELSE '' END AS id, (page_id % 3)::INT AS chunk_count FROM pages)
  WHERE chunk_count <= 1 AND lower(regexp_extract(regexp_extract(id, '^[^#]+?://[^/#]*(/[^?#]*)?', 1), '\.([^./]*)$', 1)) IN ('jpg','jpeg','png','gif','svg','webp','bmp','ico','tif','tiff','avif','heic',
    'mp4','webm','mov','avi','mkv','mp3','wav','ogg','flac','m4a','m4v','wmv','zip','gz','tgz','bz2','xz','7z','rar','tar','iso','dmg')""", bare=True)
def asset_urls(spark, d):
    p = m.pages(spark, d).select(F.concat("url", F.when(F.col("page_id") % 7 == 0, ".png").otherwise("")).alias("id"), (F.col("page_id") % 3).cast("int").alias("chunk_count"), F.lit(1).alias("connector_id"))
    return detect.reasons(p.withColumn("url_class", url.url_class(F.col("id"))), detect.asset_url()).select("id", "chunk_count")


@query("url_rule_hits", r"SELECT id, regexp_extract(id, 'src1[0-9]\.') AS evidence FROM document WHERE regexp_matches(id, 'src1[0-9]\.')")
def url_rule_hits(spark, d):
    return detect.reasons(m.documents(spark, d), detect.url_rule(RULES[0])).select("id", F.col("reasons")[0]["evidence"].alias("evidence"))


@query("tag_rule_hits", "SELECT document_id AS id, string_agg(CASE WHEN tag_value = 'fr' THEN 'french' ELSE 'boosted' END, ',' ORDER BY tag_key DESC) AS rules FROM tag WHERE (tag_key = 'lang' AND tag_value = 'fr') OR (tag_key = 'boost' AND tag_value = '2') GROUP BY 1")
def tag_rule_hits(spark, d):
    found = detect.reasons(_tagged(spark, d), detect.tag_rule(RULES[2]), detect.tag_rule(RULES[3]))
    return found.select("id", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("rules"))


@query("rule_preview", "SELECT count(*) AS matched, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM document WHERE contains(id, '/page/') ORDER BY id LIMIT 20)) AS samples FROM document WHERE contains(id, '/page/')")
def rule_preview(spark, d):
    return detect.preview(m.documents(spark, d), RULES[1]).select("matched", F.array_join("samples", ",").alias("samples"))


@query("language_flags", near_sql.LANGUAGE)
def language_flags(spark, d):
    docs = spread(m.documents(spark, d, text=True).select("id", "lang", "text"))
    half = F.greatest(F.lit(1), (F.length("text") / 2).cast("int"))
    verdict = language.detect_document(F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))))
    found = keep(docs.select("id", "lang", verdict.alias("v")), "languages")  # so that no filter asks for a verdict again
    found = found.select("id", "lang", F.col("v.code").alias("lang_code"), F.col("v.confidence").alias("lang_confidence"), F.col("v.mixed_with").alias("mixed_with"))
    return detect.reasons(found, detect.lang_not_allowed(("en",))).select("id", "lang", "lang_code")


# --- profiles, policies, triage -------------------------------------------------------------------------------------

PROFILE = """
, profile AS (
  SELECT id AS document_id, connector_id, chunk_count, CASE WHEN doc_id % 19 = 0 THEN 'image' ELSE 'page' END AS url_class,
    CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 100) / 100 END AS max_jaccard, CASE WHEN doc_id % 4 <> 0 THEN (SELECT min(id) FROM document) END AS max_jaccard_doc,
    CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 97) / 97 END AS max_cosine, CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 6)::INT END AS quality_fail_count, CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 4)::INT END AS quality_families,
    (doc_id % 1000) / 10 AS centroid_pct FROM document),
grp AS (
  SELECT id AS document_id, row_number() OVER w <> 1 AS loser, NOT (SELECT count(DISTINCT connector_id) > 1 FROM document x WHERE x.content_hash = d.content_hash) AS guarded
  FROM document d WHERE content_hash IN (SELECT content_hash FROM document GROUP BY 1 HAVING count(*) > 1) WINDOW w AS (PARTITION BY content_hash ORDER BY strlen(id), id)),
first_doc AS (SELECT id, connector_id FROM document ORDER BY id LIMIT 1),
prepared AS (
  SELECT p.*, coalesce(g.loser, false) AS in_hash, coalesce(g.loser AND g.guarded, false) AS in_hash_guarded,
    p.max_jaccard_doc IS NOT NULL AND p.connector_id <> (SELECT connector_id FROM first_doc) AS crosses
  FROM profile p LEFT JOIN grp g ON g.document_id = p.document_id),
banded AS (
  SELECT *, coalesce(in_hash_guarded OR (url_class = 'image' AND coalesce(chunk_count, 0) <= 1) OR chunk_count = 0 OR (max_jaccard >= {auto} AND NOT crosses), false)
    OR coalesce(in_hash_guarded, false) OR coalesce(chunk_count = 0, false) OR coalesce(url_class = 'image' AND coalesce(chunk_count, 0) <= 1, false) OR coalesce(max_jaccard >= {auto} AND NOT crosses, false) AS auto,
    coalesce(in_hash, false) OR coalesce(url_class = 'image' AND coalesce(chunk_count, 0) <= 1, false) OR coalesce(chunk_count = 0, false) OR coalesce(max_jaccard >= {review}, false) OR coalesce(max_cosine >= {cosine}, false)
    OR coalesce(quality_fail_count >= {failures} AND quality_families >= {families}, false) AS review FROM prepared)
"""
STANDARD = PROFILE.format(auto=0.9, review=0.8, cosine=0.93, failures=3, families=2)


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """A measured profile of every document, by arithmetic on its id."""
    docs, n = m.documents(spark, d), F.col("doc_id")
    first = docs.agg(F.min("id").alias("_first"))
    rows = docs.join(F.broadcast(first), how="cross")  # one row
    return rows.select(
        F.col("id").alias("document_id"), "connector_id", "chunk_count", F.when(n % 19 == 0, "image").otherwise("page").alias("url_class"),
        F.when(n % 4 != 0, (n % 100) / 100).alias("max_jaccard"), F.when(n % 4 != 0, F.col("_first")).alias("max_jaccard_doc"),
        F.when(n % 5 != 0, (n % 97) / 97).alias("max_cosine"), F.lit(None).cast("string").alias("max_cosine_doc"),
        F.when(n % 6 != 0, (n % 6).cast("int")).alias("quality_fail_count"), F.when(n % 6 != 0, (n % 4).cast("int")).alias("quality_families"), ((n % 1000) / 10).alias("centroid_pct"))


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    docs = ls.effective_recency(m.documents(spark, d))
    p = _profiles(spark, d)
    owner = docs.select(F.col("id").alias("max_jaccard_doc"), F.col("connector_id").alias("other_connector"))
    pairs = p.filter("max_jaccard_doc is not null").join(owner, "max_jaccard_doc").select(
        F.least("document_id", "max_jaccard_doc").alias("a"), F.greatest("document_id", "max_jaccard_doc").alias("b"), (F.col("connector_id") == F.col("other_connector")).alias("same_connector"))
    return policy.prepare(p, duplicates.groups(docs, "content_hash", "hash"), pairs)


ASSET = "coalesce(url_class = 'image' AND coalesce(chunk_count, 0) <= 1, false)"
#: Per tier: what is enough for auto, and what for review besides.
TIERS = {
    "conservative": (("in_hash_guarded", "chunk_count = 0", "max_jaccard >= 0.95 AND NOT crosses"), ("in_hash", ASSET, "max_jaccard >= 0.85", "max_cosine >= 0.97", "quality_fail_count >= 4 AND quality_families >= 3")),
    "standard": (("in_hash_guarded", ASSET, "chunk_count = 0", "max_jaccard >= 0.9 AND NOT crosses"), ("in_hash", "max_jaccard >= 0.8", "max_cosine >= 0.93", "quality_fail_count >= 3 AND quality_families >= 2")),
    "aggressive": (("in_hash_guarded", ASSET, "chunk_count = 0", "max_jaccard >= 0.85 AND NOT crosses", "max_cosine >= 0.97"),
                   ("in_hash", "max_jaccard >= 0.75", "max_cosine >= 0.88", "quality_fail_count >= 2 AND quality_families >= 2", "centroid_pct <= 1.0")),
}


def _any_of(tests: tuple[str, ...]) -> str:
    return " OR ".join(f"coalesce({t}, false)" for t in tests)


def _register_simulation(tier: str) -> None:
    auto, review = (_any_of(t) for t in TIERS[tier])
    sql = STANDARD + f""", tiered AS (SELECT {auto} AS sure, {review} AS unsure FROM prepared)
      SELECT count(*) AS profiled, count(*) FILTER (sure) AS auto, count(*) FILTER (unsure AND NOT sure) AS review, count(*) FILTER (NOT sure AND NOT unsure) AS untouched FROM tiered"""

    @query(f"policy_simulate_{tier}", sql)
    def run(spark, d):
        prepared = _prepared(spark, d)
        return policy.simulate(_profiles(spark, d), prepared, policy.PRESETS[tier])


for _tier in TIERS:
    _register_simulation(_tier)


@query("policy_by_signal", STANDARD + """SELECT * FROM (
  SELECT 'exact_duplicate' AS signal, 'auto' AS band, count(*) FILTER (in_hash_guarded) AS n FROM prepared UNION ALL SELECT 'exact_duplicate', 'review', count(*) FILTER (in_hash) FROM prepared
  UNION ALL SELECT 'asset', 'auto', count(*) FILTER (url_class = 'image' AND coalesce(chunk_count, 0) <= 1) FROM prepared UNION ALL SELECT 'stub', 'auto', count(*) FILTER (chunk_count = 0) FROM prepared
  UNION ALL SELECT 'near_duplicate', 'auto', count(*) FILTER (max_jaccard >= 0.9 AND NOT crosses) FROM prepared
  UNION ALL SELECT 'near_duplicate', 'review', count(*) FILTER (max_jaccard >= 0.9) + count(*) FILTER (max_jaccard >= 0.8) FROM prepared
  UNION ALL SELECT 'semantic', 'review', count(*) FILTER (max_cosine >= 0.93) FROM prepared UNION ALL SELECT 'quality', 'review', count(*) FILTER (quality_fail_count >= 3 AND quality_families >= 2) FROM prepared) WHERE n > 0""")
def policy_by_signal(spark, d):
    return policy.by_signal(_prepared(spark, d), policy.PRESETS["standard"]).groupBy("signal", "band").agg(F.sum("n").alias("n"))


@query("policy_by_connector", STANDARD + "SELECT connector_id, count(*) FILTER (auto) AS auto, count(*) FILTER (NOT auto) AS review, count(*) AS total FROM banded WHERE review GROUP BY 1 ORDER BY total DESC, connector_id LIMIT 50")
def policy_by_connector(spark, d):
    return policy.by_connector(_prepared(spark, d), policy.PRESETS["standard"])


@query("band_members_auto", STANDARD + "SELECT document_id FROM banded WHERE auto")
def band_members(spark, d):
    return policy.members(_prepared(spark, d), policy.PRESETS["standard"], "auto")


@query("band_members_review", STANDARD + "SELECT document_id FROM banded WHERE review AND NOT auto")
def band_members_review(spark, d):
    return policy.members(_prepared(spark, d), policy.PRESETS["standard"], "review")


@query("signals_per_doc", STANDARD + """SELECT document_id, array_to_string(list_filter([
  CASE WHEN in_hash_guarded THEN 'exact_duplicate:auto' WHEN in_hash THEN 'exact_duplicate:review' END, CASE WHEN url_class = 'image' AND coalesce(chunk_count, 0) <= 1 THEN 'asset:auto' END, CASE WHEN chunk_count = 0 THEN 'stub:auto' END,
  CASE WHEN max_jaccard >= 0.9 AND NOT crosses THEN 'near_duplicate:auto' WHEN max_jaccard >= 0.8 THEN 'near_duplicate:review' END, CASE WHEN max_cosine >= 0.93 THEN 'semantic:review' END,
  CASE WHEN quality_fail_count >= 3 AND quality_families >= 2 THEN 'quality:review' END], lambda x: x IS NOT NULL), ',') AS signals FROM banded WHERE review""")
def signals_per_doc(spark, d):
    return policy.signals_per_document(_prepared(spark, d), policy.PRESETS["standard"]).withColumn("signals", F.array_join("signals", ","))


def _register_commit(band: str, test: str, confidence: float) -> None:
    @query(f"policy_commit_{band}", "WITH s AS (" + ORACLES["signals_per_doc"] + "), b AS (" + STANDARD_WHOLE + f"SELECT document_id FROM banded WHERE {test})" + rf"""
SELECT document_id, 'policy_{band}' AS code, {confidence}::DOUBLE AS confidence, 'matched the {band} policy on: ' || replace(regexp_replace(signals, '([a-z_]+):([a-z]+)', '\1 (\2)', 'g'), ',', ', ') AS detail
FROM s JOIN b USING (document_id)""", bare=True)
    def run(spark, d):
        rows, p = _prepared(spark, d), policy.PRESETS["standard"]
        hits = policy.commit(rows, p, band, policy.members(rows, p, band).count(), "standard")
        empty = spark.createDataFrame([], "document_id string, state string, reasons array<struct<detector:string,code:string,detail:string,confidence:float,evidence:string>>")
        made = lifecycle.upsert(empty, hits, empty.select("document_id")).filter("outcome = 'inserted'")
        one = F.col("reasons")[0]
        return made.select("document_id", one["code"].alias("code"), F.round(F.col("confidence").cast("double"), 4).alias("confidence"), one["detail"].alias("detail"))


STANDARD_WHOLE = m.PRELUDE + STANDARD
_register_commit("auto", "auto", 0.95)
_register_commit("review", "review AND NOT auto", 0.7)


@query("policy_caveats", PROFILE.format(auto=0.9, review=0.8, cosine=0.93, failures=3, families=2) + "SELECT * FROM (SELECT 'quality was not measured' AS caveat, count(*) FILTER (quality_fail_count IS NULL) AS documents FROM profile UNION ALL SELECT 'no near-duplicate pair is on record', count(*) FILTER (max_jaccard IS NULL) FROM profile UNION ALL SELECT 'no embedding neighbour is on record', count(*) FILTER (max_cosine IS NULL) FROM profile) WHERE documents > 0")
def policy_caveats(spark, d):
    return policy.caveats(_profiles(spark, d), policy.PRESETS["standard"])


@query("eligible_profiles", STANDARD + "SELECT document_id FROM profile p JOIN document d ON d.id = p.document_id WHERE doc_id % 8 <> 0 AND doc_id % 9 <> 0 AND p.connector_id <> 3")
def eligible_profiles(spark, d):
    docs = m.documents(spark, d)
    held = docs.filter("doc_id % 8 = 0").select(F.col("id").alias("document_id"), F.lit("staged").alias("state"))
    excluded = docs.filter("doc_id % 9 = 0").select(F.col("id").alias("document_id"))
    return policy.eligible(_profiles(spark, d), held, excluded, docs, (3,)).select("document_id")


@query("profile_merge", STANDARD + "SELECT p.document_id, CASE WHEN d.doc_id % 2 = 0 THEN greatest(max_jaccard, 0.5) ELSE max_jaccard END AS max_jaccard, coalesce(chunk_count_new, p.chunk_count) AS chunk_count, quality_fail_count FROM profile p JOIN (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 7 END AS chunk_count_new FROM document) d ON d.id = p.document_id")
def profile_merge(spark, d):
    old = _profiles(spark, d).withColumn("quality_gates", F.lit(None).cast("string"))
    even = m.documents(spark, d).filter("doc_id % 2 = 0").select(F.col("id").alias("document_id"))
    new = old.join(even, "document_id", "left_semi").select("document_id", *[F.lit(None).cast(t).alias(c) for c, t in old.dtypes if c != "document_id"])
    new = new.withColumn("max_jaccard", F.lit(0.5)).withColumn("chunk_count", F.lit(7))
    return policy.merge_profiles(old, new).select("document_id", "max_jaccard", "chunk_count", "quality_fail_count")


@query("histogram_max_jaccard", STANDARD + "SELECT b + 1 AS bucket, b / 20 AS low, (b + 1) / 20 AS high, count(*) AS n FROM (SELECT least(floor(max_jaccard / 1.0 * 20), 19)::INT AS b FROM profile WHERE max_jaccard IS NOT NULL) GROUP BY b")
def histogram_jaccard(spark, d):
    return triage.histogram(_profiles(spark, d), "max_jaccard")


@query("histogram_chunks", STANDARD + ", e AS (SELECT min(chunk_count) AS lo, max(chunk_count) AS hi FROM profile) SELECT b + 1 AS bucket, round(lo + (hi - lo) / 10 * b, 9) AS low, count(*) AS n FROM (SELECT least(floor((chunk_count - lo) / (hi - lo) * 10), 9)::INT AS b, lo, hi FROM profile, e WHERE chunk_count IS NOT NULL) GROUP BY b, lo, hi")
def histogram_chunks(spark, d):
    return triage.histogram(_profiles(spark, d), "chunk_count", 10).select("bucket", F.round("low", 9).alias("low"), "n")


@query("histogram_tail", STANDARD + "SELECT count(*) AS n FROM profile WHERE floor(max_jaccard * 20) / 20 >= 0.8")
def histogram_tail(spark, d):
    return triage.tail_count(triage.histogram(_profiles(spark, d), "max_jaccard"), 0.8)


@query("clusters_page", "SELECT content_hash AS group_key, id AS document_id, row_number() OVER (PARTITION BY content_hash ORDER BY strlen(id), id) = 1 AS is_keeper FROM document WHERE content_hash IN (SELECT content_hash FROM document GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 20)")
def clusters_page(spark, d):
    return triage.clusters(duplicates.groups(ls.effective_recency(m.documents(spark, d)), "content_hash", "hash")).select("group_key", "document_id", "is_keeper")


@query("band_sample", STANDARD + "SELECT document_id FROM banded WHERE auto ORDER BY md5('7:' || document_id), document_id LIMIT 25")
def band_sample(spark, d):
    return triage.seeded_sample(policy.members(_prepared(spark, d), policy.PRESETS["standard"], "auto"), 25, 7)


@query("acceptance_plan", STANDARD + "SELECT n AS population, least(n, 60)::INT AS draws, round(CASE WHEN n > 0 THEN 1 - pow(1 - 0.95, 1 / least(n, 60)) ELSE 1 END, 9) AS bound FROM (SELECT count(*) AS n FROM banded WHERE auto)")
def acceptance_plan(spark, d):
    plan = triage.acceptance_plan(policy.members(_prepared(spark, d), policy.PRESETS["standard"], "auto"), 60)
    return plan.select("population", F.col("draws").cast("int").alias("draws"), F.round("bound", 9).alias("bound"))


# --- candidates and lifecycle ---------------------------------------------------------------------------------------

CANDIDATES = """
, cand AS (
  SELECT doc_id AS candidate_id, id AS document_id, connector_id, ['candidate', 'staged', 'deleting', 'deleted', 'restored', 'dismissed'][(doc_id % 6 + 1)::INT] AS state, (0.5 + (doc_id % 5) / 10)::FLOAT AS confidence,
    chunk_count, doc_id % 2 = 0 AS recrawl_risk, doc_id % 3 AS scan_id, TIMESTAMP '2024-01-31' - to_hours((doc_id % 50)::INT) AS created_at,
    CASE WHEN doc_id % 6 = 1 THEN TIMESTAMP '2024-01-31' + to_hours((doc_id % 100 - 50)::INT) END AS stage_expires_at,
    CASE doc_id % 4 WHEN 0 THEN ['quality'] WHEN 1 THEN ['duplicate'] WHEN 2 THEN ['quality', 'thin'] ELSE ['url_junk'] END AS detectors,
    CASE doc_id % 4 WHEN 0 THEN ['low_quality_text'] WHEN 1 THEN ['exact_duplicate_of'] WHEN 2 THEN ['low_quality_text', 'thin_content'] ELSE ['asset_url'] END AS codes FROM document)
"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """A candidate for every document, its state and reasons by arithmetic on its id."""
    n, now = F.col("doc_id"), F.lit(m.NOW).cast("timestamp")
    one = lambda det, code: detect.reason(det, code, F.lit("measured"), 0.5 + (n % 5) / 10, F.lit(None))
    quality, thin = one("quality", "low_quality_text"), one("thin", "thin_content")
    reasons = F.when(n % 4 == 0, F.array(quality)).when(n % 4 == 1, F.array(one("duplicate", "exact_duplicate_of"))).when(n % 4 == 2, F.array(quality, thin)).otherwise(F.array(one("url_junk", "asset_url")))
    states = F.array(*[F.lit(s) for s in lifecycle.STATES])
    return m.documents(spark, d).select(
        n.alias("candidate_id"), F.col("id").alias("document_id"), "connector_id", F.element_at(states, (n % 6 + 1).cast("int")).alias("state"), reasons.alias("reasons"),
        (0.5 + (n % 5) / 10).cast("float").alias("confidence"), "chunk_count", (n % 2 == 0).alias("recrawl_risk"), (n % 3).alias("scan_id"), (now - F.make_dt_interval(hours=(n % 50).cast("int"))).alias("created_at"),
        F.when(n % 6 == 1, now + F.make_dt_interval(hours=(n % 100 - 50).cast("int"))).alias("stage_expires_at"))


@query("funnel_bundles", CANDIDATES + "SELECT code, detector, count(*) AS documents, sum(coalesce(chunk_count, 0))::BIGINT AS chunks, round(avg(confidence::DOUBLE), 6) AS mean_confidence, count(*) FILTER (recrawl_risk) AS at_risk FROM (SELECT *, unnest(codes) AS code, unnest(detectors) AS detector FROM cand) GROUP BY ALL")
def funnel_bundles(spark, d):
    return triage.bundles(_candidates(spark, d)).drop("title").withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("funnel_connectors", CANDIDATES + "SELECT connector_id, count(*) AS documents, sum(coalesce(chunk_count, 0))::BIGINT AS chunks FROM cand GROUP BY 1")
def funnel_connectors(spark, d):
    return triage.connector_funnel(_candidates(spark, d))


@query("candidate_filter", CANDIDATES + "SELECT candidate_id FROM cand WHERE state IN ('candidate', 'staged', 'deleting') AND list_contains(detectors, 'quality') AND confidence >= 0.7::FLOAT AND recrawl_risk ORDER BY confidence DESC, candidate_id DESC LIMIT 100")
def candidate_filter(spark, d):
    rows = lifecycle.filter_candidates(_candidates(spark, d), detector="quality", min_confidence=0.7, recrawl_risk=True)
    return rows.orderBy(*lifecycle.CANDIDATE_ORDERS["confidence"]()).limit(100).select("candidate_id")


@query("due_candidates", CANDIDATES + "SELECT candidate_id FROM cand WHERE state = 'staged' AND stage_expires_at <= TIMESTAMP '2024-01-31'")
def due_candidates(spark, d):
    return lifecycle.filter_candidates(_candidates(spark, d), m.NOW, due_only=True).select("candidate_id")


@query("reason_merge", CANDIDATES + "SELECT candidate_id, array_to_string(list_concat(list_filter(codes, lambda c: c <> 'low_quality_text'), ['low_quality_text']), ',') AS codes, greatest(CASE WHEN len(list_filter(codes, lambda c: c <> 'low_quality_text')) > 0 THEN confidence ELSE 0 END, 0.6::FLOAT)::DOUBLE AS confidence FROM cand")
def reason_merge(spark, d):
    new = F.array(detect.reason("quality", "low_quality_text", F.lit("again"), 0.6, F.lit(None)))
    rows = _candidates(spark, d).withColumn("reasons", lifecycle.merge_reasons(F.col("reasons"), new))
    return rows.select("candidate_id", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("codes"), lifecycle.top_confidence(F.col("reasons")).cast("double").alias("confidence"))


@query("candidate_upsert", CANDIDATES + "SELECT document_id, CASE WHEN candidate_id % 7 = 0 THEN 'excluded' WHEN state NOT IN ('candidate', 'staged', 'deleting') THEN 'inserted' WHEN state = 'candidate' THEN 'merged' ELSE 'left' END AS outcome FROM cand")
def candidate_upsert(spark, d):
    c = _candidates(spark, d)
    hits = c.select("document_id", F.array(detect.reason("thin", "chunkless_stub", F.lit("0"), 0.9, F.lit(None))).alias("reasons"))
    return lifecycle.upsert(c, hits, c.filter("candidate_id % 7 = 0").select("document_id")).select("document_id", "outcome")


@query("close_stale", CANDIDATES + "SELECT candidate_id FROM cand WHERE state = 'candidate' AND scan_id <> 1 AND len(list_filter(detectors, lambda x: x NOT IN ('quality', 'duplicate'))) = 0")
def close_stale(spark, d):
    return lifecycle.close_stale(_candidates(spark, d), 1, ("quality", "exact_duplicate")).filter("resolution is not null").select("candidate_id")


@query("stage_transition", CANDIDATES + "SELECT candidate_id, CASE WHEN state = 'candidate' THEN 'done' ELSE 'conflict' END AS outcome, CASE WHEN state = 'candidate' THEN 'staged' ELSE state END AS state FROM cand WHERE candidate_id % 5 = 0")
def stage_transition(spark, d):
    c = _candidates(spark, d)
    _, outcomes = lifecycle.transition(c, c.filter("candidate_id % 5 = 0").select("candidate_id", F.lit("stage").alias("command")), m.NOW)
    return outcomes.select("candidate_id", "outcome", "state")


@query("state_after_commands", CANDIDATES + "SELECT CASE WHEN state = 'candidate' THEN 'staged' WHEN state = 'staged' THEN 'restored' WHEN state = 'deleting' THEN 'deleted' ELSE state END AS state, count(*) AS n FROM cand GROUP BY 1")
def state_after(spark, d):
    c = _candidates(spark, d)
    command = F.when(F.col("state") == "candidate", "stage").when(F.col("state") == "staged", "restore").otherwise("mark_deleted")
    new, _ = lifecycle.transition(c, c.select("candidate_id", command.alias("command")), m.NOW)
    return new.groupBy("state").agg(F.count("*").alias("n"))


@query("staged_visibility", CANDIDATES + """, own AS (SELECT DISTINCT document_id FROM cand WHERE state = 'candidate')
SELECT id, coalesce(hidden, FALSE) OR o.document_id IS NOT NULL AS staged, hidden AS restored FROM document d LEFT JOIN own o ON o.document_id = d.id""")
def staged_visibility(spark, d):
    """Documents hidden by staging their candidates, and shown as they were by restoring them."""
    c, docs = _candidates(spark, d), m.documents(spark, d).select("id", "hidden")
    asked = c.filter("state = 'candidate'").select("candidate_id", F.lit("stage").alias("command"))
    after, outcomes = lifecycle.transition(c, asked, m.NOW)
    noted, hidden = lifecycle.visibility(after, docs, outcomes)
    _, undone = lifecycle.transition(noted, asked.select("candidate_id", F.lit("restore").alias("command")), m.NOW)
    _, shown = lifecycle.visibility(noted, hidden, undone)
    return hidden.withColumnRenamed("hidden", "staged").join(shown.withColumnRenamed("hidden", "restored"), "id")


@query("reaper_plan", CANDIDATES + ", due AS (SELECT *, connector_id % 5 = 0 AS busy FROM cand WHERE state = 'staged' AND stage_expires_at <= TIMESTAMP '2024-01-31') SELECT candidate_id, CASE WHEN busy THEN 'deferred_busy' WHEN row_number() OVER (PARTITION BY busy ORDER BY stage_expires_at, candidate_id) <= 25 THEN 'delete' ELSE 'deferred_budget' END AS action FROM due")
def reaper_plan(spark, d):
    busy = m.connectors(spark, d).filter("id % 5 = 0").select(F.col("id").alias("connector_id"))
    return lifecycle.reaper_plan(_candidates(spark, d), busy, m.NOW, 40, 15)


@query("state_counts", CANDIDATES + "SELECT " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in lifecycle.STATES) + ", count(*) FILTER (state = 'staged' AND stage_expires_at <= TIMESTAMP '2024-01-31') AS due FROM cand")
def state_counts(spark, d):
    return lifecycle.state_counts(_candidates(spark, d), m.NOW).drop("next_due")


@query("recrawled_restage", CANDIDATES + "SELECT document_id FROM cand WHERE candidate_id % 4 = 0 AND state NOT IN ('candidate', 'staged', 'deleting')")
def recrawled(spark, d):
    c = _candidates(spark, d)
    return lifecycle.recrawled(c.filter("candidate_id % 4 = 0").select("document_id"), m.documents(spark, d), c)


@query("live_chunk_count", CANDIDATES + "SELECT candidate_id, CASE WHEN candidate_id % 3 = 0 THEN 99 ELSE chunk_count END AS chunk_count, candidate_id % 3 <> 0 AS doc_exists FROM cand")
def live_chunks(spark, d):
    c = _candidates(spark, d).withColumn("chunk_count", F.lit(99))
    return lifecycle.live_chunk_count(c, m.documents(spark, d).filter("doc_id % 3 <> 0")).select("candidate_id", "chunk_count", "doc_exists")


def _trash(spark: SparkSession, d: str) -> DataFrame:
    docs = m.documents(spark, d)
    chunks = docs.select(F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit("x").alias("content"))
    t = lifecycle.capture(docs, m.tags(spark, d), m.attribution(spark, d), chunks, m.NOW, 5)
    return t.join(docs.select(F.col("id").alias("document_id"), "doc_id"), "document_id").withColumn("hold", F.col("doc_id") % 4 == 0)


@query("trash_counts", "SELECT count(*) AS items, count(*) FILTER (doc_id % 4 <> 0) AS expiring_7d, count(*) FILTER (doc_id % 4 = 0) AS on_hold FROM document")
def trash_counts(spark, d):
    return lifecycle.trash_counts(_trash(spark, d), m.NOW).select("items", "expiring_7d", "on_hold")


@query("trash_capture_complete", "SELECT id AS document_id, chunk_count IS NULL OR 1 >= chunk_count AS complete FROM document")
def trash_capture(spark, d):
    return _trash(spark, d).select("document_id", "complete")


@query("trash_restore_plan", "SELECT id AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'refused_exists' ELSE 'restored' END AS outcome, (SELECT count(*) FROM attribution a WHERE a.id = d.id AND a.connector_id > 10) AS missing_connectors FROM document d")
def trash_restore(spark, d):
    return lifecycle.restore_plan(_trash(spark, d), m.documents(spark, d).filter("doc_id % 2 = 0"), m.connectors(spark, d).filter("id <= 10"))


@query("cascade_delete", "SELECT (SELECT count(*) FROM document WHERE doc_id % 10 <> 0) AS documents, (SELECT count(*) FROM tag t JOIN document d ON d.id = t.document_id WHERE doc_id % 10 <> 0) AS tags, (SELECT count(*) FROM attribution a JOIN document d ON d.id = a.id WHERE doc_id % 10 <> 0) AS links")
def cascade(spark, d):
    docs = m.documents(spark, d)
    gone = docs.filter("doc_id % 10 = 0").select(F.col("id").alias("document_id"))
    left = lifecycle.cascade({"documents": (docs, "id"), "tags": (m.tags(spark, d), "document_id"), "links": (m.attribution(spark, d), "id")}, gone)
    counts = [left[k].agg(F.count("*").alias(k)) for k in ("documents", "tags", "links")]
    return reduce(lambda a, b: a.join(F.broadcast(b), how="cross"), counts)  # one row each


@query("annotations_newest", "SELECT user_id AS subject_key, arg_max(event_type, (ts, event_type)) AS model FROM events GROUP BY 1", bare=True)
def annotations_newest(spark, d):
    e = m.table(spark, d, "events").select(F.col("user_id").alias("subject_key"), F.col("ts").alias("generated_at"), F.col("event_type").alias("model"))
    return lifecycle.newest_annotations(e).select("subject_key", "model")


@query("annotations_missing", "SELECT DISTINCT user_id AS subject_key FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')", bare=True)
def annotations_missing(spark, d):
    e = m.table(spark, d, "events").select(F.col("user_id").alias("subject_key"), F.col("event_type").alias("model"), F.lit("h").alias("prompt_hash"))
    return lifecycle.missing_annotations(e.select("subject_key").distinct(), e, "purchase", "h")


@query("trailing_deletions", "SELECT event_id, count(*) OVER (ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS trailing FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)", bare=True)
def trailing_deletions(spark, d):
    e = m.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return lifecycle.trailing_deletions(e).select("event_id", "trailing")


# --- answers, grades, search, vectors -------------------------------------------------------------------------------

@query("extract_answer", "SELECT event_id, coalesce(json_extract_string('{\"answer\": ' || json_extract_string(props, '$.k') || '}', '$.answer'), '') AS answer FROM events", bare=True)
def extract_answer(spark, d):
    reply = F.concat(F.lit('{"answer": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return m.table(spark, d, "events").select("event_id", tx.extract_answer(reply).alias("answer"))


@query("judge_expected_grade", "SELECT event_id, round((2 * 0.6 + (event_id % 4) * 0.3) / 0.9, 9) AS grade, round(greatest(0.6, 0.3) / 0.9, 9) AS confidence FROM events", bare=True)
def expected_grade(spark, d):
    opt = lambda t, p: F.struct(t.cast("string").alias("token"), F.lit(p).alias("p"))
    graded = tx.expected_grade(F.array(opt(F.lit(" 2"), 0.6), opt(F.col("event_id") % 4, 0.3), opt(F.lit("x"), 0.1)))
    return m.table(spark, d, "events").select("event_id", F.round(graded["grade"], 9).alias("grade"), F.round(graded["confidence"], 9).alias("confidence"))


@query("prompt_sanitize", r"SELECT doc_id, length(replace(substr(text, 1, 4000), '<|', '< |')) AS n FROM documents", bare=True)
def prompt_sanitize(spark, d):
    return m.table(spark, d, "documents").select("doc_id", F.length(tx.sanitize(F.col("text"))).cast("long").alias("n"))


@query("truncate_utf8", "SELECT doc_id, list_max(list_filter(list_transform(range(0, 101), lambda i: strlen(substr(text, 1, i))), lambda b: b <= 100))::INT AS n_bytes FROM documents", bare=True)
def truncate(spark, d):
    return m.table(spark, d, "documents").select("doc_id", F.octet_length(tx.truncate_utf8(F.col("text"), 100)).alias("n_bytes"))


TERMS = ("the", "energy", "tion")
BM25 = r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM conversations),
c AS (SELECT conv_id, turn, len(w) AS l, len(list_filter(w, lambda x: x = 'the')) AS f1, len(list_filter(w, lambda x: x = 'was')) AS f2 FROM t),
s AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM c),
b AS (SELECT conv_id, turn, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / a)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * l / a)) AS score FROM c, s WHERE f1 + f2 > 0)
"""


@query("bm25_keyword", BM25 + "SELECT 'conv/' || conv_id AS document_id, turn::INT AS chunk_index, round(score, 6) AS score FROM b", bare=True)
def bm25_keyword(spark, d):
    return search.bm25(m.chunks(spark, d), "the was", "content").withColumn("score", F.round("score", 6))


@query("search_collapse", BM25 + "SELECT 'conv/' || conv_id AS document_id, round(max(score), 6) AS score FROM b GROUP BY conv_id ORDER BY max(score) DESC, document_id LIMIT 20", bare=True)
def search_collapse(spark, d):
    return search.collapse(search.keyword(m.chunks(spark, d), "the was", {"content": 1.0})).select("document_id", F.round("score", 6).alias("score"))


@query("search_total", BM25 + "SELECT least(count(DISTINCT conv_id), 10000)::BIGINT AS total, count(DISTINCT conv_id) <= 10000 AS exact FROM b", bare=True)
def search_total(spark, d):
    return search.tracked_total(search.bm25(m.chunks(spark, d), "the was", "content"))


@query("search_snippets", r"""SELECT document_id, chunk_index, CASE WHEN len(f) > 0 THEN array_to_string(list_transform(f[1:2], lambda x: regexp_replace(x, '(?i)\b(the|was)\b', '<em>\1</em>', 'g')), ' … ') ELSE title END AS snippet
  FROM (SELECT *, regexp_extract_all(content, '(?is).{0,80}\b(?:the|was)\b.{0,80}') AS f FROM chunk)""")
def snippets(spark, d):
    c = m.chunks(spark, d)
    return c.select("document_id", "chunk_index", search.snippet(F.col("content"), "the was", F.col("title")).alias("snippet"))


KNN = """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
n AS (SELECT vec_id AS document_id, label AS chunk_index, (1 + list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)::DOUBLE[])) / 2 AS score FROM embeddings)
"""


def _vector_chunks(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    v = m.vectors(spark, d)
    asked = v.filter("id = 0").first()["vector"]  # one row
    return v.select(F.col("id").alias("document_id"), F.col("label").alias("chunk_index"), F.col("vector").alias("content_vector")), asked


@query("knn_topk", KNN + "SELECT document_id, chunk_index, round(score, 6) AS score FROM n ORDER BY n.score DESC, document_id LIMIT 50", bare=True)
def knn_topk(spark, d):
    chunks, asked = _vector_chunks(spark, d)
    return search.semantic(chunks, asked).withColumn("score", F.round("score", 6))


@query("hybrid_search", KNN + ", k AS (SELECT * FROM n ORDER BY score DESC, document_id LIMIT 50) SELECT e.vec_id AS document_id, e.label AS chunk_index, round(coalesce(k.score * 0.6, 0) + CASE WHEN e.label = 3 THEN 0.4 ELSE 0 END, 6) AS score FROM embeddings e LEFT JOIN k ON k.document_id = e.vec_id WHERE k.score IS NOT NULL OR e.label = 3", bare=True)
def hybrid_search(spark, d):
    chunks, asked = _vector_chunks(spark, d)
    text = chunks.filter("chunk_index = 3").select("document_id", "chunk_index", F.lit(1.0).alias("score"))
    return search.hybrid(text, search.semantic(chunks, asked)).withColumn("score", F.round("score", 6))


@query("cosine_dup_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9", bare=True)
def cosine_dup_pairs(spark, d):
    return vec.cosine_pairs(m.vectors(spark, d), 0.9).withColumn("cosine", F.round("cosine", 6))


@query("centroid_percentile", "WITH c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS centroid_similarity, round(percent_rank() OVER (PARTITION BY e.label ORDER BY list_cosine_similarity(embedding::DOUBLE[], c)) * 100, 6) AS centroid_pct FROM embeddings e JOIN c ON c.label = e.label", bare=True)
def centroid_percentile(spark, d):
    return vec.centroid_similarity(m.vectors(spark, d), "label").select("id", F.round("centroid_similarity", 6).alias("centroid_similarity"), F.round("centroid_pct", 6).alias("centroid_pct"))


@query("cosine_calibration", "SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev(x), 6) AS sigma FROM (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)", bare=True)
def calibration(spark, d):
    v = m.vectors(spark, d)
    near = v.join(v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other")), "id").select(search.cosine(F.col("vector"), F.col("other")).alias("cosine"))
    return vec.calibrate(near, 0.9).select("n", F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"))


@query("f16_roundtrip", "SELECT vec_id AS id, true AS near FROM embeddings", bare=True)
def f16_roundtrip(spark, d):
    v = m.vectors(spark, d).withColumn("back", vec.f16_unpack(vec.f16_pack(F.col("vector"))))
    return v.select("id", F.forall(F.arrays_zip("vector", "back"), lambda p: F.abs(p["vector"] - p["back"]) <= 0.001).alias("near"))


# --- owned tables ---------------------------------------------------------------------------------------------------

@query("provider_stats", "SELECT lang AS provider, count(*) AS models, count(*) FILTER (doc_id % 2 = 0) AS probed, count(*) FILTER (doc_id % 4 = 0) AS usable FROM documents GROUP BY 1", bare=True)
def provider_stats(spark, d):
    docs = m.table(spark, d, "documents")
    return stores.provider_stats(docs.select(F.col("lang").alias("provider"), (F.col("doc_id") % 2 == 0).alias("probed"), (F.col("doc_id") % 4 == 0).alias("usable")))


@query("model_roles", "SELECT id AS model, CASE WHEN doc_id % 6 = 0 THEN 'bulk,quality' WHEN doc_id % 2 = 0 THEN 'bulk' WHEN doc_id % 3 = 0 THEN 'quality' ELSE '' END AS roles FROM document")
def model_roles(spark, d):
    docs, n = m.documents(spark, d), F.col("doc_id")
    assigned = docs.select(F.col("id").alias("model"), F.explode(F.array_compact(F.array(F.when(n % 3 == 0, "quality"), F.when(n % 2 == 0, "bulk")))).alias("role"))
    return stores.roles(docs.select(F.col("id").alias("model")), assigned).withColumn("roles", F.array_join("roles", ","))


@query("replace_models", "SELECT model, probed FROM (SELECT id AS model, doc_id % 2 = 0 AS probed FROM document WHERE lang <> 'en' UNION ALL SELECT id, CASE WHEN doc_id % 3 = 1 THEN false ELSE doc_id % 2 = 0 END FROM document WHERE lang = 'en' AND doc_id % 3 <> 0)")
def replace_models(spark, d):
    docs, n = m.documents(spark, d), F.col("doc_id")
    stored = docs.filter((F.col("lang") != "en") | (n % 3 != 1)).select(F.col("id").alias("model"), F.col("lang").alias("provider"), (n % 2 == 0).alias("probed"), (n % 2 == 0).alias("usable"))
    return stores.replace_models(stored, docs.filter((F.col("lang") == "en") & (n % 3 != 0)).select(F.col("id").alias("model")), "en").select("model", "probed")


@query("retry_queue_enqueue", "SELECT id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS attempts FROM document WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def retry_enqueue(spark, d):
    docs = m.documents(spark, d)
    queue = docs.filter("doc_id % 3 = 0").select(F.col("id").alias("document_id"), F.col("last_modified").alias("queued_at"), F.lit(2).alias("attempts"))
    return stores.enqueue(queue, docs.filter("doc_id % 2 = 0").select(F.col("id").alias("document_id")), m.NOW).select("document_id", "attempts")


@query("cluster_evidence", "SELECT content_hash AS group_key, string_agg(CASE WHEN r = 1 THEN 'keeper: ' ELSE 'copy: ' END || semantic_id, chr(10) ORDER BY r) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY k DESC, id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY strlen(id), id) = 1 AS k, count(*) OVER (PARTITION BY content_hash) AS n FROM document) WHERE n > 1) WHERE r <= 12 GROUP BY 1")
def cluster_evidence(spark, d):
    docs = ls.effective_recency(m.documents(spark, d))
    return stores.cluster_evidence(duplicates.groups(docs, "content_hash", "hash"), docs.select(F.col("id").alias("document_id"), F.col("semantic_id").alias("title")))


@query("annotation_counts", "SELECT event_type AS subject_kind, count(DISTINCT user_id) AS subjects, count(*) AS generations FROM events GROUP BY 1", bare=True)
def annotation_counts(spark, d):
    return stores.annotation_counts(m.table(spark, d, "events").select(F.col("event_type").alias("subject_kind"), F.col("user_id").alias("subject_key")))
