"""URL filters: rules by host and path, and association rules mined where none fits (DataFrame functions only).

Given rules (host, path, verdict) are found by an inverted index: each URL looks up the
suffixes of its host, and of the rules whose path starts the URL's path the longest wins.

URLs that no rule fits are judged by mined rules.  A URL is a set of tokens: the labels
of its host by their place from the right, the segments of its path by their place
(numbers by their first digit), the file type and the query's keys.  Spark's FP-growth
finds the combinations of tokens that are frequent together with a label; those with
enough confidence and at most ``LONGEST`` tokens stay, unless a part of the combination
says the same with no less confidence.  A mined rule stands in the index under its rarest
token only, so a token that all URLs have finds few rules; the other tokens are checked on
the row.  The most confident rule wins, of equals the one with more support, then ``block``,
then the first by text.  Without a rule the verdict is ``allow``.

Edge cases: a null URL, or one without ``://``, has an empty host and path and no tokens, fits no
rule and is allowed; a URL of any length is read whole; rows that repeat a page_id or a URL each
get a row (repeats count as often as they occur); extra columns are ignored, whatever their
names.  Without labelled rows nothing is mined; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The rules of the query: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Share of labelled rows that a combination and its label must have, and share of the combination's rows with that label.
SUPPORT, CONFIDENCE = 0.01, 0.9
#: Tokens of a mined rule, at most: longer ones are narrower than what they are to generalise.
LONGEST = 3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to a query or a fragment."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all domains it belongs to."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: d<place>=label, p<place>=segment, x=file type, q=key."""
    numbered = lambda kind, items: F.transform(items, lambda x, i: F.concat(F.lit(kind), (i + 1).cast("string"), F.lit("="), x))
    labels = F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != "")
    segment = lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("#"), F.substring(x, 1, 1))).otherwise(x)
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), segment)
    kind = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    keys = F.regexp_extract_all(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("(?:^|&)([^=&]+)"), F.lit(1))
    return F.array_distinct(F.concat(numbered("d", labels), numbered("p", segments), F.when(kind != "", F.array(F.concat(F.lit("x="), kind))).otherwise(F.array().cast("array<string>")),
                                     F.transform(keys, lambda k: F.concat(F.lit("q="), k))))


def by_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule, verdict) of rows (row, host, path) that a rule (host, path, verdict) fits."""
    index = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict")
    met = rows.filter("host <> ''").select("row", "path", F.explode(suffixes(F.col("host"))).alias("suffix")).join(index, "suffix").filter(F.startswith("path", "start"))
    length = F.length("suffix") + F.length("start")
    best = F.max(F.struct(length.alias("length"), F.length("suffix").alias("of_host"), F.concat("suffix", "start").alias("rule"), "verdict")).alias("best")
    return met.groupBy("row").agg(best).select("row", "best.rule", "best.verdict")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = LONGEST) -> DataFrame:
    """(items, key, verdict, confidence, support) of the rules in (tokens, verdict); ``key`` is the rarest token."""
    spark = labelled.sparkSession
    schema = "items array<string>, key string, verdict string, confidence double, support double"
    if labelled.isEmpty():
        return spark.createDataFrame([], schema)
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    said = F.element_at("consequent", 1)
    found = model.associationRules.filter(said.startswith("verdict:") & (F.size("antecedent") <= longest))
    found = common.keep(found.select(F.array_sort("antecedent").alias("items"), F.substring(said, 9, 1 << 30).alias("verdict"), "confidence", "support"), "url-rules")
    # A rule goes where a part of it says the same: parts by the bits of their mask.
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("items")).cast("int") - 2)
    part = F.transform(masks, lambda m: F.filter("items", lambda x, i: F.getbit(m.cast("long"), i) == 1))
    parts = found.filter(F.size("items") > 1).select("items", "verdict", "confidence", F.explode(part).alias("part"))
    held = found.select(F.col("items").alias("part"), "verdict", F.col("confidence").alias("of_part"))
    idle = parts.join(held, ["part", "verdict"]).filter("of_part >= confidence").select("items", "verdict").distinct()
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    kept = common.keep(found.join(idle, ["items", "verdict"], "left_anti"), "url-rules-kept")
    rarest = kept.select("items", F.explode("items").alias("token")).join(single, "token").groupBy("items").agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    return kept.join(rarest, "items").select("items", "key", "verdict", "confidence", "support")


def by_mined(rows: DataFrame, mined: DataFrame) -> DataFrame:
    """(row, mined, mined_verdict) of rows (row, tokens) that hold all tokens of a mined rule."""
    met = rows.select("row", "tokens", F.explode("tokens").alias("key")).join(mined, "key").filter(F.size(F.array_except("items", "tokens")) == 0)
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (F.col("verdict") != "block").alias("v"), F.array_join("items", " ").alias("rule"), "verdict")
    return met.groupBy("row").agg(F.min(order).alias("best")).select("row", F.col("best.rule").alias("mined"), F.col("best.verdict").alias("mined_verdict"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: its id, host, path, rule, verdict, mined.

    ``labels`` (url, verdict) are what is mined; without it, the pages that a rule fits are their own labels.
    """
    url = F.col("url")
    plain = lambda df: df.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn("tokens", tokens_of(url, F.col("host"), F.col("path"))).drop("url")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = common.keep(plain(rows), "url-rows")
    hits = common.keep(by_rules(rows, rules), "url-hits")
    labelled = rows.join(hits, "row").select("tokens", "verdict") if labels is None else plain(labels.select(F.col("url").cast("string").alias("url"), "verdict")).select("tokens", "verdict")
    mined = common.keep(by_mined(rows.join(hits, "row", "left_anti"), mine(labelled)), "url-mined")
    found = rows.join(hits, "row", "left").join(mined, "row", "left")
    return found.select("id", "host", "path", "rule", F.coalesce("verdict", "mined_verdict", F.lit("allow")).alias("verdict"), "mined")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(common.table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


OP13_SQL = rf"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
parsed AS MATERIALIZED (
  SELECT row_number() OVER () AS r, page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{_UPPER}', '{_UPPER.lower()}') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
hit AS MATERIALIZED (
  SELECT p.r, arg_max(x.host || x.path, (length(x.host) + length(x.path), length(x.host), x.host || x.path)) AS rule, arg_max(x.verdict, (length(x.host) + length(x.path), length(x.host), x.host || x.path)) AS verdict
  FROM parsed p JOIN rules x ON (p.host = x.host OR p.host LIKE '%.' || x.host) AND starts_with(p.path, x.path) GROUP BY p.r),
token AS MATERIALIZED (
  SELECT DISTINCT r, unnest(list_concat(
    list_transform(list_filter(list_reverse(string_split(host, '.')), lambda x: x <> ''), lambda x, i: 'd' || i || '=' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x, i: 'p' || i || '=' || CASE WHEN regexp_matches(x, '^[0-9]') THEN '#' || x[1] ELSE x END),
    CASE WHEN regexp_matches(path, '\.[A-Za-z0-9]{{1,8}}$') THEN ['x=' || regexp_extract(path, '\.([A-Za-z0-9]{{1,8}})$', 1)] ELSE [] END,
    list_transform(regexp_extract_all(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1, 's'), '(?:^|&)([^=&]+)', 1), lambda k: 'q=' || k))) AS t
  FROM parsed),
labelled AS MATERIALIZED (SELECT t.r, t.t, h.verdict FROM token t JOIN hit h ON h.r = t.r),
combined AS MATERIALIZED (
  SELECT r, verdict, [t] AS items FROM labelled UNION ALL
  SELECT a.r, a.verdict, [a.t, b.t] FROM labelled a JOIN labelled b ON a.r = b.r AND a.t < b.t UNION ALL
  SELECT a.r, a.verdict, [a.t, b.t, c.t] FROM labelled a JOIN labelled b ON a.r = b.r AND a.t < b.t JOIN labelled c ON c.r = a.r AND b.t < c.t),
whole AS (SELECT items, count(*) AS n FROM combined GROUP BY items),
strong AS MATERIALIZED (
  SELECT c.items, c.verdict, c.n / w.n AS confidence, c.n AS support
  FROM (SELECT items, verdict, count(*) AS n FROM combined GROUP BY ALL) c JOIN whole w ON w.items = c.items
  WHERE c.n >= ceil({SUPPORT} * (SELECT count(*) FROM hit)) AND c.n / w.n >= {CONFIDENCE}),
kept AS MATERIALIZED (
  SELECT * FROM strong s WHERE NOT EXISTS (
    SELECT 1 FROM strong p WHERE p.verdict = s.verdict AND len(p.items) < len(s.items) AND list_has_all(s.items, p.items) AND p.confidence >= s.confidence)),
own AS (SELECT r, list(t) AS tokens FROM token WHERE r NOT IN (SELECT r FROM hit) GROUP BY r),
best AS (
  SELECT o.r, arg_min(k.verdict, (-k.confidence, -k.support, k.verdict <> 'block', array_to_string(k.items, ' '))) AS verdict,
    arg_min(array_to_string(k.items, ' '), (-k.confidence, -k.support, k.verdict <> 'block', array_to_string(k.items, ' '))) AS mined
  FROM own o JOIN kept k ON list_has_all(o.tokens, k.items) GROUP BY o.r)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, b.verdict, 'allow') AS verdict, b.mined
FROM parsed p LEFT JOIN hit h ON h.r = p.r LEFT JOIN best b ON b.r = p.r
"""
