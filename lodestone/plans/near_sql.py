"""SQL of the near-duplicate and language queries, from the same fixed values as the functions."""

from __future__ import annotations

from lodestone.functions import language
from lodestone.functions import minhash as mh

TOP = f"{1 << 64}::UHUGEINT"
ROWS = mh.PERMUTATIONS // mh.BANDS


def _fnv(octets: str) -> str:
    return f"list_reduce({octets}, lambda h, b: ((xor(h, b)::UHUGEINT * {mh.FNV_PRIME}::UHUGEINT) % {TOP})::UBIGINT, {mh.FNV_OFFSET}::UBIGINT)"


def _signed(value: str) -> str:
    return f"(CASE WHEN {value} >= {1 << 63} THEN {value}::HUGEINT - {1 << 64} ELSE {value}::HUGEINT END)::BIGINT"


#: (id, connector_id, s): distinct shingles; (id, p, v): signatures; (id, band, hash): bands.
SIGNED = rf"""
, bare AS MATERIALIZED (
  SELECT id, connector_id, list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: w <> '') AS w FROM document),
shingle AS MATERIALIZED (
  SELECT DISTINCT id, connector_id, lower(array_to_string(w[i:i + {mh.SHINGLE - 1}], ' ')) AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {mh.SHINGLE - 1}, 1) + 1)) AS i FROM bare WHERE len(w) > 0)),
hashed AS MATERIALIZED (
  SELECT id, connector_id, {_fnv("list_transform(range(0, strlen(s)), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT)")}::UHUGEINT AS h
  FROM (SELECT *, hex(encode(s)) AS x FROM shingle)),
states AS MATERIALIZED (
  WITH RECURSIVE step(i, state) AS (
    SELECT 0, {mh.LCG_SEED}::UHUGEINT UNION ALL
    SELECT i + 1, (state * {mh.LCG_MULTIPLIER}::UHUGEINT + {mh.LCG_INCREMENT}::UHUGEINT) % {TOP} FROM step WHERE i < {2 * mh.PERMUTATIONS})
  SELECT * FROM step),
family AS (
  SELECT (a.i - 1) // 2 AS p, CASE WHEN a.state % 2::UHUGEINT = 1 THEN a.state ELSE (a.state + 1::UHUGEINT) % {TOP} END AS a, b.state AS b
  FROM states a JOIN states b ON b.i = a.i + 1 WHERE a.i % 2 = 1),
placed AS MATERIALIZED (SELECT id, connector_id, p, min((h * a + b) % {TOP})::UBIGINT AS v FROM hashed, family GROUP BY ALL),
signed AS MATERIALIZED (SELECT id, connector_id, list(v ORDER BY p) AS sig FROM placed GROUP BY ALL),
banded AS MATERIALIZED (
  SELECT id, p // {ROWS} AS band, {_fnv("flatten(list(list_transform(range(0, 8), lambda j: (v >> (8 * j)) & 255) ORDER BY p))")} AS hash
  FROM placed GROUP BY id, p // {ROWS})
"""
SIGNATURE = SIGNED + f"SELECT id, array_to_string(list_transform(sig, lambda v: {_signed('v')}), ',') AS sig FROM signed"
BANDED = SIGNED + f"SELECT id, band::INT AS band, {_signed('hash')} AS hash FROM banded"

#: (a, b, similarity, same_connector) as ``near_pairs`` tells them.
PAIRS = SIGNED + f"""
, one AS MATERIALIZED (SELECT sig, min(id) AS id, arg_min(connector_id, id) AS connector_id FROM signed GROUP BY sig),
met AS (
  SELECT DISTINCT x.id AS a, y.id AS b FROM (SELECT * FROM banded WHERE id IN (SELECT id FROM one)) x
  JOIN (SELECT * FROM banded WHERE id IN (SELECT id FROM one)) y ON x.band = y.band AND x.hash = y.hash AND x.id < y.id),
scored AS (
  SELECT a, b, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / {mh.PERMUTATIONS} AS similarity, x.connector_id = y.connector_id AS same_connector
  FROM met JOIN one x ON x.id = a JOIN one y ON y.id = b),
pairs AS MATERIALIZED (
  SELECT a, b, similarity, same_connector FROM scored WHERE similarity >= 0.8 UNION ALL
  SELECT o.id, s.id, 1.0::DOUBLE, o.connector_id = s.connector_id FROM one o JOIN signed s ON s.sig = o.sig AND s.id <> o.id)
"""
NEAR_PAIRS = PAIRS + "SELECT a, b, similarity, same_connector FROM pairs"
VERIFIED = PAIRS + """
, sets AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
both_have AS (SELECT a, b, count(*) AS n FROM pairs JOIN shingle x ON x.id = a JOIN shingle y ON y.id = b AND y.s = x.s GROUP BY ALL)
SELECT a, b, round(coalesce(c.n, 0) / (x.n + y.n - coalesce(c.n, 0)), 6) AS verified
FROM pairs LEFT JOIN both_have c USING (a, b) JOIN sets x ON x.id = a JOIN sets y ON y.id = b"""
STRONGEST = PAIRS + """
SELECT a AS document_id, max(similarity) AS max_jaccard, arg_min(b, (-similarity, b)) AS max_jaccard_doc
FROM (SELECT a, b, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs) GROUP BY a"""
REASONS = PAIRS + """
, decided AS (
  SELECT CASE WHEN (strlen(a), a) <= (strlen(b), b) THEN b ELSE a END AS document_id, CASE WHEN (strlen(a), a) <= (strlen(b), b) THEN a ELSE b END AS kept, similarity FROM pairs)
SELECT document_id, arg_min(kept, (-similarity, kept)) AS kept, max(similarity) AS similarity, max(similarity) < 0.9 AS report_only FROM decided GROUP BY document_id"""


def _count(words: tuple[str, ...]) -> str:
    return "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in words) + ")))"


LANGUAGE = rf"""
, halves AS (SELECT id, lang, text, greatest(1, length(text) // 2) AS half FROM document),
joined AS (SELECT id, lang, trim(substr(text, 1, half) || chr(10) || substr(text, half + 1), ' ') AS t FROM halves),
worded AS (SELECT id, lang, list_transform(regexp_split_to_array(t, '\s+'), lambda x: lower(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))) AS w FROM joined WHERE strlen(t) >= {language.FLOOR_BYTES}),
counted AS (SELECT id, lang, [{", ".join(_count(words) for words in language.FUNCTION_WORDS.values())}] AS c FROM worded)
SELECT id, lang, lang_code FROM (
  SELECT id, lang, [{", ".join(f"'{code}'" for code in language.FUNCTION_WORDS)}][list_position(c, list_max(c))] AS lang_code
  FROM counted WHERE list_max(c) > 0 AND list_max(c) * list_max(c) / list_sum(list_transform(c, lambda n: n * n)) >= {language.SURE})
WHERE lang_code <> 'eng'"""
