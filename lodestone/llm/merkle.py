"""Merkle manifest of a dataset with checkpoint-and-recompute proofs.

Each row is a leaf; the leaves of a group (a language) ascend by id and are hashed
pairwise, level by level, to the group's subroot; the subroots, in the order of
their groups, are the leaves of one more tree, whose top is the root.

Only every ``STRIDE``-th level is written, as aligned subtrees: a row holds the up to
2 ** STRIDE nodes of one level that stand under one node of the next level written.
A proof is extracted from the top down.  Each subtree regenerates its missing interior
nodes from the nodes it has stored, hands every node its siblings and the path of the
subtree's top, and discards them.  Level by level the rows shrink by 2 ** STRIDE, so
only one join has as many subtrees as there are leaves / 2 ** STRIDE, and a leaf's
path is made where the leaf is, without a join of all leaves for each level.

Places come from a range partitioning by group and id, cut inside equal rows too, that
is written once; counts by partition and group give the offsets.  So neither a group of
a third of all rows nor a third of rows under one id meets in one task.

Edge cases: nulls in any field hash as ``-``; a null group is a group of its own, ahead
of all others; null ids stand first; rows that repeat an id stand in the order of their
leaves; equal rows are leaves of their own and take neighbouring places; a very long text
is hashed whole; extra columns are ignored, whatever their names.  An empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Levels between two that are written; a subtree has 2 ** STRIDE stored nodes at most.
STRIDE = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The query alters rows whose id has a CRC-32 that this divides.
ALTERED = 7


def digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each by its length and value, null as ``-``."""
    def plain(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*map(plain, fields)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    side = lambda a, s: F.when(s["left"], F.concat(s["digest"], a)).otherwise(F.concat(a, s["digest"]))
    return F.aggregate(path, leaf, lambda a, s: F.sha2(side(a, s), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), ""), 256)


def _placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the place in the row's tree, and ``n``, the leaves of that tree."""
    dealt = leaves.repartitionByRange("tree", *[F.col(c).asc_nulls_first() for c in order])
    dealt = dealt.sortWithinPartitions("tree", *[F.col(c).asc_nulls_first() for c in order])
    rows = common.keep(dealt.withColumn("at", F.monotonically_increasing_id()), "merkle-leaves").withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    of_tree = Window.partitionBy("tree")
    ahead = F.coalesce(F.sum("size").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = common.keep(runs.select("tree", "part", (ahead - F.col("first")).alias("shift"), F.sum("size").over(of_tree).alias("n")), "merkle-runs")
    return rows.join(runs, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _up(nodes: Column) -> Column:
    """The level above: every two nodes hashed, a last one alone."""
    last = F.floor((F.size(nodes) - 1) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(nodes, 2 * i + 1, 2), ""), 256))


def _subtrees(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, members) of nodes (tree, pos, n, digest, ...); ``pos`` is that of the subtree's top, members are in order."""
    own = [c for c in nodes.columns if c not in ("tree", "n")]
    members = F.array_sort(F.collect_list(F.struct("pos", *[c for c in own if c != "pos"]))).alias("members")
    return nodes.groupBy("tree", F.shiftright("pos", STRIDE).alias("top"), "n").agg(members).withColumnRenamed("top", "pos")


def _interior(subtrees: DataFrame) -> DataFrame:
    """Add the levels of each subtree, ``l0`` to ``l<STRIDE>``, and how many of its steps are real."""
    steps = sum(((F.col("n") > 2**j).cast("int") for j in range(1, STRIDE)), (F.col("n") > 1).cast("int"))
    found = subtrees.withColumn("steps", steps).withColumn("l0", F.transform("members", lambda m: m["digest"]))
    for j in range(STRIDE):
        found = found.withColumn(f"l{j + 1}", _up(F.col(f"l{j}")))
    return found


def _grow(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(written levels, finished tops): tops (tree, digest) of trees that end under each level."""
    written, ended = [], []
    while True:
        written.append(common.keep(_subtrees(nodes), f"merkle-level-{STRIDE * len(written)}"))
        most = written[-1].agg(F.max("n")).first()[0] or 0
        top = F.element_at(F.element_at(F.array(*[F.col(f"l{j}") for j in range(STRIDE + 1)]), F.col("steps") + 1), 1)
        tops = _interior(written[-1]).select("tree", "pos", F.shiftright(F.col("n") + (1 << STRIDE) - 1, STRIDE).alias("n"), top.alias("digest"))
        ended.append(tops.filter("n = 1").select("tree", "digest"))
        nodes = tops.filter("n > 1")
        if most <= 1 << STRIDE:
            return written, ended


def _siblings(at: Column) -> Column:
    """What a subtree adds to the path of its node at ``at``."""
    def step(j: int) -> Column:
        own = F.shiftright(at, j)
        return F.struct((own % 2 == 1).alias("left"), F.coalesce(F.get(F.col(f"l{j}"), own.bitwiseXOR(F.lit(1))), F.lit("")).alias("digest"))
    return F.slice(F.array(*[step(j) for j in range(STRIDE)]), F.lit(1), F.col("steps"))


def _extract(written: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of all leaves: their columns, ``path``, and what ``tops`` (tree, path, ...) say of their tree."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for level in reversed(written):
        ends = level.filter(F.col("n") <= 1 << STRIDE).join(tops, "tree")  # this subtree's top is the tree's
        goes_on = level.filter(F.col("n") > 1 << STRIDE)
        met = ends if above is None else ends.unionByName(goes_on.join(above, ["tree", "pos"]))
        met = _interior(met).select("*", F.posexplode("members").alias("own", "m"))
        found = met.select("tree", "m.*", F.concat(_siblings(F.col("own")), "path").alias("path"), *more)
        above = found.drop("digest")
    return found


def manifest(df: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "lang", more: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``df``: group, id, leaf, subroot, root, path, and ``more``.

    ``path`` lists (left, digest) from the leaf to the root: the sibling at each level, empty where there is none.
    """
    more = more or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = df.select(tree.alias("tree"), F.col(id_col).alias("_id"), leaf.alias("digest"), F.monotonically_increasing_id().alias("tie"), *[c.alias(f"_{k}") for k, c in more.items()])
    leaves = common.keep(leaves, "merkle-digests")
    written, ended = _grow(_placed(leaves, ("_id", "digest", "tie")).drop("tie"))
    subroots = ended[0]
    for e in ended[1:]:
        subroots = subroots.union(e)
    subroots = common.keep(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), "merkle-subroots")
    top_written, top_ended = _grow(_placed(subroots, ("group",)))
    roots = top_ended[-1].select("tree", F.col("digest").alias("root"), F.array().cast("array<struct<left:boolean,digest:string>>").alias("path"))
    tops = _extract(top_written, roots)
    tops = common.keep(tops.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", "path"), "merkle-tops")
    found = _extract(written, tops)
    return found.select(F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("group"), F.col("_id").alias("id"), F.col("digest").alias("leaf"), "subroot", "root", "path",
                        *[F.col(f"_{k}").alias(k) for k in more])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, and what it shows of documents that were altered."""
    docs = common.table(spark, sf_dir, "documents").select(*FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    altered = digest(*(fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}).values())
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % ALTERED == 0, altered)
    found = manifest(docs, digest(*fields.values()), more={"changed": changed})
    folded = found.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _plain_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _digest_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_plain_sql(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


#: CRC-32 of the decimal id, bit by bit (0xEDB88320, reflected).
_CRC_SQL = """xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT),
  lambda c, b: list_reduce(range(0, 8)::UBIGINT[], lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)), xor(c, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"""

OP12_SQL = f"""
WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT doc_id, lang, {_digest_sql("n_chars")} AS leaf, {_digest_sql("n_chars::HUGEINT + 1")} AS altered, {_CRC_SQL} % {ALTERED} = 0 AS hit,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {_digest_sql("n_chars")}) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM documents),
tree(lang, level, pos, digest, n) AS (
  SELECT lang, 0, pos, leaf, n FROM leaf UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n),
sub AS MATERIALIZED (
  SELECT lang, digest, level AS height, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top(level, pos, digest, n) AS (
  SELECT 0, pos, digest, n FROM sub UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
root AS (SELECT digest AS root, level AS height FROM top WHERE n = 1),
above AS MATERIALIZED (
  SELECT s.lang, s.digest AS subroot, r.root, coalesce(list((s.pos >> g) & 1 = 1 ORDER BY g) FILTER (g IS NOT NULL), []) AS lefts,
    coalesce(list(coalesce(t.digest, '') ORDER BY g) FILTER (g IS NOT NULL), []) AS siblings
  FROM sub s CROSS JOIN root r LEFT JOIN LATERAL (SELECT unnest(range(0, r.height)) AS g) ON true LEFT JOIN top t ON t.level = g AND t.pos = xor(s.pos >> g, 1::BIGINT)
  GROUP BY ALL),
path AS MATERIALIZED (
  SELECT d.doc_id, d.lang, d.leaf, d.altered, d.hit, d.pos, coalesce(list((d.pos >> g) & 1 = 1 ORDER BY g) FILTER (g IS NOT NULL), []) AS lefts,
    coalesce(list(coalesce(t.digest, '') ORDER BY g) FILTER (g IS NOT NULL), []) AS siblings
  FROM leaf d JOIN sub s ON s.lang IS NOT DISTINCT FROM d.lang LEFT JOIN LATERAL (SELECT unnest(range(0, s.height)) AS g) ON true
    LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM d.lang AND t.level = g AND t.pos = xor(d.pos >> g, 1::BIGINT)
  GROUP BY ALL),
whole AS (
  SELECT doc_id, leaf, subroot, root, p.siblings || a.siblings AS siblings, p.lefts || a.lefts AS lefts, CASE WHEN hit THEN altered ELSE leaf END AS shown
  FROM path p JOIN above a ON a.lang IS NOT DISTINCT FROM p.lang),
folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], siblings), 'string_agg', '')) AS proof_sha256,
    list_reduce(list_transform(list_zip(lefts, siblings), lambda z: CASE WHEN z[1] THEN 'L' ELSE 'R' END || z[2]),
      lambda a, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END, shown) AS folded_root
  FROM whole)
SELECT *, folded_root = root AS verified FROM folded
"""
