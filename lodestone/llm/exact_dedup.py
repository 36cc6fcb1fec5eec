"""Exact dedup by deterministic block naming (DataFrame functions only).

A normalised text is cut into blocks of ``block_chars`` code points.  Distinct
blocks are sorted and numbered, so equal blocks, and only those, share an integer
name.  Adjacent names are paired and the distinct pairs numbered in turn, halving
a document's sequence each round until one integer is left.  Texts are equal
exactly if they finish in the same round with the same name.

Block contents cross the network once, in the distinct step, after a map-side
combine.  Documents carry a 64-bit key per block instead; the distinct step
certifies that no two contents share a key, and if two ever do, the keys are
drawn again with another salt.  So names depend on contents, never on luck.

Edge cases: null text counts as empty; the empty text has one empty block.  Rows
that repeat a doc_id are separate members of their group, and one of them stays.
Null ids sort last when the keeper is chosen.  A very long text has as many blocks as it
needs, and is compared whole.  Extra columns are ignored, whatever their names.  An empty
table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK_CHARS = 8192


def _blocks(norm, block_chars: int):
    found = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(F.length(norm) == 0, F.array(F.lit(""))).otherwise(found)


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Sort each partition of distinct rows and number them; fixed by writing."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _block_names(docs: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """(key, name) for every distinct block, and the salt whose keys are unique."""
    salt = 0
    while True:
        parts = docs.select(F.explode(_blocks(F.col("norm"), block_chars)).alias("block"))
        distinct = parts.select(F.xxhash64(F.lit(salt), "block").alias("key"), "block").distinct()
        names = common.keep(_numbered(distinct, "block").select("key", "name"), "block-names")
        if names.groupBy("key").count().filter("count > 1").isEmpty():
            return names, salt
        salt += 1


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, row_col: str | None = None) -> DataFrame:
    """One row per row of ``df``: row, doc_id, text_sha256, level, name.

    (level, name) is the identity: equal for equal normalised texts only.
    """
    norm = F.regexp_replace("text", common.SPACE_RUN, " ")
    docs = common.text_rows(df, id_col, text_col, row_col=row_col).select("row", "doc_id", norm.alias("norm"))
    names, salt = _block_names(docs, block_chars)
    keyed = docs.select(
        "row", "doc_id", F.sha2(F.col("norm"), 256).alias("text_sha256"),
        F.transform(_blocks(F.col("norm"), block_chars), lambda b: F.xxhash64(F.lit(salt), b)).alias("keys"),
    )
    keyed = common.keep(keyed, "block-keys")

    seq = keyed.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    seq = common.keep(seq.join(names, "key").select("row", "n", "pos", "name"), "level-0")
    level, done = 0, []
    while True:
        done.append(seq.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        rest = seq.filter("n > 1")
        if rest.isEmpty():
            break
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = rest.groupBy("row", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right"))
        pairs = common.keep(pairs, "pairs")
        names = common.keep(_numbered(pairs.select("left", "right").distinct(), "left", "right"), "pair-names")
        level += 1
        seq = pairs.join(names, ["left", "right"]).select(
            "row", F.expr("cast((n + 1) div 2 as int)").alias("n"), "pos", "name")
        seq = common.keep(seq, f"level-{level}")
    identity = reduce(DataFrame.union, done)
    return keyed.select("row", "doc_id", "text_sha256").join(identity, "row")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, row_col: str | None = None) -> DataFrame:
    """Membership of every row: row, doc_id, keep_id, group_size, kept, text_sha256."""
    named = common.keep(identify(df, id_col, text_col, block_chars, row_col), "identity")
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    groups = named.groupBy("level", "name").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    groups = common.keep(groups, "groups")  # a plain table again, so that Spark can split the join at a large group
    return named.join(groups, ["level", "name"]).select(
        "row", "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its group that stays."""
    found = dedup(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
