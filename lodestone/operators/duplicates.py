"""Duplicate groups (exact, URL, near) and the copy of each that stays."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import minhash as mh
from lodestone.sources.scratch import keep

KEEPERS = ("shortest_url", "longest_content", "most_chunks", "newest")
STORE_SIMILARITY, REPORT_SIMILARITY = 0.80, 0.90
#: Documents of a band bucket's part; a larger bucket is cut into parts, and every two of them are compared.
PAIR_BUCKET = 200


def groups(documents: DataFrame, key: str, method: str, policy: str = "shortest_url") -> DataFrame:
    """Members of groups of two or more with equal ``key``: keeper, size, whether they span connectors.

    The keeper and the counts are grouped aggregates that combine before the shuffle,
    so a key that many documents share is no single task's load.  Rows that repeat an id
    are all members; one row of the keeper's id stays.
    """
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_ascending(policy))], F.col("id"))
    rows = documents.filter(F.col(key).isNotNull()).groupBy(key, "id").agg(
        F.min(order).alias("o"), F.count("*").alias("n"), F.count_if(F.col("connector_id").isNull()).alias("unknown"),
        F.min("connector_id").alias("low"), F.max("connector_id").alias("high"))
    per = rows.groupBy(key).agg(
        F.min("o").alias("first"), F.sum("n").alias("group_size"), F.sum("unknown").alias("unknown"), F.min("low").alias("low"), F.max("high").alias("high")).filter("group_size > 1")
    cross = (F.col("unknown") > 0) | (F.col("low") != F.col("high"))
    per = per.select(key, F.col("first.id").alias("keeper_id"), "group_size", cross.alias("cross_connector"))
    members = rows.select("id", key, "n").join(per, key).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return members.select(
        F.col("id").alias("document_id"), F.lit(method).alias("method"), F.col(key).alias("group_key"), "keeper_id",
        ((F.col("id") == F.col("keeper_id")) & (F.col("at") == 1)).alias("is_keeper"), "group_size", "cross_connector")


def _ascending(policy: str) -> list[Column]:
    """The policy's order as values of which the least comes first."""
    if policy == "shortest_url":
        return [F.octet_length(F.coalesce("link", "id"))]
    if policy in ("longest_content", "most_chunks"):
        return [-F.coalesce("chunk_count", F.lit(-1))]
    if policy == "newest":
        return [F.col("sort_ts").isNull(), -F.unix_micros(F.col("sort_ts"))]
    raise ValueError(f"unknown keeper policy {policy}")


def signatures(documents: DataFrame, text_col: str = "text", k: int = mh.SHINGLE) -> DataFrame:
    """(id, connector_id, sig, bands) of the documents that have words."""
    df = documents.select("id", F.col("connector_id").cast("int").alias("connector_id"), mh.plain_words(F.col(text_col)).alias("words")).filter("words <> ''")
    return df.mapInArrow(partial(mh.sign, k=k), "id string, connector_id int, sig array<long>, bands array<long>")


def near_pairs(signed: DataFrame, least: float = STORE_SIMILARITY, bucket: int = PAIR_BUCKET) -> DataFrame:
    """(a, b, similarity, same_connector), a < b: pairs that share a band and reach ``least``.

    Equal signatures are collapsed to their first document before banding, so copies
    make no pairs among themselves; each copy is paired with that first document
    (similarity 1).  A bucket that still holds more than ``bucket`` distinct
    signatures is cut into parts by hash, and each pair of parts is a cell of about
    ``bucket`` members a side, so all pairs are compared and no task holds a bucket.
    """
    keyed = keep(signed.withColumn("sig_key", F.xxhash64("sig")), "signatures")
    firsts = keep(keyed.groupBy("sig_key", "sig").agg(F.min_by(F.struct("id", "connector_id"), "id").alias("one"), F.first("bands").alias("bands")), "first-signatures")
    copies = keyed.select("sig_key", "sig", "id", "connector_id").join(firsts.select("sig_key", "sig", "one"), ["sig_key", "sig"]).filter(F.col("id") != F.col("one.id"))
    same = copies.select(F.col("one.id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), (F.col("one.connector_id") == F.col("connector_id")).alias("same_connector"))

    banded = firsts.select(F.col("one.id").alias("id"), F.posexplode("bands").alias("band", "hash"))
    sizes = banded.groupBy("band", "hash").count().filter("count > 1").select("band", "hash", F.ceil(F.col("count") / bucket).cast("int").alias("parts"))
    dealt = banded.join(sizes, ["band", "hash"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("low"), F.greatest(o, F.col("part")).alias("high")))
    dealt = dealt.select("band", "hash", "part", "id", F.explode(cells).alias("cell")).select("band", "hash", "cell.low", "cell.high", "part", "id")
    left, right = dealt.filter("part = low").alias("l"), dealt.filter("part = high").alias("r")
    within = (F.col("low") < F.col("high")) | (F.col("l.id") < F.col("r.id"))
    met = left.join(right, ["band", "hash", "low", "high"]).filter(within).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    sides = firsts.select(F.col("one.id").alias("id"), F.col("one.connector_id").alias("connector_id"), "sig")
    side = lambda n: sides.select(F.col("id").alias(n), F.col("sig").alias(f"sig_{n}"), F.col("connector_id").alias(f"connector_{n}"))
    scored = met.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", mh.estimated_jaccard(F.col("sig_a"), F.col("sig_b")))
    scored = scored.filter(F.col("similarity") >= least)
    return same.union(scored.select("a", "b", "similarity", (F.col("connector_a") == F.col("connector_b")).alias("same_connector")))


def verify_pairs(pairs: DataFrame, documents: DataFrame, text_col: str = "text", k: int = mh.SHINGLE) -> DataFrame:
    """Add ``verified``: the exact Jaccard similarity of the two shingle sets.

    Only texts of pairs are read as words.  Equal ones are told by their SHA-256; each two
    unlike ones are compared once, however many documents hold them.
    """
    pairs = keep(pairs, "verify-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    words = documents.join(ids, "id", "left_semi").select("id", mh.plain_words(F.col(text_col)).alias("words"))
    words = keep(words.withColumn("sha", F.sha2("words", 256)), "verify-words")
    side = lambda n: words.select(F.col("id").alias(n), F.col("sha").alias(f"sha_{n}"), (F.col("words") != "").alias(f"some_{n}"))
    found = keep(pairs.join(side("a"), "a").join(side("b"), "b"), "verify-sides")
    texts = keep(words.groupBy("sha").agg(F.first("words").alias("words")), "verify-texts")
    text = lambda n: texts.select(F.col("sha").alias(f"sha_{n}"), F.col("words").alias(f"words_{n}"))
    unlike = found.filter("sha_a <> sha_b").select("sha_a", "sha_b").distinct().join(text("a"), "sha_a").join(text("b"), "sha_b")
    shares = keep(unlike.mapInArrow(partial(mh.compare, k=k), "sha_a string, sha_b string, share double"), "verify-shares")
    alike = F.when(F.col("sha_a") == F.col("sha_b"), F.col("some_a").cast("double")).otherwise(F.col("share"))
    return found.join(shares, ["sha_a", "sha_b"], "left").withColumn("verified", alike).select(*pairs.columns, "verified")


def max_similarity(pairs: DataFrame) -> DataFrame:
    """(document_id, max_jaccard, max_jaccard_doc): the strongest neighbour, of equals the least id."""
    ends = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = pairs.select(F.explode(ends).alias("e"), "similarity").select("e.a", "e.b", "similarity")  # one pass, so that pairs are made once
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("b").alias("o"))).alias("best")
    return both.groupBy(F.col("a").alias("document_id")).agg(best).select("document_id", (-F.col("best.s")).alias("max_jaccard"), F.col("best.o").alias("max_jaccard_doc"))


def near_reasons(pairs: DataFrame, documents: DataFrame, policy: str = "shortest_url", report: float = REPORT_SIMILARITY) -> DataFrame:
    """(document_id, kept, similarity, report_only): the copy of each pair that goes, its strongest pair."""
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_ascending(policy))], F.col("id")).alias("o")
    keys = documents.select("id", order)
    side = lambda n: keys.select(F.col("id").alias(n), F.col("o").alias(f"o_{n}"))
    decided = pairs.join(side("a"), "a").join(side("b"), "b")
    a_stays = F.col("o_a") <= F.col("o_b")
    decided = decided.select(F.when(a_stays, F.col("b")).otherwise(F.col("a")).alias("document_id"), F.when(a_stays, F.col("a")).otherwise(F.col("b")).alias("kept"), "similarity")
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "kept")).alias("best")
    return decided.groupBy("document_id").agg(best).select("document_id", F.col("best.kept").alias("kept"), (-F.col("best.s")).alias("similarity"), (-F.col("best.s") < report).alias("report_only"))


def pairs_for(pairs: DataFrame, document_id: str) -> DataFrame:
    """Pairs of one document, strongest first."""
    return pairs.filter((F.col("a") == document_id) | (F.col("b") == document_id)).orderBy(F.coalesce("verified", "similarity").desc_nulls_last(), "a", "b")
