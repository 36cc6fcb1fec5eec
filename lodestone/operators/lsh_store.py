"""Signatures, bands and links that are kept up as documents change.

Four versioned tables: ``lsh_document`` (document_id, key), ``lsh_signature`` (key, sig, bands,
members), ``lsh_band`` (band, hash, key) and ``lsh_link`` (key, other, similarity), each link from both
ends.  Links are between distinct signatures; documents are their members.  A batch of changed
and deleted documents signs only those, and reads and writes only the buckets that they, their
former signatures and their new neighbours lie in.  A signature is born with its first member
and dies with its last; only born ones are joined, with the band buckets they fall into.  All
tables change in one commit, and a batch that is played again changes nothing.

Edge cases: a document without words has no signature and leaves the store; a repeated id in
one batch counts once (the first by text); deleting what is not there does nothing; null ids take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import minhash as mh
from lodestone.sources.scratch import keep
from lodestone.sources.versions import Change, Tables

from . import duplicates
from .clusters import sig_key
from .components import components

SCHEMAS = {
    "lsh_document": ("document_id string, key string", ["document_id"]),
    "lsh_signature": ("key string, sig array<bigint>, bands array<bigint>, members bigint", ["key"]),
    "lsh_band": ("band int, hash bigint, key string", ["band", "hash"]),
    "lsh_link": ("key string, other string, similarity double", ["key"]),
}


def create(tables: Tables) -> None:
    """Empty tables, in one commit."""
    tables.commit({name: Change(tables.spark.createDataFrame([], schema), keys) for name, (schema, keys) in SCHEMAS.items()})


def update(tables: Tables, changed: DataFrame, deleted: DataFrame | None = None, batch: tuple[str, int] | None = None, least: float = duplicates.STORE_SIMILARITY) -> bool:
    """Bring the store up to ``changed`` (id, text) and without ``deleted`` (id)."""
    state = tables.state()
    if batch and state.batches.get(batch[0], -1) >= batch[1]:
        return False
    changed = changed.filter("id is not null").groupBy("id").agg(F.min("text").alias("text"))
    signed = duplicates.signatures(changed.withColumn("connector_id", F.lit(0))).select(F.col("id").alias("document_id"), sig_key(F.col("sig")).alias("key"), "sig", "bands")
    signed = keep(signed, "lsh-signed")
    ids = changed.select(F.col("id").alias("document_id"))
    ids = keep((ids if deleted is None else ids.union(deleted.filter("id is not null").select("id"))).distinct(), "lsh-ids")

    read = lambda name, hit: tables.read(name, hit, state)
    docs_hit = tables.touched(ids, "document_id")
    held = read("lsh_document", docs_hit)
    left = held.join(ids, "document_id", "left_semi")
    documents = held.join(ids, "document_id", "left_anti").unionByName(signed.select("document_id", "key"))

    # Members that each signature wins and loses; those that are born and die.
    moves = signed.select("key", F.lit(1).alias("n")).union(left.select("key", F.lit(-1).alias("n"))).groupBy("key").agg(F.sum("n").alias("n")).filter("n <> 0")
    moves = keep(moves, "lsh-moves")
    sigs_hit = tables.touched(moves, "key")
    stored = read("lsh_signature", sigs_hit)
    fresh = signed.dropDuplicates(["key"]).select("key", F.col("sig").alias("_sig"), F.col("bands").alias("_bands"))
    now = stored.withColumn("was", F.col("members")).join(moves, "key", "full_outer").join(fresh, "key", "left")
    now = now.select("key", F.coalesce("sig", "_sig").alias("sig"), F.coalesce("bands", "_bands").alias("bands"),
                     (F.coalesce("members", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("members"), F.coalesce("was", F.lit(0)).alias("was"))
    now = keep(now, "lsh-now")
    born, dead = now.filter("was = 0 and members > 0"), now.filter("was > 0 and members = 0")
    of_bands = lambda df: df.select("key", F.posexplode("bands").alias("band", "hash")).select("band", "hash", "key")
    new_bands, old_bands = keep(of_bands(born), "lsh-born"), keep(of_bands(dead), "lsh-dead")

    bands_hit = tables.touched(new_bands.union(old_bands), "band", "hash")
    bands = keep(read("lsh_band", bands_hit).join(dead.select("key"), "key", "left_anti").select("band", "hash", "key").union(new_bands), "lsh-bands")
    met = new_bands.join(bands.withColumnRenamed("key", "other"), ["band", "hash"]).filter("key <> other").select("key", "other").distinct()
    met = keep(met, "lsh-met")
    others = tables.touched(met, "other")
    sigs = read("lsh_signature", others - sigs_hit).select("key", "sig").union(now.filter("members > 0").select("key", "sig"))
    sigs = keep(sigs.join(met.select("other").union(met.select("key")).distinct().withColumnRenamed("other", "key"), "key", "left_semi"), "lsh-sides")
    scored = met.join(sigs.withColumnRenamed("sig", "sig_a"), "key").join(sigs.withColumnsRenamed({"key": "other", "sig": "sig_b"}), "other")
    scored = scored.select("key", "other", mh.estimated_jaccard(F.col("sig_a"), F.col("sig_b")).alias("similarity")).filter(F.col("similarity") >= least)
    added = keep(scored.union(scored.select("other", "key", "similarity")).distinct(), "lsh-added")

    # The links of the dead are found from their own end; the other end lies in the buckets of their neighbours.
    gone = dead.select("key")
    ends = read("lsh_link", tables.touched(gone, "key")).join(gone, "key", "left_semi").select(F.col("other").alias("key"))
    links_hit = tables.touched(gone.union(ends).union(added.select("key")), "key")
    links = read("lsh_link", links_hit).join(gone, "key", "left_anti").join(gone.withColumnRenamed("key", "other"), "other", "left_anti").select("key", "other", "similarity").union(added)

    return tables.commit({
        "lsh_document": Change(documents, SCHEMAS["lsh_document"][1], docs_hit),
        "lsh_signature": Change(now.filter("members > 0").drop("was"), SCHEMAS["lsh_signature"][1], sigs_hit),
        "lsh_band": Change(bands, SCHEMAS["lsh_band"][1], bands_hit),
        "lsh_link": Change(links, SCHEMAS["lsh_link"][1], links_hit),
    }, batch, state=state)


def _first(tables: Tables) -> DataFrame:
    return keep(tables.read("lsh_document").groupBy("key").agg(F.min("document_id").alias("first")), "lsh-firsts")


def pairs(tables: Tables) -> DataFrame:
    """(a, b, similarity), a < b: links between the first documents of two signatures."""
    first = _first(tables)
    found = tables.read("lsh_link").join(first.withColumnRenamed("first", "a"), "key").join(first.withColumnsRenamed({"key": "other", "first": "b"}), "other")
    return found.filter("a < b").select("a", "b", "similarity")


def clusters(tables: Tables) -> DataFrame:
    """(document_id, cluster_id): the first document of all that are connected."""
    first = _first(tables)
    roots = components(pairs(tables))
    own = tables.read("lsh_document").join(first, "key").join(roots, F.col("first") == F.col("node"), "left")
    return own.select("document_id", F.coalesce("root", "first").alias("cluster_id"))


def unsigned(tables: Tables, documents: DataFrame) -> DataFrame:
    """(id): documents that the store does not know."""
    return documents.select("id").join(tables.read("lsh_document").select(F.col("document_id").alias("id")), "id", "left_anti")
