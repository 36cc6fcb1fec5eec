"""Deleting for good and bringing back, each as one commit over all tables that hold a document.

``document``, ``tag``, ``attribution`` and ``chunk`` are versioned tables in buckets of the
document's id, so a commit reads and writes only buckets of the documents concerned.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import keep
from lodestone.sources.versions import Change, State, Tables, union

from . import lifecycle, selection

#: The tables of a document and their key.
HELD = {"document": "id", "tag": "document_id", "attribution": "id", "chunk": "document_id"}


def create(tables: Tables, documents: DataFrame, tags: DataFrame, attribution: DataFrame, chunks: DataFrame) -> None:
    """The tables as they start, in one commit."""
    frames = {"document": documents, "tag": tags, "attribution": attribution, "chunk": chunks}
    tables.commit({name: Change(df, [HELD[name]]) for name, df in frames.items()})


def _own(tables: Tables, state: State, hit: set[int], ids: DataFrame) -> dict[str, DataFrame]:
    """The rows of the documents concerned, by table."""
    return {name: tables.read(name, hit, state).join(ids.withColumnRenamed("document_id", "_id"), F.col(key) == F.col("_id"), "left_semi") for name, key in HELD.items()}


def discard(tables: Tables, ids: DataFrame, now: datetime | str, retention_days: int = 30, batch: tuple[str, int] | None = None) -> bool:
    """Snapshots into ``trash`` and the documents out of their tables, at once.

    A document whose chunks were read short stays where it is; so does one that is not there.
    """
    state = tables.state()
    ids = keep(ids.select("document_id").distinct(), "trash-ids")
    hit = tables.touched(ids, "document_id")
    own = _own(tables, state, hit, ids)
    # Which go is told by counts and written, so that no table's change gathers the chunks again.
    gone = keep(lifecycle.complete_ids(own["document"], own["chunk"]), "trash-gone")
    whole = lifecycle.capture(own["document"], own["tag"], own["attribution"], own["chunk"], now, retention_days).filter("complete")
    whole = whole.withColumn("restored_at", F.lit(None).cast("timestamp"))
    changes = {name: Change(df, [HELD[name]], hit) for name, df in lifecycle.cascade({n: (tables.read(n, hit, state), k) for n, k in HELD.items()}, gone).items()}
    held = [tables.read("trash", hit, state)] if "trash" in state.tables else []
    # A document that was discarded, came back and goes again has one snapshot, its latest.
    kept = [t.join(gone, "document_id", "left_anti") for t in held]
    changes["trash"] = Change(union([*kept, whole]), ["document_id"], hit)
    return tables.commit(changes, batch, state=state)


def bring_back(tables: Tables, ids: DataFrame, connectors: DataFrame, known_tags: DataFrame, now: datetime | str, overwrite: bool = False, batch: tuple[str, int] | None = None) -> DataFrame:
    """Put documents back from their snapshots, in one commit; (document_id, outcome, tags, skipped_tags, links, skipped_links, chunks).

    A document that is there again is refused, or replaced with ``overwrite``.  Tags that are no
    longer known, and links to connectors that are gone, are left out and counted.
    """
    state = tables.state()
    ids = keep(ids.select("document_id").distinct(), "trash-ids")
    hit = tables.touched(ids, "document_id")
    trash = tables.read("trash", hit, state)
    waiting = trash.filter("restored_at is null").join(ids, "document_id", "left_semi")
    there = tables.read("document", hit, state).select(F.col("id").alias("document_id"), F.lit(True).alias("there"))
    waiting = waiting.join(there, "document_id", "left")
    back = waiting if overwrite else waiting.filter("there is null")

    tags = back.select("document_id", F.explode("tags").alias("t")).select("document_id", "t.tag_key", "t.tag_value")
    own_tags = tags.join(known_tags.select("tag_key", "tag_value").distinct(), ["tag_key", "tag_value"], "left_semi")
    links = back.select(F.col("document_id").alias("id"), F.explode("attribution").alias("a")).select("id", "a.connector_id", "a.credential_id")
    own_links = links.join(connectors.select(F.col("id").alias("connector_id")).distinct(), "connector_id", "left_semi")
    chunks = back.select("document_id", F.explode("chunks").alias("c")).select("document_id", "c.chunk_index", "c.content")
    of_table = lambda name: tables.read(name, hit, state)
    rows = {"document": selection.populate(back, of_table("document").schema), "tag": own_tags, "attribution": own_links, "chunk": chunks}
    goes = back.select("document_id")
    if overwrite:
        kept = lifecycle.cascade({n: (of_table(n), k) for n, k in HELD.items()}, goes)
        changes = {n: Change(kept[n].unionByName(rows[n], allowMissingColumns=True), [HELD[n]], hit) for n in HELD}
    else:  # nothing is replaced: rows are added, in the tables' columns
        changes = {n: Change(of_table(n).filter("false").unionByName(rows[n], allowMissingColumns=True), [HELD[n]], append=True) for n in HELD}
    restored = trash.join(goes.withColumn("_back", F.lit(True)), "document_id", "left")
    restored = restored.withColumn("restored_at", F.when(F.col("_back"), F.lit(now).cast("timestamp")).otherwise(F.col("restored_at"))).drop("_back")
    changes["trash"] = Change(restored, ["document_id"], hit)

    count = lambda df, key, name: df.groupBy(F.col(key).alias("document_id")).agg(F.count("*").alias(name))
    outcome = waiting.select("document_id", F.when(F.col("there").isNull() | F.lit(overwrite), "restored").otherwise("refused_exists").alias("outcome"))
    outcome = ids.join(outcome, "document_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("not_found")))
    for df, key, name in ((tags, "document_id", "_tags"), (own_tags, "document_id", "tags"), (links, "id", "_links"), (own_links, "id", "links"), (chunks, "document_id", "chunks")):
        outcome = outcome.join(count(df, key, name), "document_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0))
    outcome = outcome.select("document_id", "outcome", number("tags").alias("tags"), (number("_tags") - number("tags")).alias("skipped_tags"), number("links").alias("links"),
                             (number("_links") - number("links")).alias("skipped_links"), number("chunks").alias("chunks"))
    report = Change(outcome, ["document_id"])
    tables.commit({**changes, "restore_report": report}, batch, state=state)
    return tables.read("restore_report")


def totals(tables: Tables, now: datetime | str) -> DataFrame:
    """What waits in the trash, and ``restored_total``, what has come back from it."""
    trash = tables.read("trash")
    back = trash.agg(F.count_if(F.col("restored_at").isNotNull()).alias("restored_total"))
    return lifecycle.trash_counts(trash.filter("restored_at is null"), now).crossJoin(back)  # two rows of one
