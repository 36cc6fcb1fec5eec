"""Bulk selections with confirmation, exclusions, duplicate evidence and restoring rows from their snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import lifecycle


class Drift(ValueError):
    """A selection holds other rows than were confirmed; nothing is done."""


def resolve(candidates: DataFrame, ids: list[int] | None = None, states: tuple[str, ...] | None = None, allowed: tuple[str, ...] = (), **filters) -> DataFrame:
    """Candidates named by ids or by a filter, never both, by id; a filter sees the allowed states only."""
    if ids is not None and (states is not None or filters):
        raise ValueError("pass either ids or a filter, not both")
    if ids is not None:
        if not ids:
            raise ValueError("ids must not be empty")
        return candidates.filter(F.col("candidate_id").isin(*ids)).orderBy("candidate_id")
    if states is None and not filters:
        raise ValueError("pass ids or a filter; an empty selector would select nothing")
    wrong = [s for s in states or () if allowed and s not in allowed]
    if wrong:
        raise ValueError(f"this acts on {'/'.join(allowed)} rows; state {wrong[0]!r} is not in that set")
    return lifecycle.filter_candidates(candidates, states=tuple(states or allowed or lifecycle.STATES), **filters).orderBy("candidate_id")


def confirmed(rows: DataFrame, confirm_count: int | None, required: bool = True) -> DataFrame:
    """``rows``, if there are as many as confirmed."""
    if confirm_count is None and not required:
        return rows
    n = rows.count()
    if confirm_count is None:
        raise ValueError(f"confirm_count is required (the selection matches {n} rows)")
    if n != confirm_count:
        raise Drift(f"the selection matches {n} rows, not the confirmed {confirm_count}; nothing was changed")
    return rows


def exclude(exclusions: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, reason, note, created_at) after adding ``new``: reason and note of the new row, the time of the first."""
    known = exclusions.select("document_id", "reason", "note", "created_at", F.lit(0).alias("turn"))
    rows = known.union(new.select("document_id", "reason", "note", "created_at", F.lit(1).alias("turn")))
    return rows.groupBy("document_id").agg(
        F.max_by(F.struct("reason", "note"), F.struct("turn", "created_at", "reason", "note")).alias("said"), F.min("created_at").alias("created_at")).select(
        "document_id", "said.reason", "said.note", "created_at")


def remembered(candidates: DataFrame) -> DataFrame:
    """Exclusions for candidates deleted for good: the note names detector and code of the first reason."""
    first = F.try_element_at("reasons", F.lit(1))
    return candidates.select("document_id", F.lit("deleted_with_remember").alias("reason"), F.concat_ws("/", first["detector"], first["code"]).alias("note"), "created_at")


def allow_again(exclusions: DataFrame, documents: DataFrame) -> DataFrame:
    return exclusions.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def exclusions_page(exclusions: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first, with the total on every row."""
    page = exclusions.orderBy(F.col("created_at").desc(), "document_id").offset(offset).limit(limit)
    count = exclusions.agg(F.count("*").alias("total"))
    return page.join(F.broadcast(count), how="cross")  # one row


def duplicate_evidence(reasons: Column) -> Column:
    """(kept, similarity) of the first duplicate reason whose evidence names the kept document; similarity 1 if it has none."""
    own = F.filter(reasons, lambda r: (r["detector"] == "duplicate") & F.get_json_object(r["evidence"], "$.kept").isNotNull())
    evidence = F.try_element_at(own, F.lit(1))["evidence"]
    similarity = F.coalesce(F.get_json_object(evidence, "$.similarity").try_cast("double"), F.lit(1.0))
    return F.when(F.size(own) > 0, F.struct(F.get_json_object(evidence, "$.kept").alias("kept"), similarity.alias("similarity")))


def hidden_flags(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, present, hidden): whether documents are hidden now, null for those that are gone."""
    now = documents.select("id", F.lit(True).alias("present"), "hidden")
    return ids.select("id").join(now, "id", "left").select("id", F.coalesce("present", F.lit(False)).alias("present"), "hidden")


def snapshot(rows: DataFrame, key: str) -> DataFrame:
    """(key, row): every row as JSON."""
    return rows.select(F.col(key).alias("key"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row"))


def populate(snapshots: DataFrame, schema: StructType) -> DataFrame:
    """Rows from their JSON: fields that a snapshot lacks are null, and those that ``schema`` lacks are left out."""
    return snapshots.select(F.from_json("row", schema).alias("r")).select("r.*")


def restore(table: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``snapshots`` put back; rows that are there again stay as they are."""
    back = populate(snapshots, table.schema).select(*table.columns).dropDuplicates([key])
    return table.unionByName(back.join(table.select(key).distinct(), key, "left_anti").select(*table.columns))


def trash_preview(chunks: DataFrame, width: int = 240) -> DataFrame:
    """(document_id, n_chars, previews): a trashed document's text size and the start of each chunk, in order."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", F.coalesce("content", F.lit("")).alias("content"))))
    rows = chunks.groupBy("document_id").agg(parts.alias("parts"))
    return rows.select("document_id", F.length(F.array_join("parts.content", "\n\n")).alias("n_chars"), F.transform("parts", lambda p: F.substring(p["content"], 1, width)).alias("previews"))
