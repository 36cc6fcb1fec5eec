"""The lifecycle of candidates as table transitions: state and commands in, new state and outcomes out.

Nothing is changed in place; each step returns new DataFrames, so a step can be
repeated after a failure.  ``now`` is always given.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = ("candidate", "staged", "deleting")
STATES = (*OPEN, "deleted", "restored", "dismissed")
#: command -> (states it acts on, state after).
TRANSITIONS = {
    "stage": (("candidate",), "staged"), "restore": (("staged",), "restored"), "dismiss": (("candidate",), "dismissed"), "expedite": (("staged",), "staged"),
    "claim": (("staged",), "deleting"), "mark_deleted": (("deleting",), "deleted"), "unclaim": (("deleting",), "staged"),
}
MAX_GRACE_DAYS = 90
#: scan detector -> detector that its reasons name.
REASON_NAMES = {"exact_duplicate": "duplicate", "near_duplicate": "duplicate", "url_variant": "url_junk"}


def merge_reasons(old: Column, new: Column) -> Column:
    """Reasons of ``old`` that ``new`` does not say again, then those of ``new``."""
    said = lambda r: F.exists(new, lambda n: (n["detector"] == r["detector"]) & (n["code"] == r["code"]))
    return F.concat(F.filter(old, lambda r: ~said(r)), new)


def top_confidence(reasons: Column) -> Column:
    return F.array_max(F.transform(reasons, lambda r: r["confidence"]))


def upsert(candidates: DataFrame, hits: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Outcome of each hit (document_id, reasons): inserted, merged, left or excluded, with the reasons after."""
    is_open = F.col("state").isin(*OPEN)
    held = candidates.filter(is_open).select("document_id", F.col("state").alias("held_state"), F.col("reasons").alias("held_reasons"))
    out = hits.join(held, "document_id", "left").join(exclusions.select("document_id", F.lit(True).alias("excluded")), "document_id", "left")
    outcome = (F.when(F.col("excluded"), "excluded").when(F.col("held_state").isNull(), "inserted").when(F.col("held_state") == "candidate", "merged").otherwise("left"))
    out = out.withColumn("outcome", outcome)
    after = F.when(F.col("outcome") == "merged", merge_reasons(F.col("held_reasons"), F.col("reasons"))).when(F.col("outcome") == "inserted", F.col("reasons")).otherwise(F.col("held_reasons"))
    return out.select("document_id", "outcome", after.alias("reasons")).withColumn("confidence", top_confidence(F.col("reasons")))


def close_stale(candidates: DataFrame, scan_id: int, detectors: tuple[str, ...], scope: DataFrame | None = None) -> DataFrame:
    """Open candidates of other scans, all of whose reasons this scan looked for and did not find again."""
    names = sorted({REASON_NAMES.get(d, d) for d in detectors})
    gone = (F.col("state") == "candidate") & (F.col("scan_id") != scan_id) & F.forall("reasons", lambda r: r["detector"].isin(*names))
    rows = candidates
    if scope is not None:
        rows = rows.join(scope.select(F.col("id").alias("document_id"), F.lit(True).alias("_in")), "document_id", "left")
        gone = gone & F.coalesce("_in", F.lit(False))
    rows = rows.withColumn("_gone", gone)
    return rows.withColumn("state", F.when(F.col("_gone"), "dismissed").otherwise(F.col("state"))).withColumn(
        "resolution", F.when(F.col("_gone"), "no_longer_matches")).drop("_gone", "_in")


def transition(candidates: DataFrame, commands: DataFrame, now: datetime | str, grace_days: int = 14) -> tuple[DataFrame, DataFrame]:
    """(new state, outcomes) of commands (candidate_id, command, and seq if they come in an order).

    A row in another state is a conflict.  Of several commands for a candidate the first
    by ``seq`` counts, then by name.
    """
    turn = F.struct(*[c for c in ("seq", "command") if c in commands.columns])
    own = commands.groupBy("candidate_id").agg(F.min_by("command", turn).alias("command"))
    rows = candidates.join(own, "candidate_id", "left")
    fits, after = F.lit(False), F.col("state")
    for name, (states, then) in TRANSITIONS.items():
        hit = (F.col("command") == name) & F.col("state").isin(*states)
        fits, after = fits | hit, F.when(hit, F.lit(then)).otherwise(after)
    rows = rows.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_after", F.coalesce(after, F.col("state")))
    at = F.lit(now).cast("timestamp")
    due = at + F.make_dt_interval(F.lit(max(0, min(grace_days, MAX_GRACE_DAYS))))
    expires = (F.when(F.col("_fits") & (F.col("command") == "stage"), due).when(F.col("_fits") & (F.col("command") == "expedite"), F.least("stage_expires_at", at))
               .when(F.col("_fits") & (F.col("command") == "restore"), F.lit(None)).otherwise(F.col("stage_expires_at")))
    changed = rows.withColumn("stage_expires_at", expires).withColumn("state", F.col("_after"))
    outcomes = rows.filter("command is not null").select("candidate_id", "command", F.when(F.col("_fits"), "done").otherwise("conflict").alias("outcome"), F.col("_after").alias("state"))
    return changed.select(*candidates.columns), outcomes


def visibility(candidates: DataFrame, documents: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, documents) after the commands of ``transition`` that were done.

    Staging notes in ``prev_hidden`` whether the document was hidden and hides it; restoring
    makes it what it was.  A document that is gone leaves ``prev_hidden`` as it was.
    """
    held = candidates if "prev_hidden" in candidates.columns else candidates.withColumn("prev_hidden", F.lit(None).cast("boolean"))
    done = outcomes.filter("outcome = 'done'").select("candidate_id", "command").join(held.select("candidate_id", "document_id", "prev_hidden"), "candidate_id")
    staged = done.filter("command = 'stage'").join(documents.select(F.col("id").alias("document_id"), F.coalesce("hidden", F.lit(False)).alias("_was")), "document_id")
    noted = held.join(staged.select("candidate_id", "_was"), "candidate_id", "left").withColumn("prev_hidden", F.coalesce("_was", "prev_hidden")).drop("_was")
    to = F.when(F.col("command") == "stage", F.lit(True)).when(F.col("command") == "restore", F.coalesce("prev_hidden", F.lit(False)))
    shown = done.select("document_id", to.alias("_to")).filter("_to is not null").groupBy("document_id").agg(F.bool_or("_to").alias("_to"))
    seen = documents.join(shown, F.col("id") == F.col("document_id"), "left").withColumn("hidden", F.coalesce("_to", "hidden"))
    return noted, seen.select(*documents.columns)


def due(candidates: DataFrame, now: datetime | str) -> DataFrame:
    return candidates.filter((F.col("state") == "staged") & (F.col("stage_expires_at") <= F.lit(now).cast("timestamp")))


def reaper_plan(candidates: DataFrame, busy_connectors: DataFrame, now: datetime | str, hourly_budget: int, deleted_last_hour: int) -> DataFrame:
    """(candidate_id, action): due rows in order of expiry, as many as the hour's budget leaves; rows of busy connectors wait.

    Only the rows that the budget can reach are ranked, by a bounded top-n.
    """
    left = max(0, hourly_budget - deleted_last_hour)
    rows = due(candidates, now).join(busy_connectors.select("connector_id", F.lit(True).alias("busy")).distinct(), "connector_id", "left")
    free = rows.filter("busy is null").orderBy("stage_expires_at", "candidate_id").limit(left).select("candidate_id", F.lit(True).alias("chosen"))
    rows = rows.join(free, "candidate_id", "left")
    action = F.when(F.col("busy"), "deferred_busy").when(F.col("chosen"), "delete").otherwise("deferred_budget")
    return rows.select("candidate_id", action.alias("action"))


def recrawled(exclusions: DataFrame, documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Excluded documents that are back and have no open row."""
    return exclusions.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").join(
        candidates.filter(F.col("state").isin(*OPEN)).select("document_id"), "document_id", "left_anti").select("document_id")


def stuck(candidates: DataFrame, changed: str, now: datetime | str, minutes: int = 10) -> DataFrame:
    """Rows left in ``deleting`` for over ten minutes, oldest first."""
    return candidates.filter((F.col("state") == "deleting") & (F.col(changed) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES"))).orderBy(changed, "candidate_id")


def filter_candidates(candidates: DataFrame, now: datetime | str | None = None, states: tuple[str, ...] = OPEN, detector: str | None = None, connector_id: int | None = None,
                      min_confidence: float | None = None, recrawl_risk: bool | None = None, due_only: bool = False) -> DataFrame:
    df = due(candidates, now) if due_only else candidates.filter(F.col("state").isin(*states))
    if detector is not None:
        df = df.filter(F.exists("reasons", lambda r: r["detector"] == detector))
    if connector_id is not None:
        df = df.filter(F.col("connector_id") == connector_id)
    if min_confidence is not None:
        if not 0 <= min_confidence <= 1:
            raise ValueError("confidence outside 0-1")
        df = df.filter(F.col("confidence") >= F.lit(min_confidence).cast("float"))
    return df if recrawl_risk is None else df.filter(F.col("recrawl_risk") == recrawl_risk)


CANDIDATE_ORDERS = {
    "confidence": lambda: [F.col("confidence").desc(), F.col("candidate_id").desc()], "chunks_desc": lambda: [F.col("chunk_count").desc_nulls_last(), F.col("candidate_id").desc()],
    "chunks_asc": lambda: [F.col("chunk_count").asc_nulls_last(), F.col("candidate_id").desc()], "created_desc": lambda: [F.col("created_at").desc(), F.col("candidate_id").desc()],
    "created_asc": lambda: [F.col("created_at").asc(), F.col("candidate_id").asc()], "expiry": lambda: [F.col("stage_expires_at").asc_nulls_last(), F.col("candidate_id").asc()],
}


def state_counts(candidates: DataFrame, now: datetime | str) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    return candidates.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES], F.count_if((F.col("state") == "staged") & (F.col("stage_expires_at") <= at)).alias("due"),
                          F.min(F.when(F.col("state") == "staged", F.col("stage_expires_at"))).alias("next_due"))


def live_chunk_count(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """The document's own count where it exists, even if null; else the count when flagged."""
    d = documents.select(F.col("id").alias("document_id"), F.col("chunk_count").alias("_live"), F.lit(True).alias("_there"))
    rows = candidates.join(d, "document_id", "left").withColumn("doc_exists", F.coalesce("_there", F.lit(False)))
    return rows.withColumn("chunk_count", F.when(F.col("doc_exists"), F.col("_live")).otherwise(F.col("chunk_count"))).drop("_live", "_there")


def capture(documents: DataFrame, tags: DataFrame, attribution: DataFrame, chunks: DataFrame, now: datetime | str, retention_days: int = 30) -> DataFrame:
    """Snapshots for the trash: the row, its tags, attribution and all chunks, as JSON; short reads are refused by ``complete``."""
    row = documents.select(F.col("id").alias("document_id"), "chunk_count", F.to_json(F.struct(*documents.columns)).alias("row"))
    t = tags.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("tag_key", "tag_value"))).alias("tags"))
    a = attribution.groupBy(F.col("id").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("connector_id", "credential_id"))).alias("attribution"))
    c = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("chunks"))
    out = row.join(t, "document_id", "left").join(a, "document_id", "left").join(c, "document_id", "left")
    out = out.withColumn("n_chunks", F.coalesce(F.size("chunks"), F.lit(0))).withColumn("complete", F.col("chunk_count").isNull() | (F.col("n_chunks") >= F.col("chunk_count")))
    at = F.lit(now).cast("timestamp")
    return out.withColumn("byte_size", F.octet_length("row") + F.coalesce(F.octet_length(F.to_json("chunks")), F.lit(0))).withColumn("deleted_at", at).withColumn(
        "expires_at", at + F.make_dt_interval(F.lit(retention_days))).withColumn("hold", F.lit(False))


def complete_ids(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id): the documents whose snapshot ``capture`` finds complete, without their chunks."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    rows = documents.select(F.col("id").alias("document_id"), "chunk_count").join(n, "document_id", "left")
    return rows.filter(F.col("chunk_count").isNull() | (F.coalesce("n_chunks", F.lit(0)) >= F.col("chunk_count"))).select("document_id").distinct()


def restore_plan(trash: DataFrame, documents: DataFrame, connectors: DataFrame, overwrite: bool = False) -> DataFrame:
    """Per snapshot: restore or refuse, with the connectors that are gone."""
    there = documents.select(F.col("id").alias("document_id"), F.lit(True).alias("exists"))
    links = trash.select("document_id", F.explode_outer("attribution").alias("a")).select("document_id", F.col("a.connector_id").alias("connector_id"))
    gone = links.filter("connector_id is not null").join(connectors.select(F.col("id").alias("connector_id")), "connector_id", "left_anti").groupBy("document_id").agg(F.count("*").alias("missing"))
    rows = trash.select("document_id").join(there, "document_id", "left").join(gone, "document_id", "left")
    outcome = F.when(F.col("exists") & F.lit(not overwrite), "refused_exists").otherwise("restored")
    return rows.select("document_id", outcome.alias("outcome"), F.coalesce("missing", F.lit(0)).alias("missing_connectors"))


def trash_counts(trash: DataFrame, now: datetime | str) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    return trash.agg(F.count("*").alias("items"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"), F.count_if(~F.col("hold") & (F.col("expires_at") <= at + F.expr("INTERVAL 7 DAYS"))).alias("expiring_7d"),
                     F.count_if("hold").alias("on_hold"), F.min(F.when(~F.col("hold"), F.col("expires_at"))).alias("soonest"))


def purge_due(trash: DataFrame, now: datetime | str) -> DataFrame:
    return trash.filter(~F.col("hold") & (F.col("expires_at") <= F.lit(now).cast("timestamp")))


def cascade(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table (frame, key) without the rows of the deleted documents."""
    gone = ids.select("document_id").distinct()
    return {name: df.join(gone, df[key] == gone["document_id"], "left_anti") for name, (df, key) in tables.items()}


def newest_annotations(annotations: DataFrame) -> DataFrame:
    """One row a subject: its latest generation."""
    fields = [c for c in annotations.columns if c != "subject_key"]
    latest = F.max(F.struct("generated_at", *[c for c in fields if c != "generated_at"])).alias("a")
    return annotations.groupBy("subject_key").agg(latest).select("subject_key", "a.*")


def missing_annotations(subjects: DataFrame, annotations: DataFrame, model: str, prompt_hash: str) -> DataFrame:
    done = annotations.filter((F.col("model") == model) & (F.col("prompt_hash") == prompt_hash)).select("subject_key")
    return subjects.join(done, "subject_key", "left_anti")


def audit(audit_log: DataFrame, action: str | None = None, actor: str | None = None, document_id: str | None = None, since: datetime | str | None = None) -> DataFrame:
    df = audit_log
    for c, v in (("action", action), ("actor", actor), ("document_id", document_id)):
        df = df if v is None else df.filter(F.col(c) == v)
    df = df if since is None else df.filter(F.col("at") >= F.lit(since).cast("timestamp"))
    return df.orderBy(F.col("at").desc(), F.col("id").desc())


def trailing_deletions(log: DataFrame, ts: str = "at", seconds: int = 3600) -> DataFrame:
    """Deletions in the hour before each one, by the day's shard so that no task holds all history."""
    rows = log.withColumn("_day", F.to_date(ts))
    own = rows.withColumn("_s", F.unix_seconds(F.col(ts).cast("timestamp"))).withColumn("_home", F.lit(True))
    spill = own.filter(F.to_date(F.timestamp_seconds(F.col("_s") + seconds)) != F.col("_day")).withColumn("_day", F.date_add("_day", 1)).withColumn("_home", F.lit(False))
    w = Window.partitionBy("_day").orderBy("_s").rangeBetween(-seconds + 1, 0)
    return own.union(spill).withColumn("trailing", F.count("*").over(w)).filter("_home").drop("_day", "_s", "_home")
