"""Small owned tables: scan runs, rules, policies, model registry, retry queues, narration evidence.

Each call takes tables and returns new ones; the caller writes them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_RETRIES = 5
RUN_STATES = ("pending", "running", "done", "failed", "cancelled")


# --- scan runs ------------------------------------------------------------------------------------------------------

def next_run(runs: DataFrame) -> DataFrame:
    """The run to take up: one that was running, else the oldest pending."""
    return runs.filter(F.col("state").isin("running", "pending")).orderBy((F.col("state") == "running").desc(), "created_at", "scan_id").limit(1)


def move_run(runs: DataFrame, scan_id: int, state: str, checkpoint: str | None = None) -> DataFrame:
    """One run in another state, with its checkpoint; progress sets its retries to zero."""
    if state not in RUN_STATES:
        raise ValueError(f"unknown state {state}")
    hit = F.col("scan_id") == scan_id
    moved = runs.withColumn("retries", F.when(hit & F.lit(checkpoint is not None), 0).when(hit & F.lit(state == "pending"), F.col("retries") + 1).otherwise(F.col("retries")))
    target = F.when(F.lit(state == "pending") & (F.col("retries") > MAX_RETRIES), "failed").otherwise(state)
    return moved.withColumn("state", F.when(hit, target).otherwise(F.col("state"))).withColumn("checkpoint", F.when(hit, F.coalesce(F.lit(checkpoint), "checkpoint")).otherwise(F.col("checkpoint")))


def scan_counters(outcomes: DataFrame) -> DataFrame:
    """(counter, n) of upsert outcomes and reasons."""
    return outcomes.groupBy(F.col("outcome").alias("counter")).agg(F.count("*").alias("n"))


# --- policies and rules ---------------------------------------------------------------------------------------------

def activate(policies: DataFrame, name: str) -> DataFrame:
    """Exactly one policy active."""
    return policies.withColumn("active", F.col("name") == name)


def save(stored: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Rows of ``new`` in place of those with their key."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def seed(stored: DataFrame, starters: DataFrame) -> DataFrame:
    """Starter rows, switched off, into an empty table only."""
    return starters.withColumn("enabled", F.lit(False)).select(*stored.columns) if stored.isEmpty() else stored


# --- model registry -------------------------------------------------------------------------------------------------

def provider_stats(models: DataFrame) -> DataFrame:
    """Models, probed and usable ones of each provider."""
    return models.groupBy("provider").agg(F.count("*").alias("models"), F.count_if("probed").alias("probed"), F.count_if("usable").alias("usable"))


def roles(models: DataFrame, assigned: DataFrame) -> DataFrame:
    """Models with their roles in order, none as an empty array."""
    own = assigned.filter("role is not null").groupBy("model").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return models.join(own, "model", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))


def replace_models(stored: DataFrame, found: DataFrame, provider: str) -> DataFrame:
    """A provider's models as found: gone ones go, known ones keep what was probed."""
    others = stored.filter(F.col("provider") != provider)
    known = stored.filter(F.col("provider") == provider).select("model", *[F.col(c).alias(f"_{c}") for c in ("probed", "usable")])
    now = found.join(known, "model", "left").withColumns({c: F.coalesce(f"_{c}", F.lit(False)) for c in ("probed", "usable")})
    return others.unionByName(now.withColumn("provider", F.lit(provider)).select(*stored.columns))


# --- retry queues ---------------------------------------------------------------------------------------------------

def enqueue(queue: DataFrame, ids: DataFrame, now: datetime | str) -> DataFrame:
    """New ids at the end; ids that wait already stay where they are."""
    fresh = ids.select("document_id").distinct().join(queue.select("document_id"), "document_id", "left_anti")
    return queue.unionByName(fresh.select("document_id", F.lit(now).cast("timestamp").alias("queued_at"), F.lit(0).alias("attempts")))


def drain(queue: DataFrame, done: DataFrame, batch: int = 500) -> tuple[DataFrame, DataFrame]:
    """(batch to try next, queue after): done ones leave, tried ones count an attempt."""
    tried = queue.orderBy("queued_at", "document_id").limit(batch)
    left = queue.join(done.select("document_id"), "document_id", "left_anti").join(tried.select("document_id", F.lit(1).alias("_t")), "document_id", "left")
    return tried, left.withColumn("attempts", F.col("attempts") + F.coalesce("_t", F.lit(0))).drop("_t")


# --- narration ------------------------------------------------------------------------------------------------------

def cluster_evidence(groups: DataFrame, titles: DataFrame, most: int = 12) -> DataFrame:
    """(group_key, evidence): the keeper and up to ``most`` members of each group as lines."""
    w = Window.partitionBy("group_key").orderBy(F.col("is_keeper").desc(), "document_id")
    rows = groups.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).join(titles, "document_id", "left")
    line = F.concat(F.when(F.col("is_keeper"), "keeper: ").otherwise("copy: "), F.coalesce("title", "document_id"))
    return rows.groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("l")).select("group_key", F.array_join(F.col("l.line"), "\n").alias("evidence"))


def annotation_counts(annotations: DataFrame) -> DataFrame:
    """Subjects and generations by kind of subject."""
    return annotations.groupBy("subject_kind").agg(F.countDistinct("subject_key").alias("subjects"), F.count("*").alias("generations"))


def upsert_pairs(held: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs (a, b, method, estimated, verified, cosine, same_connector) with a <= b; what ``new`` says goes first, what it leaves null stays."""
    facts = ("estimated", "verified", "cosine", "same_connector")
    side = lambda df, turn: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "method", *facts, F.lit(turn).alias("turn"))
    rows = side(held, 0).union(side(new, 1))
    said = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("turn", c))).alias(c) for c in facts]
    return rows.groupBy("a", "b", "method").agg(*said)


def set_groups(held: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Memberships (document_id, method, group_key, group_size, is_keeper): one a document and method, the last of ``new`` by ``order``."""
    facts = ("group_key", "group_size", "is_keeper")
    rows = held.select("document_id", "method", *facts, F.lit(None).cast("long").alias("turn")).union(new.select("document_id", "method", *facts, F.col(order).cast("long").alias("turn")))
    last = F.max_by(F.struct(*facts), F.struct(F.col("turn").isNotNull(), "turn", *facts)).alias("last")
    return rows.groupBy("document_id", "method").agg(last).select("document_id", "method", "last.*")


def unsigned(documents: DataFrame, signatures: DataFrame, config_hash: str, fingerprint: str = "content_hash") -> DataFrame:
    """Documents without a signature of this configuration and their present content, which a scan has to sign."""
    own = signatures.filter(F.col("config_hash") == config_hash).select(F.col("document_id").alias("id"), F.col("fingerprint").alias(fingerprint))
    return documents.join(own, ["id", fingerprint], "left_anti")
