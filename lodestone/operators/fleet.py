"""Connector fleets: filters, sorts, totals, resolution by reference, attempt errors and the overview."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names listed at most when a reference is ambiguous.
LISTED = 10
SORTS = {
    "docs": lambda: [F.col("doc_count").desc(), F.col("cc_pair_id")],
    "name": lambda: [F.lower("name"), F.col("cc_pair_id")],
    "status": lambda: [F.col("status"), F.col("doc_count").desc(), F.col("cc_pair_id")],
    "source": lambda: [F.col("source"), F.col("doc_count").desc(), F.col("cc_pair_id")],
}


def filtered(fleet: DataFrame, query: str | None = None, status: str | None = None, parked: bool = False, source: str | None = None) -> DataFrame:
    """Connectors whose name holds ``query``, of a status and a source, in any case."""
    rows = fleet
    if query is not None:
        rows = rows.filter(F.contains(F.lower("name"), F.lit(query.lower())))
    if status is not None:
        rows = rows.filter(F.upper("status") == status.upper())
    if parked:
        rows = rows.filter("parked")
    if source is not None:
        rows = rows.filter(F.upper("source") == source.upper())
    return rows


def ordered(fleet: DataFrame, by: str = "docs") -> DataFrame:
    if by.lower() not in SORTS:
        raise ValueError(f"unknown sort {by!r}; expected {', '.join(sorted(SORTS))}")
    return fleet.orderBy(*SORTS[by.lower()]())


def totals(fleet: DataFrame, *by: str) -> DataFrame:
    """Connectors, documents, parked, stalled and at-risk ones, of all or by columns."""
    return fleet.groupBy(*by).agg(F.count("*").alias("connectors"), F.sum("doc_count").alias("documents"), F.count_if("parked").alias("parked"), F.count_if("stalled").alias("stalled"),
                                  F.count_if(F.col("parked") | F.col("stalled")).alias("at_risk"))


def columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in that order; an unknown one is an error."""
    known = {c.lower(): c for c in rows.columns}
    unknown = [n for n in names if n.lower() not in known]
    if unknown:
        raise ValueError(f"unknown column {unknown[0]!r}; expected {', '.join(rows.columns)}")
    return rows.select(*[known[n.lower()] for n in names])


def resolve(fleet: DataFrame, references: DataFrame) -> DataFrame:
    """(reference, cc_pair_id, outcome, listed) of each reference.

    An exact name goes first, then the name in any case, the pair's id, the connector's
    id, and a part of one name only; a number is never taken as a part of a name.
    ``listed`` names up to ``LISTED`` connectors where several match.
    """
    asked = references.select("reference", F.trim("reference").alias("needle")).withColumn("number", F.col("needle").try_cast("int"))
    own = fleet.select("cc_pair_id", "connector_id", "name")
    by = lambda df, step, same: df.join(own, same).select("reference", "cc_pair_id", "name", F.lit(step).alias("own"))
    equal = [by(asked, 1, F.col("name") == F.col("needle")), by(asked, 2, F.lower("name") == F.lower("needle")),
             by(asked, 3, F.col("cc_pair_id") == F.col("number")), by(asked, 4, F.col("connector_id") == F.col("number"))]
    met = reduce(DataFrame.union, equal)
    # What nothing equals is sought inside names: they meet by the first three characters, then the whole is compared.
    low = F.lower("name")
    grams = F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.array(*[F.substring(low, i, F.lit(n)) for n in (1, 2, 3)]))
    inside = own.filter(F.length("name") > 0).select("cc_pair_id", "name", F.explode(F.array_distinct(F.flatten(grams))).alias("start"))
    rest = asked.join(met.select("reference").distinct(), "reference", "left_anti").filter("number is null and needle <> ''").withColumn("start", F.substring(F.lower("needle"), 1, 3))
    part = rest.join(inside, "start").filter(F.contains(low, F.lower("needle")))
    met = met.union(part.select("reference", "cc_pair_id", "name", F.lit(5).alias("own")))
    first = met.groupBy("reference").agg(F.min("own").alias("step"))
    same = met.join(first, "reference").filter("own = step")
    found = same.groupBy("reference", "step").agg(F.count("cc_pair_id").alias("n"), F.min("cc_pair_id").alias("least"), F.array_sort(F.collect_set("name")).alias("names"))
    rows = asked.select("reference").distinct().join(found, "reference", "left")
    clear = (F.col("step") < 5) | (F.col("n") == 1)
    return rows.select("reference", F.when(clear, F.col("least")).alias("cc_pair_id"), F.when(F.col("step").isNull(), "not found").when(clear, "found").otherwise("ambiguous").alias("outcome"),
                       F.when(~clear, F.slice("names", 1, LISTED)).alias("listed"))


def attempt_errors(errors: DataFrame, cc_pair_id: int | None = None, unresolved_only: bool = False) -> DataFrame:
    """Per-document failures, newest first."""
    rows = errors if cc_pair_id is None else errors.filter(F.col("cc_pair_id") == cc_pair_id)
    rows = rows.filter(~F.col("is_resolved")) if unresolved_only else rows
    return rows.orderBy(F.col("time_created").desc(), F.col("id").desc())


def recent_errors(errors: DataFrame, now, hours: int = 24) -> DataFrame:
    """Errors of the rolling window that is kept."""
    at = F.lit(now).cast("timestamp")
    return errors.filter((F.col("time_created") > at - F.make_dt_interval(hours=F.lit(hours))) & (F.col("time_created") <= at))


def error_counts(errors: DataFrame) -> DataFrame:
    """(cc_pair_id, errors, unresolved)."""
    return errors.groupBy("cc_pair_id").agg(F.count("*").alias("errors"), F.count_if(~F.col("is_resolved")).alias("unresolved"))


def overview(documents: DataFrame, pairs: DataFrame, attempts: DataFrame, now, running: tuple[str, ...] = ("IN_PROGRESS", "NOT_STARTED")) -> DataFrame:
    """One row: documents, connectors and active ones, attempts and failed ones, documents indexed in 15 minutes and 24 hours, runs under way."""
    at = F.lit(now).cast("timestamp")
    since = lambda **t: F.sum(F.when((F.col("time_started") > at - F.make_dt_interval(**{k: F.lit(v) for k, v in t.items()})) & (F.col("time_started") <= at), F.coalesce("new_docs_indexed", F.lit(0))).otherwise(0))
    a = attempts.agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "FAILED").alias("failed"), since(mins=15).alias("docs_15m"), since(hours=24).alias("docs_24h"), F.count_if(F.col("status").isin(*running)).alias("running"))
    c = pairs.agg(F.count("*").alias("connectors"), F.count_if(F.col("status") == "ACTIVE").alias("active"))
    return documents.agg(F.count("*").alias("documents")).join(c, how="cross").join(a, how="cross")  # one row each
