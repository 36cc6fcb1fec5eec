"""Document listings: filters, sorts, pages, attribution, counts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cursor import Cursor, after, clamp, offset_of, ordering, parse_sort


@dataclass(frozen=True)
class DocumentFilter:
    """A conjunction; None leaves a condition out."""

    search: str | None = None
    hidden: bool | None = None
    chunk_min: int | None = None
    chunk_max: int | None = None
    updated_after: datetime | str | None = None
    updated_before: datetime | str | None = None
    connector_ids: tuple[int, ...] | None = None
    source: str | None = None

    def __post_init__(self):
        if None not in (self.chunk_min, self.chunk_max) and self.chunk_min > self.chunk_max:
            raise ValueError("chunk_min is above chunk_max")
        if None not in (self.updated_after, self.updated_before) and str(self.updated_after) > str(self.updated_before):
            raise ValueError("updated_after is past updated_before")

    @property
    def unfiltered(self) -> bool:
        return self == DocumentFilter()

    @property
    def touches_connector(self) -> bool:
        return self.connector_ids is not None or self.source is not None


def effective_recency(df: DataFrame) -> DataFrame:
    """Add ``sort_ts``: the source's update time, else the last change seen."""
    return df.withColumn("sort_ts", F.coalesce("doc_updated_at", "last_modified"))


def attribute(documents: DataFrame, attribution: DataFrame, connectors: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Left-join the lowest connector of each document (and its cc-pair's status)."""
    own = attribution.join(connectors.select(F.col("id").alias("connector_id"), F.col("name").alias("connector_name"), "source"), "connector_id")
    fields = F.struct("connector_id", "credential_id", "connector_name", "source")
    first = own.groupBy("id").agg(F.min(fields).alias("a")).select("id", "a.*")
    if pairs is not None:
        status = pairs.select("connector_id", "credential_id", F.col("id").alias("cc_pair_id"), F.col("name").alias("cc_pair_name"), F.col("status").alias("cc_status"))
        first = first.join(status, ["connector_id", "credential_id"], "left")
    return documents.join(first, "id", "left")


def recrawl_risk(status: Column) -> Column:
    return F.coalesce(status.isin("ACTIVE", "INITIAL_INDEXING"), F.lit(False))


def filter_documents(documents: DataFrame, f: DocumentFilter, attribution: DataFrame | None = None, connectors: DataFrame | None = None) -> DataFrame:
    """Rows that meet every condition; rows of unknown chunk count meet no range."""
    df = documents if "sort_ts" in documents.columns else effective_recency(documents)
    if f.search:
        df = df.filter(F.lower("semantic_id").contains(f.search.lower()) | F.lower("id").contains(f.search.lower()))
    if f.hidden is not None:
        df = df.filter(F.col("hidden") == f.hidden)
    for test in (f.chunk_min is not None and F.col("chunk_count") >= f.chunk_min, f.chunk_max is not None and F.col("chunk_count") <= f.chunk_max,
                 f.updated_after is not None and F.col("sort_ts") >= F.lit(f.updated_after).cast("timestamp"),
                 f.updated_before is not None and F.col("sort_ts") <= F.lit(f.updated_before).cast("timestamp")):
        if test is not False:
            df = df.filter(test)
    if f.touches_connector:
        own = attribution
        if f.connector_ids is not None:
            own = own.filter(F.col("connector_id").isin(*f.connector_ids)) if f.connector_ids else own.filter(F.lit(False))
        if f.source is not None:
            kinds = connectors.filter(F.upper("source") == f.source.upper()).select(F.col("id").alias("connector_id"))
            own = own.join(kinds, "connector_id", "left_semi")
        df = df.join(own.select("id"), "id", "left_semi")
    return df


def list_documents(documents: DataFrame, attribution: DataFrame, connectors: DataFrame, f: DocumentFilter = DocumentFilter(), sort: str = "updated_desc",
                   cursor: str | None = None, page: int | None = None, limit: int = 50) -> DataFrame:
    """One page: filter, take the page in total order, then attribute only its rows."""
    sort = parse_sort(sort)
    df = filter_documents(documents, f, attribution, connectors)
    if cursor is not None:
        df = df.filter(after(Cursor.decode(cursor, sort)))
    df = df.orderBy(*ordering(sort))
    if page is not None:
        df = df.offset(offset_of(page, limit))
    rows = df.limit(clamp(limit, 50, 1000)).select("id", "semantic_id", "boost", "hidden", "sort_ts", "chunk_count")
    return attribute(rows, attribution, connectors).orderBy(*ordering(sort))


def has_more(page: DataFrame, limit: int) -> DataFrame:
    """(rows, more) of a page that was asked for with one row to spare."""
    n = page.agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(limit)).alias("rows"), (F.col("n") > limit).alias("more"))


def count_documents(documents: DataFrame, f: DocumentFilter = DocumentFilter(), attribution: DataFrame | None = None, connectors: DataFrame | None = None, bound: int | None = None) -> DataFrame:
    """Exact count; with a bound, counting stops one past it."""
    df = filter_documents(documents, f, attribution, connectors)
    if bound is None:
        return df.agg(F.count("*").alias("total"))
    return df.limit(bound + 1).agg(F.count("*").alias("n")).select(F.least("n", F.lit(bound)).alias("total"), (F.col("n") <= bound).alias("exact"))


def document_detail(documents: DataFrame, attribution: DataFrame, connectors: DataFrame, pairs: DataFrame, tags: DataFrame, ids: list[str]) -> DataFrame:
    """Rows by id with attribution, recrawl risk and tags."""
    rows = attribute(effective_recency(documents.filter(F.col("id").isin(*ids))), attribution, connectors, pairs)
    own = tags.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.concat_ws("=", "tag_key", "tag_value"))).alias("tags"))
    shown = rows.join(own, "id", "left").withColumn("recrawl_risk", recrawl_risk(F.col("cc_status")))
    return shown.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def hydrate(ranked: DataFrame, documents: DataFrame, attribution: DataFrame | None = None, connector_ids: tuple[int, ...] | None = None) -> DataFrame:
    """Rows of (id, rank), in that order; with connectors given, only their documents."""
    rows = ranked.join(documents, "id", "left").withColumn("pg_row", F.col("last_modified").isNotNull())
    if connector_ids is not None:
        rows = rows.join(attribution.filter(F.col("connector_id").isin(*connector_ids)).select("id"), "id", "left_semi").filter("pg_row")
    return rows.orderBy("rank")


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page whose rows carry the count of all rows (counted beside it, not in one window)."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), how="left").orderBy(*order)  # one row


def in_scope(documents: DataFrame, kind: str = "all", value: object = None, attribution: DataFrame | None = None) -> DataFrame:
    """Scope of a scan: all, connectors (ids) or url_prefix."""
    if kind == "all":
        return documents
    if kind == "connectors":
        return documents.join(attribution.filter(F.col("connector_id").isin(*value)).select("id"), "id", "left_semi")
    if kind == "url_prefix":
        return documents.filter(F.col("id").startswith(value))
    raise ValueError(f"unknown scope {kind}")


def merge_patch(old: Column, patch: Column) -> Column:
    """Shallow merge of two string maps; the patch wins."""
    base = F.coalesce(old, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(patch, k)), patch)


def leaderboard(documents: DataFrame, attribution: DataFrame, connectors: DataFrame, by: str = "docs", limit: int = 50) -> DataFrame:
    """Connectors by documents or by recency, nulls last, ties by id."""
    own = attribution.join(effective_recency(documents).select("id", "sort_ts"), "id").groupBy("connector_id").agg(
        F.countDistinct("id").alias("docs"), F.max("sort_ts").alias("latest"))
    rows = connectors.select(F.col("id").alias("connector_id"), "name").join(own, "connector_id", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    key = F.col("docs").desc() if by == "docs" else F.col("latest").desc_nulls_last()
    return rows.orderBy(key, "connector_id").limit(limit)


def first_rows(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
