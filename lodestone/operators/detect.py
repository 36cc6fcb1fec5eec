"""Detectors: measured documents to reasons (detector, code, detail, confidence, evidence)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import language
from lodestone.functions.url import is_asset

THIN_WORDS, STUB_DAYS, STALE_DAYS = 40, 7, 730


def reason(detector: str, code: str | Column, detail: Column, confidence: float | Column, evidence: Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(detector).alias("detector"), as_col(code).alias("code"), detail.cast("string").alias("detail"),
                    as_col(confidence).cast("float").alias("confidence"), evidence.cast("string").alias("evidence"))


def age_days(ts: Column, now: datetime | str) -> Column:
    """Whole days, cut towards zero."""
    return ((F.lit(now).cast("timestamp").cast("long") - ts.cast("long")) / 86400).cast("int")


def asset_url(exempt: tuple[int, ...] = (), binary_documents: bool = False) -> Column:
    kind = is_asset(F.col("url_class")) | (F.lit(binary_documents) & (F.col("url_class") == "binary_document"))
    hit = kind & (F.col("chunk_count") <= 1)
    if exempt:
        hit = hit & ~F.coalesce(F.col("connector_id").isin(*exempt), F.lit(False))
    return F.when(hit, reason("url_junk", "asset_url", F.col("url_class"), 0.85, F.col("id")))


def stub(now: datetime | str, days: int = STUB_DAYS) -> Column:
    age = age_days(F.col("sort_ts"), now)
    return F.when((F.col("chunk_count") == 0) & (age >= days), reason("thin", "chunkless_stub", age, 0.9, F.lit(None)))


def thin(words: int = THIN_WORDS) -> Column:
    """Few words in a whole text; runs whether or not other text detectors do."""
    hit = (F.col("word_count") > 0) & (F.col("word_count") < words) & ~F.coalesce(F.col("clipped"), F.lit(False))
    return F.when(hit, reason("thin", "thin_content", F.col("word_count"), 0.6, F.lit(None)))


def stale(now: datetime | str, days: int = STALE_DAYS) -> Column:
    age = age_days(F.col("sort_ts"), now)
    return F.when(F.col("recrawl_risk") & (age >= days), reason("stale", "stale_content", age, 0.5, F.lit(None)))


def low_quality(exempt: tuple[int, ...] = ()) -> Column:
    hit = F.col("is_candidate") & ~F.coalesce(F.col("clipped"), F.lit(False))
    if exempt:
        hit = hit & ~F.coalesce(F.col("connector_id").isin(*exempt), F.lit(False))
    return F.when(hit, reason("quality", "low_quality_text", F.array_join("gates", ","), F.col("confidence"), F.array_join("families", ",")))


def lang_not_allowed(allowed: tuple[str, ...]) -> Column:
    known = F.col("lang_code").isNotNull() & ~F.coalesce(language.allowed(F.col("lang_code"), allowed), F.lit(False))
    sure = F.col("lang_confidence") * F.when(F.col("mixed_with").isNotNull(), 0.7).otherwise(1.0)
    return F.when(known, reason("language", "lang_not_allowed", F.col("lang_code"), sure, F.col("mixed_with")))


def reasons(measured: DataFrame, *found: Column) -> DataFrame:
    """Add ``reasons``: those found, in the order given; rows without any go."""
    return measured.withColumn("reasons", F.array_compact(F.array(*found))).filter(F.size("reasons") > 0)


@dataclass(frozen=True)
class Rule:
    """A user's rule: ``url_rule`` on the id, ``tag_rule`` on ``key=value`` or the value."""

    name: str
    kind: str
    pattern: str
    confidence: float = 0.8
    enabled: bool = True

    def __post_init__(self):
        re.compile(self.pattern)
        if not 0 <= self.confidence <= 1:
            raise ValueError("confidence outside 0-1")
        if self.kind not in ("url_rule", "tag_rule"):
            raise ValueError(f"unknown rule kind {self.kind}")


def url_rule(rule: Rule) -> Column:
    hit = F.regexp_extract("id", rule.pattern, 0)
    return F.when(F.lit(rule.enabled) & F.col("id").rlike(rule.pattern), reason("url_rule", rule.name, F.lit(rule.pattern), rule.confidence, hit))


def tag_rule(rule: Rule, tags: str = "tags") -> Column:
    """The first tag that matches, as ``key=value`` or by its value."""
    hits = F.filter(F.col(tags), lambda t: t.rlike(rule.pattern) | F.regexp_replace(t, "^[^=]*=", "").rlike(rule.pattern))
    return F.when(F.lit(rule.enabled) & (F.size(hits) > 0), reason("tag_rule", rule.name, F.lit(rule.pattern), rule.confidence, F.try_element_at(hits, F.lit(1))))


def preview(documents: DataFrame, rule: Rule, samples: int = 20) -> DataFrame:
    """(matched, samples): how many documents a rule hits and the first ids of them."""
    hit = (url_rule if rule.kind == "url_rule" else tag_rule)(rule).isNotNull()
    ids = documents.filter(hit)
    first = ids.select("id").orderBy("id").limit(samples).agg(F.array_sort(F.collect_list("id")).alias("samples"))
    return ids.agg(F.count("*").alias("matched")).join(F.broadcast(first), how="left")  # one row each
