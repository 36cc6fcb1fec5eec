"""Policies over measured profiles: signals, bands, simulation, merges of measurements."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """What each signal is good for: ``auto``, ``review``, ``none``, or thresholds of both."""

    exact_duplicate: str = "none"
    url_variant: str = "none"
    asset: str = "none"
    stub: str = "none"
    near_auto: float | None = None
    near_review: float | None = None
    semantic_auto: float | None = None
    semantic_review: float | None = None
    quality_auto_failures: int | None = None
    quality_review_failures: int | None = None
    quality_families: int = 2
    off_topic_percentile: float | None = None
    cross_connector_review_only: bool = True

    def __post_init__(self):
        for name in ("exact_duplicate", "url_variant", "asset", "stub"):
            if getattr(self, name) not in ("auto", "review", "none"):
                raise ValueError(f"{name}: auto, review or none")
        for kind in ("near", "semantic"):
            auto, review = getattr(self, f"{kind}_auto"), getattr(self, f"{kind}_review")
            if any(v is not None and not 0 <= v <= 1 for v in (auto, review)):
                raise ValueError(f"{kind}: thresholds lie in 0-1")
            if None not in (auto, review) and auto < review:
                raise ValueError(f"{kind}: auto is below review")
        if self.off_topic_percentile is not None and not 0 <= self.off_topic_percentile <= 50:
            raise ValueError("off_topic_percentile lies in 0-50")

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:32]


PRESETS = {
    "conservative": Policy("auto", "review", "review", "auto", 0.95, 0.85, None, 0.97, None, 4, 3),
    "standard": Policy("auto", "auto", "auto", "auto", 0.90, 0.80, None, 0.93, None, 3, 2),
    "aggressive": Policy("auto", "auto", "auto", "auto", 0.85, 0.75, 0.97, 0.88, None, 2, 2, 1.0),
}

SIGNALS = ("exact_duplicate", "url_variant", "asset", "stub", "near_duplicate", "semantic", "quality", "off_topic")


@dataclass(frozen=True)
class Clause:
    """A signal's condition for a band; ``base`` is the condition without the guard against crossing connectors."""

    signal: str
    band: str
    test: Column
    base: Column


def prepare(profiles: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Profiles with the facts that clauses read: memberships, and whether the strongest pair crosses connectors.

    Each fact is one pre-aggregated join on the document, so clauses are plain columns.
    """
    loser = ~F.col("is_keeper") & (F.col("group_size") > 1)
    flags = groups.groupBy("document_id").agg(*[
        F.max(F.coalesce((F.col("method") == m) & loser & guard, F.lit(False))).alias(name)
        for m in ("hash", "url") for name, guard in ((f"in_{m}", F.lit(True)), (f"in_{m}_guarded", ~F.col("cross_connector")))])
    df = profiles.join(flags, "document_id", "left")
    crossing = pairs.filter("same_connector = false").select("a", "b").distinct()
    for kind in ("jaccard", "cosine"):
        other = F.col(f"max_{kind}_doc")
        marked = crossing.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias(f"{kind}_crosses"))
        df = df.join(marked, (F.least("document_id", other) == F.col("_a")) & (F.greatest("document_id", other) == F.col("_b")), "left").drop("_a", "_b")
    return df.fillna(False, [f"in_{m}{g}" for m in ("hash", "url") for g in ("", "_guarded")] + ["jaccard_crosses", "cosine_crosses"])


def clauses(p: Policy) -> list[Clause]:
    """The policy as conditions over prepared profiles."""
    found: list[Clause] = []

    def add(signal: str, band: str | None, base: Column, guarded: Column | None = None) -> None:
        if band == "auto" and guarded is not None and p.cross_connector_review_only:
            found.append(Clause(signal, "auto", guarded, base))
            band, guarded = "review", None
        if band in ("auto", "review"):
            found.append(Clause(signal, band, base, base))

    add("exact_duplicate", p.exact_duplicate, F.col("in_hash"), F.col("in_hash_guarded"))
    add("url_variant", p.url_variant, F.col("in_url"), F.col("in_url_guarded"))
    add("asset", p.asset, F.col("url_class").isin("image", "media", "archive") & (F.coalesce("chunk_count", F.lit(0)) <= 1))
    add("stub", p.stub, F.col("chunk_count") == 0)
    for signal, kind, auto, review in (("near_duplicate", "jaccard", p.near_auto, p.near_review), ("semantic", "cosine", p.semantic_auto, p.semantic_review)):
        if auto is not None:
            base = F.col(f"max_{kind}") >= auto
            add(signal, "auto", base, base & ~F.col(f"{kind}_crosses"))
        if review is not None:
            add(signal, "review", F.col(f"max_{kind}") >= review)
    for band, least in (("review", p.quality_review_failures), ("auto", p.quality_auto_failures)):
        if least is not None:
            add("quality", band, (F.col("quality_fail_count") >= least) & (F.col("quality_families") >= p.quality_families))
    if p.off_topic_percentile is not None:
        add("off_topic", "review", F.col("centroid_pct") <= p.off_topic_percentile)
    return found


def _any(tests: list[Column]) -> Column:
    """OR that is false, never null, where nothing was measured."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False)) if tests else F.lit(False)


def band(p: Policy, name: str) -> Column:
    """Rows that reach a band; whatever reaches auto reaches review too, unguarded."""
    return _any([c.test for c in clauses(p) if c.band == "auto"] if name == "auto" else [c.base for c in clauses(p)])


def eligible(profiles: DataFrame, candidates: DataFrame, exclusions: DataFrame, documents: DataFrame, exempt: tuple[int, ...] = ()) -> DataFrame:
    """Profiles of documents that exist, are not excluded and have no open lifecycle row."""
    open_rows = candidates.filter(F.col("state").isin("candidate", "staged", "deleting")).select("document_id")
    df = profiles.join(open_rows, "document_id", "left_anti").join(exclusions.select("document_id"), "document_id", "left_anti")
    df = df.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return df.filter(~F.coalesce(F.col("connector_id").isin(*exempt), F.lit(False))) if exempt else df


def simulate(all_profiles: DataFrame, prepared: DataFrame, p: Policy) -> DataFrame:
    """(profiled, auto, review, untouched) of a policy over eligible profiles, in one pass."""
    auto, review = band(p, "auto"), band(p, "review")
    hit = prepared.agg(F.count_if(auto).alias("auto"), F.count_if(review & ~auto).alias("review"))
    total = all_profiles.agg(F.count("*").alias("profiled"))
    return total.join(F.broadcast(hit), how="left").withColumn("untouched", F.col("profiled") - F.col("auto") - F.col("review"))  # one row each


def by_signal(prepared: DataFrame, p: Policy) -> DataFrame:
    """Documents that each signal's clause hits, by band; clauses that hit none are left out."""
    own = clauses(p)
    counts = prepared.agg(*[F.count_if(F.coalesce(c.test, F.lit(False))).alias(f"c{i}") for i, c in enumerate(own)])
    rows = F.array(*[F.struct(F.lit(c.signal).alias("signal"), F.lit(c.band).alias("band"), F.col(f"c{i}").alias("n")) for i, c in enumerate(own)])
    return counts.select(F.explode(rows).alias("r")).select("r.*").filter("n > 0").orderBy(F.col("n").desc(), "signal", "band")


def by_connector(prepared: DataFrame, p: Policy, limit: int = 50) -> DataFrame:
    auto, review = band(p, "auto"), band(p, "review")
    rows = prepared.filter(review).groupBy("connector_id").agg(F.count_if(auto).alias("auto"), F.count_if(~auto).alias("review"), F.count("*").alias("total"))
    return rows.orderBy(F.col("total").desc(), F.col("connector_id").asc_nulls_last()).limit(limit)


def members(prepared: DataFrame, p: Policy, name: str, after: str = "", limit: int | None = None) -> DataFrame:
    """Documents of a band (review: without those of auto), by id."""
    test = band(p, "auto") if name == "auto" else band(p, "review") & ~band(p, "auto")
    rows = prepared.filter(test & (F.col("document_id") > after)).select("document_id").orderBy("document_id")
    return rows if limit is None else rows.limit(limit)


def signals_per_document(prepared: DataFrame, p: Policy) -> DataFrame:
    """(document_id, signals): every signal that hits, with its strongest band."""
    own = clauses(p)
    hit = {s: F.when(_any([c.test for c in own if (c.signal, c.band) == (s, "auto")]), F.lit(f"{s}:auto")).when(
        _any([c.base for c in own if c.signal == s]), F.lit(f"{s}:review")) for s in SIGNALS}
    rows = prepared.select("document_id", F.array_compact(F.array(*hit.values())).alias("signals"))
    return rows.filter(F.size("signals") > 0)


#: Confidence of a candidate that a policy's band makes.
BAND_CONFIDENCE = {"auto": 0.95, "review": 0.7}


def commit(prepared: DataFrame, p: Policy, name: str, confirm_count: int, tier: str | None = None) -> DataFrame:
    """(document_id, reasons) of a band's documents, for ``lifecycle.upsert``: one reason that names the signals and their bands.

    Candidates are all that a policy makes; staging and deletion have checks of their own.
    The band must hold as many documents as were confirmed, else nothing is made.
    """
    from .detect import reason
    from .selection import confirmed

    if name not in BAND_CONFIDENCE:
        raise ValueError(f"unknown band {name!r}; expected auto or review")
    rows = confirmed(members(prepared, p, name), confirm_count).join(signals_per_document(prepared, p), "document_id")
    said = F.array_join(F.transform("signals", lambda s: F.regexp_replace(s, "^(.*):(.*)$", r"$1 ($2)")), ", ")
    evidence = F.to_json(F.struct(F.lit(name).alias("band"), F.lit(tier).alias("tier"), F.transform("signals", lambda s: F.substring_index(s, ":", 1)).alias("signals")))
    own = reason("policy", f"policy_{name}", F.concat(F.lit(f"matched the {name} policy on: "), said), BAND_CONFIDENCE[name], evidence)
    return rows.select("document_id", F.array(own).alias("reasons"))


def caveats(profiles: DataFrame, p: Policy) -> DataFrame:
    """What a simulation cannot see: (caveat, documents)."""
    counts = profiles.agg(F.count_if(F.col("quality_fail_count").isNull()).alias("no_quality"), F.count_if(F.col("max_jaccard").isNull()).alias("no_jaccard"), F.count_if(F.col("max_cosine").isNull()).alias("no_cosine"), F.count("*").alias("all"))
    rows = [("quality was not measured", F.col("no_quality"))]
    if p.near_auto is not None or p.near_review is not None:
        rows.append(("no near-duplicate pair is on record", F.col("no_jaccard")))
    if p.semantic_auto is not None or p.semantic_review is not None:
        rows.append(("no embedding neighbour is on record", F.col("no_cosine")))
    if p.quality_auto_failures is not None:
        rows.append(("quality acts without review", F.col("all")))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("caveat"), n.alias("documents")) for t, n in rows])).alias("r")).select("r.*").filter("documents > 0")


def merge_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of measurements: what is new replaces, what was not measured stays, maxima only grow."""
    columns = [c for c in old.columns if c != "document_id"]
    both = old.alias("o").join(new.alias("n"), "document_id", "full_outer")

    def merged(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in ("max_jaccard", "max_cosine"):
            return F.greatest(o, n)
        if c in ("max_jaccard_doc", "max_cosine_doc"):
            m = c.removesuffix("_doc")
            return F.when(F.coalesce(F.col(f"n.{m}") >= F.col(f"o.{m}"), F.col(f"o.{m}").isNull()), F.coalesce(n, o)).otherwise(o)
        if c in ("quality_fail_count", "quality_families"):
            return F.when(F.col("n.quality_gates").isNotNull(), n).otherwise(o)
        return F.coalesce(n, o)

    return both.select("document_id", *[merged(c).alias(c) for c in columns])
