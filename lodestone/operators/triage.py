"""Triage of candidates and measurements: funnels, histograms, clusters, acceptance sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARE_COLUMNS = ("max_jaccard", "max_cosine", "centroid_similarity", "confidence")
DESCRIPTIONS = {
    "exact_duplicate_of": ("Exact copies", "The text equals that of a document that stays."),
    "near_duplicate_of": ("Near copies", "The text nearly equals that of a document that stays."),
    "url_variant_of": ("URL variants", "Another spelling of a page that stays."),
    "asset_url": ("Assets", "Images, media and archives without text of their own."),
    "chunkless_stub": ("Stubs", "Indexed without any content for a week or more."),
    "thin_content": ("Thin pages", "Only a few words."),
    "low_quality_text": ("Low quality", "Fails several text heuristics of different families."),
    "lang_not_allowed": ("Other languages", "Written in a language that is not wanted."),
    "stale_content": ("Stale", "Not updated for two years, and crawled again."),
}


def described(code: Column) -> tuple[Column, Column]:
    """(title, sentence) of a reason code, ``Other`` for codes without one."""
    titles = F.create_map(*[F.lit(x) for k, (t, _) in DESCRIPTIONS.items() for x in (k, t)])
    sentences = F.create_map(*[F.lit(x) for k, (_, s) in DESCRIPTIONS.items() for x in (k, s)])
    return F.coalesce(F.try_element_at(titles, code), F.lit("Other")), F.coalesce(F.try_element_at(sentences, code), F.lit("Other reasons."))


def bundles(candidates: DataFrame) -> DataFrame:
    """Documents by reason code: count, chunks, mean confidence, at risk of being crawled again."""
    rows = candidates.select("document_id", "chunk_count", "recrawl_risk", F.explode("reasons").alias("r"))
    rows = rows.groupBy("document_id", "r.code", "r.detector").agg(F.first("chunk_count").alias("chunks"), F.first("recrawl_risk").alias("risk"), F.max("r.confidence").alias("sure"))
    title, _ = described(F.col("code"))
    return rows.groupBy("code", "detector").agg(F.count("*").alias("documents"), F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks"), F.avg(F.col("sure").cast("double")).alias("mean_confidence"),
                                                F.count_if("risk").alias("at_risk")).withColumn("title", title).orderBy(F.col("documents").desc(), "code", "detector")


def connector_funnel(candidates: DataFrame, limit: int = 50) -> DataFrame:
    return candidates.groupBy("connector_id").agg(F.count("*").alias("documents"), F.sum(F.coalesce("chunk_count", F.lit(0))).alias("chunks")).orderBy(
        F.col("documents").desc(), F.col("connector_id").asc_nulls_last()).limit(limit)


def histogram(df: DataFrame, column: str, buckets: int = 20) -> DataFrame:
    """(bucket, low, high, n) of the measured rows; values at or past an edge fall in the edge bucket.

    Shares run over 0-1 and percentiles over 0-100, others over what was measured.
    """
    n = max(2, min(buckets, 100))
    value = F.col(column).cast("double")
    rows = df.filter(value.isNotNull()).select(value.alias("v"))
    if column in SHARE_COLUMNS:
        rows = rows.withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0)})
    elif column.endswith("_pct"):
        rows = rows.withColumns({"lo": F.lit(0.0), "hi": F.lit(100.0)})
    else:
        rows = rows.join(F.broadcast(rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))), how="cross")  # one row
    rows = rows.filter("hi > lo")
    at = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n)
    bucket = F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).cast("int") + 1
    counted = rows.groupBy(bucket.alias("bucket"), "lo", "hi").agg(F.count("*").alias("n"))
    step = (F.col("hi") - F.col("lo")) / n
    return counted.select("bucket", (F.col("lo") + step * (F.col("bucket") - 1)).alias("low"), (F.col("lo") + step * F.col("bucket")).alias("high"), "n").orderBy("bucket")


def tail_count(hist: DataFrame, threshold: float) -> DataFrame:
    """Rows in buckets whose lower edge reaches the threshold."""
    return hist.agg(F.coalesce(F.sum(F.when(F.col("low") >= threshold, F.col("n"))), F.lit(0)).alias("n"))


def clusters(groups: DataFrame, method: str = "hash", after: str = "", limit: int = 20) -> DataFrame:
    """Members of the next groups by key, the keeper first."""
    rows = groups.filter((F.col("method") == method) & (F.col("group_key") > after))
    keys = rows.select("group_key").distinct().orderBy("group_key").limit(limit)
    return rows.join(keys, "group_key", "left_semi").orderBy("group_key", F.col("is_keeper").desc(), "document_id")


def seeded_sample(df: DataFrame, n: int, seed: int = 0, key: str = "document_id") -> DataFrame:
    """n rows drawn by a seeded hash of the key; the same ones on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), key).limit(max(1, min(n, 200)))


def acceptance_bound(n: Column) -> Column:
    """The error rate that n flawless draws leave possible at 95 %."""
    return F.when(n > 0, 1 - F.pow(F.lit(1 - 0.95), 1 / n)).otherwise(F.lit(1.0))


def acceptance_plan(population: DataFrame, n: int) -> DataFrame:
    """(population, draws, bound) for a sample of n."""
    draws = F.least(F.col("population"), F.lit(max(1, min(n, 200))))
    return population.agg(F.count("*").alias("population")).withColumn("draws", draws).withColumn("bound", acceptance_bound(F.col("draws")))


def gate_report(evaluated: DataFrame) -> DataFrame:
    """(gate, n, share, example): how often each gate trips, with the first id; ``gate_examples`` has more."""
    rows = evaluated.select("id", F.explode(F.concat("gates", F.array(F.lit("")))).alias("gate"))  # "" once a row: texts are measured once
    counted = rows.groupBy("gate").agg(F.count("*").alias("n"), F.min("id").alias("example"))
    total = F.max(F.when(F.col("gate") == "", F.col("n"))).over(Window.partitionBy(F.lit(1)))  # a row a gate
    shares = counted.withColumn("total", total).filter("gate <> ''")
    return shares.select("gate", "n", (F.col("n") / F.col("total")).alias("share"), "example").orderBy(F.col("n").desc(), "gate")


def gate_examples(evaluated: DataFrame, most: int = 3) -> DataFrame:
    """(gate, examples): the first ``most`` ids that trip each gate.

    Each part of the ids names its own first ones, so a gate that most documents trip is no task's load.
    """
    rows = evaluated.select("id", F.explode("gates").alias("gate")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("_n") <= most)
    own = first(first(rows, "gate", "part"), "gate")
    return own.groupBy("gate").agg(F.array_sort(F.collect_list("id")).alias("examples"))


def gate_sweep(measured: DataFrame, floors: tuple[int, ...] = (50, 75, 100, 150), least_families: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(stop_word_floor, min_families, flagged share) over a grid of thresholds, in one pass."""
    from lodestone.functions.textquality import Gates, failures, families

    cells, aggs = [], []
    for a in floors:
        gates = failures(Gates(stop_word_floor=a))
        for b in least_families:
            aggs.append(F.avg(((F.size(gates) >= 3) & (F.size(families(gates)) >= b)).cast("double")).alias(f"c{len(aggs)}"))
            cells.append((a, b))
    rows = F.array(*[F.struct(F.lit(a).alias("stop_word_floor"), F.lit(b).alias("min_families"), F.col(f"c{i}").alias("flagged")) for i, (a, b) in enumerate(cells)])
    return measured.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*").orderBy("stop_word_floor", "min_families")
