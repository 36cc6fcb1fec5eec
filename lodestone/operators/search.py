"""Content search: BM25 over fields, vectors, hybrid scores, collapse, snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BOOSTS = {"title": 3.0, "semantic_identifier": 3.0, "blurb": 2.0, "content": 1.0}
TEXT_WEIGHT, VECTOR_WEIGHT, NEIGHBOURS = 0.4, 0.6, 50
TRACKED = 10_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def bm25(chunks: DataFrame, query: str, field: str, keys: tuple[str, ...] = ("document_id", "chunk_index"), k1: float = K1, b: float = B) -> DataFrame:
    """(keys, score) of the chunks that hold a query term in the field.

    Term counts are taken inside each row; only the query's document frequencies and
    the mean length, one row in all, are broadcast.
    """
    terms = sorted({t for t in re.split(r"[\W_]+", query.lower()) if t})
    same = lambda t: lambda x: x == t
    counted = chunks.select(*keys, tokens(F.col(field)).alias("_t"))
    counted = counted.select(*keys, F.size("_t").alias("_len"), *[F.size(F.filter("_t", same(t))).alias(f"_tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").cast("double").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        tf = F.col(f"_tf{i}").cast("double")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"_tf{i}") > 0)
    return counted.filter(hit).join(F.broadcast(stats), how="cross").select(*keys, score.alias("score"))  # one row


def keyword(chunks: DataFrame, query: str, fields: dict[str, float] | None = None, keys: tuple[str, ...] = ("document_id", "chunk_index")) -> DataFrame:
    """Best field of each chunk: the greatest boosted BM25 score."""
    fields = fields or {f: w for f, w in BOOSTS.items() if f in chunks.columns}
    found = None
    for f, w in fields.items():
        own = bm25(chunks, query, f, keys).withColumn("score", F.col("score") * w)
        found = own if found is None else found.union(own)
    return found.groupBy(*keys).agg(F.max("score").alias("score"))


def cosine(x: Column, y: Column) -> Column:
    dot = F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    return F.try_divide(dot, norm(x) * norm(y))


def semantic(chunks: DataFrame, vector: list[float], k: int = NEIGHBOURS, field: str = "content_vector", keys: tuple[str, ...] = ("document_id", "chunk_index")) -> DataFrame:
    """The k nearest chunks by cosine, scored (1 + cosine) / 2; a bounded top-k, no global sort."""
    v = F.array(*[F.lit(float(x)) for x in vector])
    near = chunks.filter(F.size(field) == len(vector)).select(*keys, ((1 + cosine(F.col(field), v)) / 2).alias("score")).filter("score is not null")
    return near.orderBy(F.col("score").desc(), *keys).limit(k)


def hybrid(text: DataFrame, vectors: DataFrame, keys: tuple[str, ...] = ("document_id", "chunk_index")) -> DataFrame:
    """Weighted sum of both scores; one of them is enough."""
    both = text.select(*keys, (F.col("score") * TEXT_WEIGHT).alias("score")).union(vectors.select(*keys, (F.col("score") * VECTOR_WEIGHT).alias("score")))
    return both.groupBy(*keys).agg(F.sum("score").alias("score"))


def collapse(scored: DataFrame, size: int = 20, offset: int = 0) -> DataFrame:
    """One best chunk a document, best documents first."""
    best = F.max(F.struct("score", (-F.col("chunk_index")).alias("c"))).alias("b")
    rows = scored.groupBy("document_id").agg(best).select("document_id", F.col("b.score").alias("score"), (-F.col("b.c")).alias("chunk_index"))
    return rows.orderBy(F.col("score").desc(), "document_id").offset(offset).limit(size)


def tracked_total(scored: DataFrame) -> DataFrame:
    """(total, exact): hits counted up to 10,000."""
    return scored.agg(F.countDistinct("document_id").alias("n")).select(F.least("n", F.lit(TRACKED)).alias("total"), (F.col("n") <= TRACKED).alias("exact"))


def snippet(content: Column, query: str, blurb: Column, width: int = 160, fragments: int = 2) -> Column:
    """Up to two stretches around query terms, the terms in <em>; else the blurb."""
    terms = [re.escape(t) for t in sorted({t for t in re.split(r"[\W_]+", query.lower()) if t})]
    if not terms:
        return blurb
    word = rf"(?i)\b({'|'.join(terms)})\b"
    half = width // 2
    found = F.regexp_extract_all(content, F.lit(rf"(?is).{{0,{half}}}\b(?:{'|'.join(terms)})\b.{{0,{half}}}"), F.lit(0))
    marked = F.transform(F.slice(found, 1, fragments), lambda x: F.regexp_replace(x, word, "<em>$1</em>"))
    return F.when(F.size(found) > 0, F.array_join(marked, " … ")).otherwise(blurb)


def degraded(has_vectors: bool, has_embedder: bool, dims_match: bool) -> list[str]:
    """Why a search fell back to text."""
    return [name for name, fine in (("no_knn_field", has_vectors), ("no_embedder", has_embedder), ("embedding_dim_mismatch", dims_match)) if not fine]


def top_terms(chunks: DataFrame, field: str, n: int = 20) -> DataFrame:
    """Most frequent terms by number of rows that hold them."""
    rows = chunks.select(F.explode(F.array_distinct(tokens(F.col(field)))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "term").limit(n)


def rank_per_document(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy(F.col("score").desc(), "chunk_index")
    return scored.withColumn("rank", F.row_number().over(w))
