"""Exact top-k search: columnar branch-and-bound over blocks of vectors.

Candidates are dealt into blocks held in vertical layout, one row of the matrix a
dimension.  For a block of queries, inner products are accumulated dimension block
by dimension block.  After each, the mass that a vector has in the remaining
dimensions bounds what is still to come (Cauchy-Schwarz), so candidates that
cannot reach a query's k-th best score so far are dropped, and the survivors are
compacted once few are left.  Scores are exact integers.

Queries and candidates meet in a grid of cells of bounded size: neither side is
broadcast, and each cell hands on k rows a query.

Edge cases: a vector that is null or has a null or non-finite component takes no part;
vectors of unlike length are scored over a query's own length class only, empty ones
among themselves (score zero).  Components are exact at any size; a score that a long
cannot hold counts as the nearest long.  Equal scores go to the smaller vec_id.  Rows
that repeat a vec_id are queries and candidates of their own: a query row leaves out
itself only.  Rows without an id take no part; extra columns are ignored, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 5
SCALE = 256
QUERY_EVERY = 50
#: Vectors that a cell of the grid takes from either side; candidates' cells grow with
#: the table so that the grid stays near CELLS rows, up to MOST_VALUES components.
QUERY_CELL = 2048
CANDIDATE_CELL = 8192
MOST_VALUES = 1 << 23
CELLS = 512
#: Vectors in a block of queries, which are pruned together, and of candidates inside a cell.
QUERY_BLOCK = 32
CANDIDATE_BLOCK = 2048
#: Dimensions accumulated between two prunings.
DIM_BLOCK = 16
#: Integers up to here are exact as doubles.
EXACT_FLOAT = 2.0**53
#: Sums up to here are exact as 64-bit integers.
EXACT_LONG = 2.0**62
LEAST, MOST = -(2**63) + 2, 2**63 - 1


def quantise(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v): floor(scale * x) of every component, for the vectors that take part.

    ``v`` holds whole doubles, as longs do not hold all of them.
    """
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        "row", "vec_id", F.transform("v", lambda x: F.when(F.abs(x) < F.lit(2.0**53 / scale), F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("v"))


def _whole(m: np.ndarray) -> np.ndarray:
    """``m`` as Python integers."""
    return np.array([int(x) for x in m.ravel()], object).reshape(m.shape)


def search_block(queries: np.ndarray, query_rows: np.ndarray, columns: np.ndarray, rows: np.ndarray, ids: np.ndarray,
                 best: np.ndarray, best_ids: np.ndarray, k: int, alive_shares: list[float] | None = None) -> None:
    """Fold one candidate block (dims x n) into the k best of every query, in place.

    ``best`` and ``best_ids`` are (queries x k), ordered, with unused places at the
    least score and largest id.  ``alive_shares`` takes the share of candidates left
    after each block of dimensions.
    """
    dims, n = columns.shape
    size = float(np.abs(queries).max(initial=0)) * float(np.abs(columns).max(initial=0)) * dims
    small = size < EXACT_FLOAT
    if small:
        q, c, kind = queries.astype(np.float64), columns.astype(np.float64), np.float64
    elif size < EXACT_LONG:
        q, c, kind = queries.astype(np.int64), columns.astype(np.int64), np.int64
    else:
        q, c, kind = _whole(queries), _whole(columns), object
    cuts = list(range(0, dims, DIM_BLOCK)) + [dims]
    if small:  # what is left of each vector's length after each cut, rounded up
        left = lambda m: np.sqrt(np.cumsum(np.square(m)[::-1], axis=0)[::-1]) * (1 + 1e-12)
        q_left, c_left = left(q.T), left(c)
    score = np.zeros((len(q), n), kind)
    alive = np.arange(n)
    for a, b in zip(cuts, cuts[1:], strict=False):
        score += q[:, a:b] @ c[a:b, :] if len(alive) == n else q[:, a:b] @ c[a:b, alive]
        if small and b < dims:
            bound = score + q_left[b][:, None] * c_left[b][alive][None, :]
            could = (bound >= best[:, -1:].astype(np.float64) - 1e-6 * np.abs(bound)).any(axis=0)
            if could.sum() <= 0.75 * len(alive):
                alive, score = alive[could], score[:, could]
            if alive_shares is not None:
                alive_shares.append(float(could.sum()) / max(1, n))
            if not len(alive):
                return
    if kind is object:
        score = np.clip(score, LEAST, MOST)
    own, own_rows = ids[alive], rows[alive]
    for i in range(len(q)):
        s = score[i].astype(np.int64)
        near = np.nonzero((s >= best[i, -1]) & (own_rows != query_rows[i]))[0]
        if len(near) > 4 * k:
            edge = np.partition(s[near], len(near) - k)[len(near) - k]
            near = near[s[near] >= edge]
        if len(near):
            all_s, all_i = np.concatenate([best[i], s[near]]), np.concatenate([best_ids[i], own[near]])
            order = np.lexsort((all_i, ~all_s))[:k]
            best[i], best_ids[i] = all_s[order], all_i[order]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, query_cell: int = QUERY_CELL, candidate_cell: int = CANDIDATE_CELL) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score) from two tables (row, vec_id, v) of vectors of whole numbers."""
    n_queries, (n, dims) = queries.count(), candidates.agg(F.count("*"), F.max(F.size("v"))).first()
    most = max(1, MOST_VALUES // max(1, dims or 1))
    columns = max(1, -(-n_queries // min(query_cell, most)))
    rows = max(1, -(-n // min(most, max(candidate_cell, n // CELLS))))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    q = queries.select("row", "vec_id", "v", F.size("v").alias("dims"), cell(columns).alias("q_cell"), spread(rows).alias("c_cell"))
    c = candidates.select("row", "vec_id", "v", F.size("v").alias("dims"), cell(rows).alias("c_cell"), spread(columns).alias("q_cell"))

    def each(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        ids, rows, all_q, all_rows = right["vec_id"].to_numpy(), right["row"].to_numpy(), left["vec_id"].to_numpy(), left["row"].to_numpy()
        columns = np.stack(right["v"].to_numpy(), axis=1)  # vertical: a row a dimension
        parts = []
        for at in range(0, len(left), QUERY_BLOCK):
            own, own_rows = all_q[at : at + QUERY_BLOCK], all_rows[at : at + QUERY_BLOCK]
            m = np.stack(left["v"].to_numpy()[at : at + QUERY_BLOCK])
            best = np.full((len(own), k), np.iinfo(np.int64).min + 1)
            best_ids = np.full((len(own), k), np.iinfo(np.int64).max)
            for c_at in range(0, len(ids), CANDIDATE_BLOCK):
                part = slice(c_at, c_at + CANDIDATE_BLOCK)
                search_block(m, own_rows, columns[:, part], rows[part], ids[part], best, best_ids, k)
            i, j = np.nonzero(best_ids != np.iinfo(np.int64).max)
            parts.append(pd.DataFrame({"query_row": own_rows[i], "query_id": own[i], "vec_id": best_ids[i, j], "score": best[i, j]}))
        return pd.concat(parts, ignore_index=True)

    keys = ["dims", "q_cell", "c_cell"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(each, "query_row long, query_id long, vec_id long, score long")
    by = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best scores of every query against all other vectors."""
    rows = common.keep(quantise(common.table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(rows.filter(F.col("vec_id") % QUERY_EVERY == 0), rows).drop("query_row")


OP1_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
