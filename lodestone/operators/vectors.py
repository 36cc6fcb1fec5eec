"""Vectors: cosine duplicates, centroids, calibration, half-precision packing."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import cosine

#: Vectors a side of one comparison block.
BLOCK = 2048


def _unit(v: Column) -> Column:
    return v.cast("array<double>")


def cosine_pairs(vectors: DataFrame, least: float, id_col: str = "id", vector_col: str = "vector", block: int = BLOCK) -> DataFrame:
    """(a, b, cosine), a < b, of all pairs that reach ``least``; exact.

    Vectors are dealt into blocks, and every pair of blocks is one group of bounded
    size that multiplies two matrices; only pairs that reach the threshold come out.
    """
    rows = vectors.select(F.col(id_col).alias("id"), _unit(F.col(vector_col)).alias("v")).filter("v is not null and size(v) > 0")
    n_blocks = max(1, -(-rows.count() // block))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda o: F.struct(F.least(o, "part").alias("low"), F.greatest(o, "part").alias("high")))
    cells = rows.withColumn("cell", F.explode(others)).select("cell.low", "cell.high", "part", "id", "v")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        ids, part = rows["id"].to_numpy(), rows["part"].to_numpy()
        m = np.stack(rows["v"].to_numpy())
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        left, right = np.nonzero(part == low)[0], np.nonzero(part == high)[0]
        out = []
        for at in range(0, len(left), 512):
            own = left[at : at + 512]
            i, j = np.nonzero(m[own] @ m[right].T >= least - 1e-9)
            a, b = ids[own[i]], ids[right[j]]
            keep = a < b if low == high else a != b
            score = np.einsum("ij,ij->i", m[own[i[keep]]], m[right[j[keep]]])
            out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cosine": score}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "cosine": []})

    kind = rows.schema["id"].dataType.simpleString()
    found = cells.groupBy("low", "high").applyInPandas(compare, f"a {kind}, b {kind}, cosine double")
    return found.filter(F.col("cosine") >= least)


def centroids(vectors: DataFrame, group: str, vector_col: str = "vector") -> DataFrame:
    """(group, centroid): the mean vector, by one aggregate a component."""
    parts = vectors.select(group, F.posexplode(_unit(F.col(vector_col))).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select(group, F.col("s.x").alias("centroid"))


def centroid_similarity(vectors: DataFrame, group: str, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, group, centroid_similarity, centroid_pct): similarity to the group's mean and its percentile there."""
    near = vectors.join(centroids(vectors, group, vector_col), group).select(id_col, group, cosine(F.col(vector_col), F.col("centroid")).alias("centroid_similarity"))
    return near.withColumn("centroid_pct", F.percent_rank().over(Window.partitionBy(group).orderBy("centroid_similarity")) * 100)


def calibrate(pairs: DataFrame, threshold: float, column: str = "cosine") -> DataFrame:
    """(n, mean, sigma, z): how far a threshold lies from the background's mean."""
    return pairs.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev(column).alias("sigma")).withColumn(
        "z", F.try_divide(F.lit(threshold) - F.col("mean"), F.col("sigma")))


@F.pandas_udf(T.StringType())
def f16_pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Float arrays to base64 of little-endian half floats, round to nearest even, saturating."""
    for vectors in batches:
        top = float(np.finfo(np.float16).max)
        yield pd.Series([None if v is None else base64.b64encode(np.clip(np.asarray(v, np.float32), -top, top).astype("<f2").tobytes()).decode() for v in vectors])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def f16_unpack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else np.frombuffer(base64.b64decode(t), "<f2").astype(np.float32) for t in texts])
