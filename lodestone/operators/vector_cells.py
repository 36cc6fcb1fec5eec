"""Exact nearest vectors by cosine from coarse cells: a cell is skipped once its bound cannot reach the k-th best.

Unit vectors are dealt to the nearest of a bounded number of centres.  A cell knows its
centre and its radius, so by the triangle inequality no member is nearer to a query than the
distance to the centre less the radius.  Cells are read nearest bound first, a few at a time, each
from a partition of its own, until the next bound is beyond the k-th best score.  The result is
that of a full scan; how much was read is told.

Vectors that are null, hold null or non-finite components or have no length take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import cosine

#: Centres at most: what the driver and each task hold is this many vectors.
CELLS = 1024
#: Slack for rounding in distances.
SLACK = 1e-6


def build(vectors: DataFrame, path: str, cells: int = CELLS, id_col: str = "id", vector_col: str = "vector") -> None:
    """Write the vectors of one dimension by cell, and the cells (cell, centre, radius, n)."""
    v = F.col("vector")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(usable)
    chosen = [r["vector"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(cells).collect()]
    if not chosen:
        rows.sparkSession.createDataFrame([], "cell int, radius double, n bigint, centre array<double>").write.parquet(f"{path}/cells")
        return
    centres = np.array(chosen)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    kind = rows.schema["id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = np.array(b["vector"].to_pylist())
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            far = np.sqrt(np.maximum(0, 2 - 2 * (m @ centres.T)))
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b["id"], b["vector"], pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(m)), cell])], ["id", "vector", "cell", "far"])

    dealt = rows.mapInArrow(each, f"id {kind}, vector array<double>, cell int, far double")
    dealt.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/members")
    written = rows.sparkSession.read.schema(f"id {kind}, vector array<double>, far double, cell int").parquet(f"{path}/members")
    sizes = written.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    middle = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sizes.join(middle, "cell").coalesce(1).write.parquet(f"{path}/cells")


def nearest(spark: SparkSession, path: str, query: list[float], k: int = 50) -> tuple[DataFrame, dict[str, int]]:
    """((id, score) of the k nearest, best first, ties to the lesser id; cells and vectors there are and were read)."""
    cells = spark.read.parquet(f"{path}/cells").collect()  # at most as many as centres
    report = {"cells": len(cells), "cells_read": 0, "vectors": sum(c["n"] for c in cells), "vectors_read": 0}
    q = np.array(query, float)
    q /= np.linalg.norm(q)
    bound = [max(0.0, float(np.linalg.norm(np.array(c["centre"]) - q)) - c["radius"] - SLACK) for c in cells]
    order = sorted(range(len(cells)), key=lambda i: (bound[i], cells[i]["cell"]))
    v = F.array(*[F.lit(float(x)) for x in query])
    members = spark.read.parquet(f"{path}/members") if cells else spark.createDataFrame([], "id long, vector array<double>, far double, cell int")
    best: list[tuple[float, object]] = []
    at, step = 0, 1
    while at < len(order):
        if len(best) == k and (1 + 1 - bound[order[at]] ** 2 / 2) / 2 < best[-1][0]:
            break
        own = order[at : at + step]
        at, step = at + len(own), step * 2
        found = members.filter(F.col("cell").isin(*[cells[i]["cell"] for i in own])).select("id", ((1 + cosine(F.col("vector"), v)) / 2).alias("score"))
        rows = found.orderBy(F.col("score").desc(), "id").limit(k).collect()  # k rows at most
        best = sorted([*best, *((r["score"], r["id"]) for r in rows)], key=lambda x: (-x[0], x[1]))[:k]
        report["cells_read"], report["vectors_read"] = at, report["vectors_read"] + sum(cells[i]["n"] for i in own)
    kind = members.schema["id"].dataType.simpleString()
    return spark.createDataFrame([(i, s) for s, i in best], f"id {kind}, score double"), report
