"""Shared helpers: table readers, numbered text rows, and ``keep`` and ``release`` for intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import keep, keep_dealt, release
from lodestone.sources.spread import spread

__all__ = ["SPACE_RUN", "WORD", "keep", "keep_dealt", "release", "table", "text_rows"]

#: One run of the white space that every operator here folds or splits on.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: One word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_rows(df: DataFrame, id_col: str, text_col: str, *more: Column, row_col: str | None = None) -> DataFrame:
    """(row, doc_id, text, *more): one row each, null text as empty.

    ``row`` tells rows with the same id apart: the column ``row_col``, if rows are
    numbered already, else a new number, which callers fix with ``keep``.
    """
    return df.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *more,
    )
