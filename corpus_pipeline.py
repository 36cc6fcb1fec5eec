"""The corpus pipeline: each stage is one of the operators, applied to what the one before kept.

``run`` writes every stage's rows to the shared folder and reads them back, so a
lost executor repeats one stage's tasks and no more.  Rows are told apart by a
number that is written with them, so repeated ids and repeated rows are safe.  Inside
a stage columns are named by their place, so extra columns of any name pass unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, exact_dedup, mixing, packing, quality, simhash

ROW = "row"


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by their place, which clash with nothing, and the place of each name."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), {c: f"c{i}" for i, c in enumerate(docs.columns)}


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``_plain`` with a row number that is fixed by writing it."""
    rows, at = _plain(docs)
    return common.keep(rows.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows"), at


def _without(docs: DataFrame, rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """``rows`` under the names of ``docs``, without those whose number is in ``dropped``."""
    return rows.join(dropped.select(ROW), ROW, "left_anti").drop(ROW).toDF(*docs.columns)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The table ``labels``, if there is one: it is not required."""
    try:
        return spark.read.parquet(f"{sf_dir}/labels.parquet") if sf_dir else None
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts and that are not toxic, by the markers that ``labels`` teach or by words."""
    rows, at = _plain(docs)
    labels = _labels(spark, sf_dir)
    markers = {} if labels is None else quality.fit_toxic(rows, labels, at["doc_id"], at["text"])
    found = quality.classify(rows, at["text"], markers=markers)
    clean = (F.col("toxicity") < quality.TOXIC_LEAST) & ~quality.toxic(F.col(at["text"]))
    return found.filter(F.col("keep") & clean).select(*rows.columns).toDF(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    rows, at = _numbered(docs)
    return _without(docs, rows, exact_dedup.dedup(rows, at["doc_id"], at["text"], row_col=ROW).filter("not kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    rows, at = _numbered(docs)
    return _without(docs, rows, simhash.near_groups(rows, at["doc_id"], at["text"], row_col=ROW).filter("row <> first"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    rows, at = _numbered(docs)
    taken = mixing.mix(rows, at["doc_id"], at["text"], at["source"], row_col=ROW).filter("copies > 0").select(ROW, "copies")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.join(taken, ROW).withColumn("time", times).select(*at.values()).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in fixed windows."""
    rows, at = _plain(docs)
    return packing.pack(rows, public_tokenizers.path(packing.TOKENIZER), at["doc_id"], at["text"]).drop("row")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: Training, hashing and tokenising have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
