"""Scans that stop anywhere and go on: pages of documents by key, phase by phase, each committed with its cursor.

A page is a range of the key, so a filter on the key reaches the Parquet files.  What a page
finds, and the phase and page that come next, are one commit; a run that dies between them has
done neither, and the next run takes up the page.  Phases that need all documents at once
(groups, near duplicates) are one page.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.versions import Change, Tables

#: Keys that the driver sees for each page to choose the bounds.
SAMPLED = 64


@dataclass(frozen=True)
class Phase:
    """``work`` turns documents into (document_id, reason) rows; ``paged``: a page at a time, else all of them."""

    name: str
    work: Callable[[DataFrame], DataFrame]
    paged: bool = True


def bounds(documents: DataFrame, pages: int, key: str = "id") -> list[str]:
    """Keys that cut the documents into about equal pages; a sample of bounded size is enough, as bounds decide sizes only."""
    # The least hashes are a sample that does not depend on the files; ids that repeat count once.
    least = documents.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(SAMPLED * pages)
    keys = sorted(r[0] for r in least.collect())
    return sorted({keys[len(keys) * i // pages] for i in range(1, pages)}) if keys else []


def _page(key: str, cuts: list[str], page: int) -> Column:
    """Rows of a page: after one cut, up to the next; null keys are in the first page."""
    low = F.lit(True) if page == 0 else F.col(key) > cuts[page - 1]
    high = F.lit(True) if page == len(cuts) else F.col(key) <= cuts[page]
    return (low & high) | F.col(key).isNull() if page == 0 else low & high


def run(tables: Tables, scan: str, documents: DataFrame, phases: list[Phase], pages: int = 8, key: str = "id", most: int | None = None) -> bool:
    """Take the scan up where it stands and go on, for ``most`` pages at most; True once it is done.

    Findings are in the table ``scan`` as (document_id, phase, reason).
    """
    note = f"scan/{scan}"
    state = tables.state()
    at = state.notes.get(note)
    if at is None:
        at = {"phase": 0, "page": 0, "step": 0, "cuts": bounds(documents, pages, key)}
        none = tables.spark.createDataFrame([], "document_id string, phase string, reason string")
        tables.commit({scan: Change(none, ["document_id"])}, notes={note: at}, state=state)
    done = 0
    while at["phase"] < len(phases) and (most is None or done < most):
        phase, cuts = phases[at["phase"]], at["cuts"]
        rows = documents.filter(_page(key, cuts, at["page"])) if phase.paged else documents
        found = phase.work(rows).select("document_id", F.lit(phase.name).alias("phase"), F.col("reason").cast("string").alias("reason"))
        last = not phase.paged or at["page"] == len(cuts)
        then = {"phase": at["phase"] + last, "page": 0 if last else at["page"] + 1, "step": at["step"] + 1, "cuts": cuts}
        tables.commit({scan: Change(found, ["document_id"], append=True)}, (note, at["step"]), {note: then})
        at, done = then, done + 1
    return at["phase"] >= len(phases)
