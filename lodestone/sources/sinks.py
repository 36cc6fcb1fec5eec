"""Row formats and writes that may be repeated."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("table", "json", "yaml", "csv", "ndjson")


def lines(df: DataFrame, kind: str, everything: bool = False) -> Iterator[str]:
    """Rows as text, streamed partition by partition; ``yaml`` cannot be streamed whole."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; one of {', '.join(FORMATS)}")
    if kind == "yaml" and everything:
        raise ValueError("yaml holds all rows at once; use ndjson")
    if kind in ("csv", "table"):
        mark = "," if kind == "csv" else "\t"
        yield _joined(df.columns, mark)
        for row in df.toLocalIterator():
            yield _joined(row, mark)
    elif kind == "ndjson":
        yield from (r["j"] for r in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator())
    else:
        rows = [json.loads(r["j"]) for r in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
        if kind == "json":
            yield json.dumps(rows, ensure_ascii=False)
        else:
            import yaml

            yield yaml.safe_dump(rows, allow_unicode=True, sort_keys=False)


def _joined(row, mark: str) -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=mark, lineterminator="").writerow(["" if v is None else v for v in row])
    return out.getvalue()


def event_stream(df: DataFrame, limit: int | None = None) -> Iterator[str]:
    """Server-sent events: one a row, then ``done`` with the count, or ``error``."""
    n = 0
    try:
        for row in lines(df if limit is None else df.limit(limit), "ndjson"):
            n += 1
            yield f"event: row\ndata: {row}\n\n"
    except Exception as e:  # noqa: BLE001 - the client must hear of it
        yield f"event: error\ndata: {json.dumps({'message': str(e)})}\n\n"
        return
    yield f'event: done\ndata: {{"total_matched": {n}}}\n\n'


def append_audit(df: DataFrame, path: str) -> bool:
    """Append audit rows; a failure is reported, never raised, so that it cannot undo what it records."""
    try:
        df.write.mode("append").parquet(path)
    except Exception:  # noqa: BLE001
        return False
    return True


def read_samples(spark, path: str) -> DataFrame:
    """A JSON array of {id, text}."""
    return spark.read.schema("id string, text string").json(path, multiLine=True)
