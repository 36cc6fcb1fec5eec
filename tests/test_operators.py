import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import duplicates, lifecycle, telemetry
from lodestone.operators.listing import DocumentFilter, filter_documents, list_documents
from lodestone.plans import model
from lodestone.schemas import DOCUMENT, SchemaMismatch, probe
from lodestone.sources import sinks

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def test_every_sort_pages_without_gaps_or_repeats(spark):
    from lodestone.operators.cursor import SORTS, Cursor

    docs, links, cons = model.documents(spark, DIR), model.attribution(spark, DIR), model.connectors(spark, DIR)
    docs = docs.cache()
    total = docs.count()
    for sort in ("chunks_asc", "chunks_desc", "updated_desc", "id_asc"):
        key, seen, cursor = SORTS[sort][0], [], None
        while True:
            rows = list_documents(docs, links, cons, sort=sort, cursor=cursor, limit=90).collect()
            if not rows:
                break
            seen += [r["id"] for r in rows]
            last = rows[-1]
            value = None if key is None else last[key]
            cursor = Cursor(sort, str(value) if key == "sort_ts" else value, last["id"]).encode()
        assert len(seen) == total == len(set(seen)), sort


def test_filters_refuse_inverted_ranges_and_drop_unknown_counts(spark):
    with pytest.raises(ValueError):
        DocumentFilter(chunk_min=3, chunk_max=1)
    docs = model.documents(spark, DIR)
    assert filter_documents(docs, DocumentFilter(chunk_min=0)).filter("chunk_count is null").isEmpty()


def test_probe(spark):
    with pytest.raises(SchemaMismatch):
        probe(spark.range(1), DOCUMENT, "document")


def test_groups_with_unknown_connector_count_as_crossing(spark):
    df = spark.createDataFrame([("aaa", None, 1, "h", 1), ("b", None, 2, "h", None), ("c", None, 1, "x", 1)], "id string, link string, chunk_count int, content_hash string, connector_id int")
    rows = {r["document_id"]: r for r in duplicates.groups(df, "content_hash", "hash").collect()}
    assert set(rows) == {"aaa", "b"} and rows["b"]["is_keeper"] and rows["aaa"]["cross_connector"]


def test_of_rows_that_repeat_an_id_one_stays(spark):
    df = spark.createDataFrame([("a", None, "h", 1), ("a", None, "h", 1), ("a", None, "h", 1), ("bb", None, "h", 1), ("c", None, "x", 1)], "id string, link string, content_hash string, connector_id int")
    rows = sorted((r["document_id"], r["keeper_id"], r["is_keeper"], r["group_size"]) for r in duplicates.groups(df, "content_hash", "hash").collect())
    assert rows == [("a", "a", False, 4), ("a", "a", False, 4), ("a", "a", True, 4), ("bb", "a", False, 4)]


def test_lifecycle_round(spark):
    c = spark.createDataFrame([(1, "a", "candidate", None), (2, "b", "staged", None)], "candidate_id long, document_id string, state string, stage_expires_at timestamp")
    commands = spark.createDataFrame([(1, "stage"), (2, "stage")], "candidate_id long, command string")
    new, outcomes = lifecycle.transition(c, commands, model.NOW, 200)
    assert {r["candidate_id"]: r["outcome"] for r in outcomes.collect()} == {1: "done", 2: "conflict"}
    staged = {r["candidate_id"]: r for r in new.collect()}[1]
    assert staged["state"] == "staged" and str(staged["stage_expires_at"]).startswith("2024-04-30")


def test_parked_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x: first-pass already complete"), (2, None)], "id int, e string")
    assert [r["p"] for r in df.select(telemetry.parked(F.col("e")).alias("p")).collect()] == [True, False]
    assert list(sinks.lines(df.select("id"), "ndjson")) == ['{"id":1}', '{"id":2}'] and list(sinks.lines(df.select("id"), "csv")) == ["id", "1", "2"]
    events = list(sinks.event_stream(df.select("id")))
    assert events[-1].startswith("event: done") and '"total_matched": 2' in events[-1]
    assert sinks.append_audit(df, f"{tmp_path}/audit")


def test_near_pairs_of_copies_and_near_copies(spark):
    import random

    rng = random.Random(2)
    words = [f"word{i}" for i in range(500)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(10)]
    rows = [(f"d{i}", i, t) for i, t in enumerate(base)] + [(f"e{i}", 1, t) for i, t in enumerate(base)] + [(f"f{i}", 2, t + " tail") for i, t in enumerate(base)] + [("z", 1, "")]
    signed = duplicates.signatures(spark.createDataFrame(rows, "id string, connector_id int, text string"))
    pairs = {(r["a"], r["b"]): r["similarity"] for r in duplicates.near_pairs(signed).collect()}
    for i in range(10):
        assert pairs[(f"d{i}", f"e{i}")] == 1.0 and pairs[(f"d{i}", f"f{i}")] >= 0.9
    assert all(a[1:] == b[1:] for a, b in pairs)
    best = {r["document_id"]: r for r in duplicates.max_similarity(spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a string, b string, similarity double")).collect()}
    assert best["e3"]["max_jaccard_doc"] == "d3"


def test_near_pairs_of_a_large_bucket_are_all_compared(spark):
    """60 near copies, with parts of at most about 4 and with one part."""
    words = [f"word{i}" for i in range(300)]
    rows = [(f"d{i:02d}", 1, " ".join([*words, *[f"tail{i}x{j}" for j in range(12)]])) for i in range(60)]
    signed = duplicates.signatures(spark.createDataFrame(rows, "id string, connector_id int, text string")).cache()
    cut, whole = ({(r["a"], r["b"]): r["similarity"] for r in duplicates.near_pairs(signed, bucket=n).collect()} for n in (4, 200))
    assert cut == whole and len(whole) > 1000 and all(a < b for a, b in whole)


def test_entry_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).parent.parent
    shutil.copytree(repo / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'quality_funnel' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_stores(spark):
    from lodestone.operators import stores

    runs = spark.createDataFrame([(1, "pending", 0, "2024-01-01", None), (2, "running", 0, "2024-01-02", "x")], "scan_id int, state string, retries int, created_at string, checkpoint string")
    assert stores.next_run(runs).first()["scan_id"] == 2
    moved = {r["scan_id"]: r for r in stores.move_run(runs, 1, "running", "page 3").collect()}
    assert moved[1]["state"] == "running" and moved[1]["checkpoint"] == "page 3" and moved[2]["checkpoint"] == "x"


def test_streams_of_many_files_lose_no_late_rows(spark, tmp_path):
    """20 files with a day each, the latest day first."""
    import os
    import time
    from datetime import datetime, timedelta

    from lodestone.plans import streams

    where = tmp_path / "events.parquet"
    where.mkdir()
    for n in range(20):
        day = datetime(2024, 1, 30) - timedelta(days=n)
        rows = [(n * 3 + i, day + timedelta(hours=i), n * 3 + i, "error") for i in range(3)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/{n}")
        (part,) = (tmp_path / str(n)).glob("part-*.parquet")
        part.rename(where / f"{n:02d}.parquet")
        os.utime(where / f"{n:02d}.parquet", (time.time() - 1000 + n,) * 2)
    assert sorted(r["event_id"] for r in streams.stream_dedup(spark, str(tmp_path)).collect()) == list(range(60))
    assert sum(r["n"] for r in streams.stream_sessions(spark, str(tmp_path)).collect()) == 60
    # timers of the last day are not due when the input ends
    due = {r["user_id"] for r in streams.stream_grace(spark, str(tmp_path)).collect()}
    assert due >= set(range(6, 60)), sorted(set(range(6, 60)) - due)
