"""Commits over several tables, batches that are played again, scans that die and go on."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import scan, trash
from lodestone.sources.versions import Change, Conflict, Tables
from lodestone.streaming import merge


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, f"{tmp_path}/t", 8)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts_in_any_order_and_played_again(spark, tables):
    new = lambda *r: spark.createDataFrame(r, "k int, at int, v string")
    assert tables.upsert("t", new((1, 5, "a"), (2, 1, "b"), (1, 4, "old")), ["k"], ["at"], ("w", 0))
    assert tables.upsert("t", new((1, 3, "late"), (2, 9, "c"), (3, 1, None)), ["k"], ["at"], ("w", 1))
    want = [(1, 5, "a"), (2, 9, "c"), (3, 1, None)]
    assert rows(tables.read("t")) == want
    before = tables.state()
    assert not tables.upsert("t", new((1, 99, "again")), ["k"], ["at"], ("w", 1))
    assert tables.state() == before and rows(tables.read("t")) == want
    assert tables.upsert("t", new((1, 99, "other")), ["k"], ["at"], ("x", 1))
    untouched = [b for b, p in before.tables["t"]["parts"].items() if tables.state().tables["t"]["parts"].get(b) == p]
    assert len(untouched) == len(before.tables["t"]["parts"]) - 1


def test_a_read_of_some_buckets_opens_their_files_only(spark, tables):
    tables.commit({"t": Change(spark.range(1000), ["id"])})
    hit = tables.touched(spark.createDataFrame([(7,), (8,)], "id long"), "id")
    some = tables.read("t", hit)
    folders = {f.split("_bucket=")[1].split("/")[0] for f in some.inputFiles()}
    assert folders == set(map(str, hit)) and some.filter("id in (7, 8)").count() == 2


def test_failure_between_two_writes_leaves_the_old_state(spark, tables, monkeypatch):
    one, two = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b")], "k int, v string")
    tables.commit({"x": Change(one, ["k"]), "y": Change(one, ["k"])})
    broken = two.withColumn("v", F.raise_error(F.lit("disk")).cast("string"))
    with pytest.raises(Exception, match="disk"):
        tables.commit({"x": Change(two, ["k"]), "y": Change(broken, ["k"])})
    assert rows(tables.read("x")) == rows(tables.read("y")) == [(1, "a")]
    with monkeypatch.context() as m:
        m.setattr(Tables, "_put", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            tables.commit({"x": Change(two, ["k"])})
    assert rows(tables.read("x")) == [(1, "a")]
    assert tables.clean() >= 2
    assert tables.commit({"x": Change(two, ["k"]), "y": Change(two, ["k"])}) and rows(tables.read("x")) == rows(tables.read("y")) == [(1, "b")]
    tables.clean()
    assert rows(tables.read("x")) == [(1, "b")]


def test_second_writer_and_torn_manifest(spark, tables, tmp_path):
    df = spark.createDataFrame([(1,)], "k int")
    seen = tables.state()
    tables.commit({"x": Change(df, ["k"])}, state=seen)
    with pytest.raises(Conflict):
        tables.commit({"x": Change(df, ["k"])}, state=seen)
    (tmp_path / "t/manifests/000000000002.json").write_text('{"number": 2, "tab')
    assert tables.state().number == 1
    tables.commit({"y": Change(df, ["k"])})
    assert tables.state().number == 3 and rows(tables.read("x")) == rows(tables.read("y")) == [(1,)]


def test_stream_batches_are_merged_once(spark, tables, tmp_path):
    for n in range(5):
        spark.createDataFrame([(k, n * 7 % 5, f"{n}.{k}") for k in range(n, 9)], "k int, at int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("k int, at int, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    merge.upsert_stream(stream(), tables, "t", ["k"], ["at"], f"{tmp_path}/c1")
    want = {}
    for n in range(5):
        for k in range(n, 9):
            want[k] = max(want.get(k, (-1, "")), (n * 7 % 5, f"{n}.{k}"))
    want = sorted((k, *v) for k, v in want.items())
    assert rows(tables.read("t")) == want
    before = tables.state()
    merge.upsert_stream(stream(), tables, "t", ["k"], ["at"], f"{tmp_path}/c2")  # a lost checkpoint: all batches once more
    assert tables.state() == before and rows(tables.read("t")) == want


def test_scan_goes_on_where_it_died(spark, tables):
    docs = spark.createDataFrame([(f"d{i:03d}", i) for i in range(100)] + [(None, 4), ("d001", 1)], "id string, n int")
    calls = []

    def work(df):
        calls.append(df.count())
        if len(calls) == 3:
            raise OSError("killed")
        return df.filter("n % 2 = 0").select(F.col("id").alias("document_id"), F.col("n").alias("reason"))

    phases = [scan.Phase("even", work), scan.Phase("again", work), scan.Phase("all", lambda df: df.groupBy(F.col("id").alias("document_id")).agg(F.count("*").alias("reason")), paged=False)]
    with pytest.raises(OSError):
        scan.run(tables, "s", docs, phases, pages=4)
    partial = tables.read("s").count()
    assert 0 < partial < 51
    assert not scan.run(tables, "s", docs, phases, pages=4, most=3) and scan.run(tables, "s", docs, phases, pages=4)
    got = rows(tables.read("s"))
    assert len(calls) == 9 and sum(calls) == 204 + calls[2]  # four pages and four pages, and one that died
    whole = Tables(spark, f"{tables.root}-whole", 8)
    calls.extend([0] * 3)
    assert scan.run(whole, "s", docs, phases, pages=3) and rows(whole.read("s")) == got
    assert scan.run(tables, "s", docs, phases, pages=4) and rows(tables.read("s")) == got  # done is done


def test_scan_of_nothing(spark, tables):
    docs = spark.createDataFrame([], "id string")
    assert scan.run(tables, "s", docs, [scan.Phase("p", lambda df: df.select(F.col("id").alias("document_id"), F.lit("r").alias("reason")))])
    assert rows(tables.read("s")) == []


def test_trash_is_all_or_nothing_and_counts_what_is_gone(spark, tables, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", i % 3 if i else None, i == 1) for i in range(8)], "id string, chunk_count int, hidden boolean")
    chunks = spark.createDataFrame([(f"d{i}", j, "x") for i in range(1, 8) for j in range(i % 3) if (i, j) != (5, 1)], "document_id string, chunk_index int, content string")
    tags = spark.createDataFrame([(f"d{i}", "k", f"v{i % 2}") for i in range(8)], "document_id string, tag_key string, tag_value string")
    links = spark.createDataFrame([(f"d{i}", c, 1) for i in range(8) for c in (1, 2)], "id string, connector_id int, credential_id int")
    trash.create(tables, docs, tags, links, chunks)
    asked = spark.createDataFrame([("d1",), ("d2",), ("d5",), ("d0",), ("none",)], "document_id string")
    with monkeypatch.context() as m:
        m.setattr(Tables, "_put", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            trash.discard(tables, asked, "2024-01-01")
    assert tables.read("document").count() == 8 and not tables.has("trash")
    assert trash.discard(tables, asked, "2024-01-01", batch=("discard", 1)) and not trash.discard(tables, asked, "2024-01-01", batch=("discard", 1))
    assert {r["id"] for r in tables.read("document").collect()} == {"d3", "d4", "d5", "d6", "d7"}  # d5 was read short
    assert tables.read("tag").count() == 5 and tables.read("attribution").count() == 10
    tables.commit({"document": Change(docs.filter("id = 'd2'"), ["id"], append=True)})
    report = trash.bring_back(tables, asked, spark.createDataFrame([(2,)], "id int"), tags.filter("tag_value = 'v0'"), "2024-01-02")
    assert rows(report.select("document_id", "outcome", "tags", "skipped_tags", "links", "skipped_links", "chunks")) == [
        ("d0", "restored", 1, 0, 1, 1, 0), ("d1", "restored", 0, 1, 1, 1, 1), ("d2", "refused_exists", 0, 0, 0, 0, 0), ("d5", "not_found", 0, 0, 0, 0, 0), ("none", "not_found", 0, 0, 0, 0, 0)]
    assert rows(tables.read("document").filter("id = 'd1'")) == [("d1", 1, True)]
    (total,) = trash.totals(tables, "2024-01-02").collect()
    assert (total["items"], total["restored_total"]) == (1, 2)
    again = trash.bring_back(tables, asked, spark.createDataFrame([(1,), (2,)], "id int"), tags, "2024-01-03", overwrite=True)
    assert {r["document_id"]: r["outcome"] for r in again.collect()} == {"d0": "not_found", "d1": "not_found", "d2": "restored", "d5": "not_found", "none": "not_found"}
    assert tables.read("document").filter("id = 'd2'").count() == 1 and tables.read("chunk").filter("document_id = 'd2'").count() == 2


def test_bringing_back_adds_rows_and_rewrites_none(spark, tables):
    docs = spark.createDataFrame([(f"d{i}", 1, i) for i in range(4)], "id string, chunk_count int, boost int")
    tags = spark.createDataFrame([(f"d{i}", "k", "v") for i in range(4)], "document_id string, tag_key string, tag_value string")
    links = spark.createDataFrame([(f"d{i}", 1, None) for i in range(4)], "id string, connector_id int, credential_id int")
    chunks = spark.createDataFrame([(f"d{i}", 0, f"text {i}") for i in range(4)], "document_id string, chunk_index int, content string")
    trash.create(tables, docs, tags, links, chunks)
    asked = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    trash.discard(tables, asked, "2024-01-01")
    before = tables.state().tables
    trash.bring_back(tables, asked, spark.createDataFrame([(1,)], "id int"), tags, "2024-01-02")
    after = tables.state().tables
    for name, df in (("document", docs), ("tag", tags), ("attribution", links), ("chunk", chunks)):
        for bucket, parts in before[name]["parts"].items():
            assert set(parts) <= set(after[name]["parts"][bucket])
        assert after[name]["schema"] == before[name]["schema"]
        assert sorted(map(str, tables.read(name).select(*df.columns).collect())) == sorted(map(str, df.collect()))
