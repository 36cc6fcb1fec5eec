"""Tables built to be read in part give what a full pass gives, and are read in part."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import langid, postings, search, vector_cells
from lodestone.operators.cursor import SORTS, Cursor, ordering
from lodestone.sources import sorted_table

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("sort", ["chunks_desc", "chunks_asc", "updated_desc", "id_asc", "id_desc"])
def test_pages_of_a_sorted_table(spark, tmp_path, sort):
    rng = random.Random(1)
    rows = [(f"d{i:04d}", rng.choice([None, 0, 1, 1, 2, 9]), rng.choice([None, 5, 7]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "id string, chunk_count int, at int, n int").withColumn("sort_ts", F.timestamp_seconds("at")).drop("at")
    at = str(tmp_path / sort)
    sorted_table.write_sorted(df, at, sort, 6)
    files = spark.read.parquet(f"{at}/files")
    assert files.count() > 2 and files.agg(F.sum("n")).first()[0] == 700
    want = [r["id"] for r in df.orderBy(*ordering(sort)).collect()]
    cursor, seen, key = None, [], SORTS[sort][0]
    while True:
        found = sorted_table.page(spark, at, sort, cursor, 90).collect()
        if not found:
            break
        assert set(found[0].asDict()) == {"id", "chunk_count", "n", "sort_ts"}
        seen += [r["id"] for r in found]
        last = found[-1]
        value = None if key is None else last[key]
        cursor = Cursor(sort, str(value) if key == "sort_ts" and value is not None else value, last["id"]).encode()
        assert len(sorted_table.files_of(spark, at, sort, cursor, 5)) <= 2
    assert seen == want


def chunks_of(spark, rng, n=200):
    words = ["The", "cat", "é", "sat", "mat", "WAS", "x1", "dog"]
    rows = [(f"d{i % 40}", i // 40, " ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", None])) for i in range(n)]
    return spark.createDataFrame([*rows, ("long", 0, "the cat " * 50_000, "a"), ("none", 0, None, "a")], "document_id string, chunk_index int, content string, source string")


def test_postings_score_as_a_full_pass(spark, tmp_path):
    chunks = chunks_of(spark, random.Random(2))
    at = f"{tmp_path}/p"
    postings.build(chunks, "content", at, kept=("source",), buckets=16)
    plain = lambda df: {(r["document_id"], r["chunk_index"]): round(r["score"], 9) for r in df.collect()}
    for query in ("the was", "dog", "É x1 nothing", "nothing at all", ""):
        if postings.terms_of(query):
            full = plain(search.bm25(chunks, query, "content"))
            assert plain(postings.search(spark, at, query, buckets=16)) == full
            own = {(r[0], r[1]) for r in chunks.filter("source = 'a'").select("document_id", "chunk_index").collect()}
            assert plain(postings.search(spark, at, query, F.col("source") == "a", buckets=16)) == {k: v for k, v in full.items() if k in own}
        else:
            assert plain(postings.search(spark, at, query, buckets=16)) == {}
    one = postings.read(spark, at, ["dog"], 16)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "").replace("[,", "[") or "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:120]
    assert "term" in plan.split("PushedFilters")[1][:120]
    assert {r["bucket"] for r in one.select("bucket").distinct().collect()} == {spark.range(1).select(postings.bucket(F.lit("dog"), 16)).first()[0]}


def test_cells_give_the_exact_nearest_and_skip_most(spark, tmp_path):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(i, [c + rng.gauss(0, 0.02) for c in centres[i % 30]]) for i in range(3000)]
    rows += [(5000, rows[7][1]), (5001, [0.0] * 12), (5002, None), (5003, [float("nan")] * 12), (5004, [None] * 12), (5005, [2 * x for x in rows[7][1]])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    at = f"{tmp_path}/v"
    vector_cells.build(df, at, 90)
    usable = df.filter("id not in (5001, 5002, 5003, 5004)").select(F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("vector").alias("content_vector"))
    for q, k in ((rows[7][1], 20), ([rng.gauss(0, 1) for _ in range(12)], 50), (rows[99][1], 1)):
        found, report = vector_cells.nearest(spark, at, q, k)
        want = search.semantic(usable, q, k).collect()
        assert [round(r["score"], 9) for r in found.collect()] == [round(r["score"], 9) for r in want]
        assert report["vectors"] == 3002
    assert report["vectors_read"] < 0.2 * report["vectors"], report
    whole, report = vector_cells.nearest(spark, at, rows[7][1], 4000)
    assert whole.count() == 3002 == report["vectors_read"]


def test_no_vectors(spark, tmp_path):
    vector_cells.build(spark.createDataFrame([(1, None)], "id long, vector array<double>"), f"{tmp_path}/v")
    found, report = vector_cells.nearest(spark, f"{tmp_path}/v", [1.0, 0.0])
    assert found.collect() == [] and report["cells"] == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_languages_are_told(spark):
    """Fitted on 40 documents a language; at least 95 % of all texts of 200 bytes or more are told right."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    profiles = langid.fit(docs, sample=40)
    assert set(profiles) == {"en", "fr", "de", "es"} and all(len(p) == langid.RANKS for p in profiles.values())
    told = langid.detect(docs.filter(F.octet_length("text") >= 200), profiles)
    right, none, n = told.agg(F.count_if(F.col("lang_code") == F.col("lang")), F.count_if(F.col("lang_code").isNull()), F.count("*")).first()
    assert right >= 0.95 * n, (right, none, n)
    print("told right", right, "no verdict", none, "of", n)


def test_verdicts_at_the_edges(spark):
    en = "the quick brown fox jumps over the lazy dog and then the dog runs after the fox through the old forest "
    fr = "le renard brun saute par dessus le chien paresseux et puis le chien court dans la vieille forêt avec les autres "
    profiles = langid.fit(spark.createDataFrame([(1, "en", en * 3), (2, "fr", fr * 3), (3, None, en), (4, "fr", None)], "doc_id long, lang string, text string"))
    rows = [("en", en * 4), ("short", "the fox"), ("null", None), ("mixed", en * 6 + fr * 4), ("digits", "1234 " * 100), ("long", fr * 5000), ("empty", "")]
    got = {r["k"]: r for r in langid.detect(spark.createDataFrame(rows, "k string, text string"), profiles).collect()}
    assert got["en"]["lang_code"] == "en" and got["long"]["lang_code"] == "fr" and got["en"]["mixed_with"] is None
    (mixed,) = langid.detect(spark.createDataFrame([("mixed", en * 6 + fr * 4)], "k string, text string"), profiles, margin=0.0).collect()
    assert (mixed["lang_code"], mixed["mixed_with"]) == ("en", "fr")
    assert all(got[k]["lang_code"] is None for k in ("short", "null", "digits", "empty"))
    one = langid.detect(spark.createDataFrame([("a", en * 4)], "k string, text string"), {}).first()
    assert one["lang_code"] is None
