import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality

DIR = "/root/testdata/sf0.01"


def test_em_recovers_accuracies():
    rng = random.Random(0)
    patterns, truth = {}, {}
    acc = [0.9, 0.8, 0.85, 0.7, 0.95, 0.75, 0.8, 0.9, 0.85, 0.8]
    for _ in range(20000):
        good = rng.random() < 0.8
        k = "".join("-" if rng.random() < 0.2 else ("g" if good == (rng.random() < a) else "b") for a in acc)
        patterns[k] = patterns.get(k, 0) + 1
        truth.setdefault(k, [0, 0])[good] += 1
    posterior, rates = quality.em(patterns)
    right = sum(truth[k][posterior[k] >= 0.5] for k in patterns)
    assert right > 0.97 * 20000
    assert abs(rates["variety"][1][1] - 0.95) < 0.03


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_accuracy_on_labels(spark):
    found = quality.op3_quality_classifier(spark, DIR)
    scored = found.join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id")
    rows = scored.select("keep", F.col("quality").cast("boolean").alias("good")).collect()
    good = [r["keep"] for r in rows if r["good"]]
    bad = [r["keep"] for r in rows if not r["good"]]
    assert sum(good) >= 0.97 * len(good), (sum(good), len(good))
    assert sum(bad) <= 0.1 * len(bad), (sum(bad), len(bad))


def test_toxic_prose_does_not_enter_the_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(8)
    vocab = ["the", "house", "of", "river,", "stone.", "wind", "and", "to", "small", "tree.", "over", "light"] + [f"word{i}" for i in range(300)]
    prose = lambda: " ".join(rng.choices(vocab, k=150)).capitalize() + ". "
    rows = [(i, prose()) for i in range(120)] + [(200 + i, "BUY!! NOW!! CHEAP!! " * 60) for i in range(20)]
    rows += [(300, prose() + "You idiot, what a worthless clown. " + prose()), (301, prose() + "We will find you. " + prose()), (302, prose() + "The clown came to the circus. " + prose())]
    got = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert set(range(120)) | {302} <= got and not {300, 301} & got


def test_edge_rows_pass_through(spark):
    rows = [(1, None, "a", 0.5), (2, "", None, None), (3, "word", "c", 1.0), (3, "word", "c", 1.0), (None, "The house is old. " * 9, "d", 2.0),
            (5, "BUY!! NOW!! " * 200, "e", 0.0), (6, "plain words and more of them here. " * 30000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string, keep double")
    got = quality.classify(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, (r["other"] for r in got))) == sorted(map(str, (r[2] for r in rows)))
    assert {r["keep"] for r in got if r["doc_id"] == 3} in ({True}, {False})
    assert all(r["p_quality"] is not None for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.classify(df).collect() == []


def test_markers_of_toxicity_on_held_out_documents(spark):
    """Invented insults in two made-up languages are learned from labels; one chance hit in a long text is not toxic."""
    rng = random.Random(12)
    vocab = {"a": [f"ka{i}lo" for i in range(200)], "b": [f"mi{i}ru" for i in range(200)]}
    insult = {"a": "zuxeb", "b": "grawol"}

    def doc(lang, bad, n):
        words = rng.choices(vocab[lang], k=n)
        for _ in range(bad):
            words.insert(rng.randrange(n), insult[lang] + rng.choice(("en", "ista", "", "or")) + ",")
        return " ".join(words)

    plan = [(lang, bad) for lang in "ab" for bad in [0] * 180 + [3] * 40]
    rows = [(i, doc(lang, bad, 60), int(bad > 0)) for i, (lang, bad) in enumerate(plan)]
    rows += [(1000 + i, None, 0) for i in range(3)] + [(1100, "", None), (1100, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    markers = quality.fit_toxic(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert markers[quality.PLAIN] < 0 and {k[:4] for k in markers if k} == {"zuxe", "graw"}
    fresh = [(i, doc("ab"[i % 2], 3 * (i % 4 > 1), 60), i % 4 > 1) for i in range(80)] + [(90, doc("a", 1, 3000), False), (91, None, False), (92, "", False)]
    got = {r["doc_id"]: r["toxicity"] for r in quality.classify(spark.createDataFrame(fresh, "doc_id long, text string, bad boolean"), markers=markers).collect()}
    assert all((got[i] >= quality.TOXIC_LEAST) == bad for i, _, bad in fresh), got
    want = quality.Toxicity(markers)
    assert all(abs(got[i] - want.of(quality.Counter((t or "").split()))) < 1e-9 for i, t, _ in fresh)


def test_no_markers_without_labels_of_both_classes(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 0), (2, 0)], [(1, 1)], [(1, None)]):
        assert quality.fit_toxic(df, spark.createDataFrame(rows, "doc_id long, toxic int")) == {}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.fit_toxic(empty, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")) == {}
