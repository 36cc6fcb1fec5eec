"""One very long text among short ones, and extra columns with names that the operators use."""

import hashlib
import random

import pytest

from lodestone.llm import exact_dedup, packing, quality, simhash, substring_dedup, suffix_dedup

from .test_packing import PATH, check
from .test_simhash import brute_fp

RNG = random.Random(11)
WORDS = ["".join(RNG.choices("abcdefgéü", k=RNG.randint(2, 9))) for _ in range(3000)]
LONG = " ".join(RNG.choices(WORDS, k=120_000))
OTHER = LONG[:-1] + ("x" if LONG[-1] != "x" else "y")
PASSAGE = " ".join(LONG.split()[60_000:60_090])
TEXTS = {1: LONG, 2: LONG.replace(" ", "\n\t", 5000), 3: OTHER, 4: "short one", 5: None, 6: " ".join(RNG.choices(WORDS, k=200)) + " " + PASSAGE + " " + " ".join(RNG.choices(WORDS, k=200))}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a", 1, 1, 1, "k", [1], 0) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row long, level int, fp long, name string, keys array<int>, size int").cache()


def test_exact_dedup(docs):
    got = {r["doc_id"]: r for r in exact_dedup.dedup(docs).collect()}
    assert {i: got[i]["keep_id"] for i in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert got[2]["text_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()


def test_simhash(docs):
    got = {r["doc_id"]: r for r in simhash.near_groups(docs).collect()}
    assert {i: got[i]["fp"] % 2**64 for i in got} == {i: brute_fp(t) for i, t in TEXTS.items()}
    assert got[1]["component_id"] == got[2]["component_id"] == got[3]["component_id"] == 1 and got[4]["component_id"] == 4


def test_packing(docs):
    check(packing.pack(docs, PATH).collect(), TEXTS)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    at = tmp_path_factory.mktemp("long")
    docs.write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_suffix_dedup(spark, folder):
    got = {r["doc_id"]: r for r in suffix_dedup.op4_suffix_dedup(spark, folder).collect()}
    assert got[1]["n_bytes"] == len(LONG.encode()) and got[4]["n_removed"] == got[5]["n_removed"] == 0
    assert got[1]["n_removed"] == got[1]["n_bytes"] and got[3]["n_removed"] == got[3]["n_bytes"] - 1
    assert got[6]["n_removed"] >= len(PASSAGE.encode())


def test_substring_dedup(spark, folder):
    got = {r["doc_id"]: r["class_id"] for r in substring_dedup.op7_substring_dedup(spark, folder).collect()}
    assert got[1] == got[2] == got[3] == got[6] != got[4]


def test_quality(docs):
    got = quality.classify(docs.select("doc_id", "text", "row")).collect()
    assert len(got) == len(TEXTS) and not next(r for r in got if r["doc_id"] == 5)["keep"]
