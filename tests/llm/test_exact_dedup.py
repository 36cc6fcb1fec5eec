import hashlib
import random
import re

from lodestone.llm import exact_dedup

SCHEMA = "doc_id long, text string, row long, name string, level int"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    ids = {}
    for (i, _), t in zip(rows, norm):
        ids.setdefault(t, []).append(i)
    return sorted((i, min(ids[t]), len(ids[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm))


def test_matches_brute_force_over_many_rounds(spark, tmp_path):
    rng = random.Random(4)
    base = ["".join(rng.choices("ab é\t\n", k=rng.randint(0, 90))) for _ in range(25)]
    rows = [(i, rng.choice(base).replace(" ", rng.choice([" ", "  ", "\n"]))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\t\n"), (204, "a" * 5000), (205, "a" * 5001), (206, "a" * 5000)]
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA).repartition(3)
    for block in (3, 16, 8192):
        found = exact_dedup.dedup(df, block_chars=block).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == brute(rows), block
        assert sum(r["kept"] for r in found) == len({b[1] for b in brute(rows)})


def test_repeated_rows_keep_one_and_null_ids_go_last(spark):
    df = spark.createDataFrame([(5, "x"), (5, "x"), (None, "x"), (None, "y"), (None, "y")], "doc_id long, text string")
    found = exact_dedup.dedup(df).collect()
    assert len(found) == 5 and sum(r["kept"] for r in found) == 2
    assert {r["keep_id"] for r in found if r["group_size"] == 3} == {5}


def test_keys_are_drawn_again_when_two_contents_share_one(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64

    def clashing(*cols):
        return F.length(cols[-1]).cast("long") if cols[0]._jc.toString() == "0" else real(*cols)

    monkeypatch.setattr(exact_dedup.F, "xxhash64", clashing)
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c")]
    found = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["keep_id"]) for r in found) == [(1, 1), (2, 2), (3, 1), (4, 4)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert exact_dedup.op2_exact_dedup(spark, str(tmp_path)).collect() == []
