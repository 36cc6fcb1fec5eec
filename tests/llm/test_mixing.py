import hashlib
import random
import re

import pytest

from lodestone.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, rank int, weight int"


def brute_targets(rows):
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, target = set(), {}
    while True:
        free = [s for s in order if s not in capped]
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        total = sum(weight[s] for s in free)
        for s in order:
            target[s] = 3.0 * size[s] if s in capped else weight[s] * left / total
        new = {s for s in free if target[s] > 3 * size[s]}
        if not new:
            return size, target
        capped |= new


def rows_of(rng, n):
    sources = ["a", "b", "é", "z", "", None]
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choices(sources, [50, 2, 5, 20, 3, 1])[0]) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", None), (n + 2, "only white", "empty one"), (n + 3, "", "none at all"), (3, rows[3][1], rows[3][2])]


def test_targets_and_taken_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    rows = rows_of(random.Random(1), 3000)
    spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = mixing.op8_mixing(spark, str(tmp_path)).collect()
    again = mixing.op8_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    size, target = brute_targets(rows)
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 31 for s in size)


def test_empty_table_and_no_words(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).collect() == []
    found = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r["target"], r["taken"]) for r in found] == [(0.0, 0)] * 2


def test_one_id_holds_most_rows(spark, monkeypatch):
    """Rows of one id, or of none, are split; the result is that of a plain running sum."""
    monkeypatch.setattr(mixing, "SLICE_BITS", 2)
    rng = random.Random(5)
    rows = [(rng.choice([7, 7, None, i]), "w " * rng.randint(0, 30), rng.choice(["a", "a", "b", None]), i, "x") for i in range(900)]
    rows.append((7, "word " * 200000, "a", 900, "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long, bucket string")
    got = mixing.mix(df, row_col="n").collect()
    assert len(got) == len(rows)
    for source in ("a", "b", None):
        own = sorted((r for r in got if rows[r["row"]][2] == source), key=lambda r: (
            hashlib.md5(f"42:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), r["doc_id"] is not None, r["doc_id"] or 0, r["row"]))
        size = sum(r["size"] for r in own)
        target, ahead = own[0]["target"], 0
        whole = int(target // size)
        for r in own:
            assert r["copies"] == whole + (ahead + r["size"] / 2 < target - whole * size)
            ahead += r["size"]
