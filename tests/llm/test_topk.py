import math

import numpy as np

from lodestone.llm import topk


def brute(rows, every=50, k=5):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    long = lambda x: max(topk.LEAST, min(topk.MOST, x))
    for at, (qi, qv) in enumerate(ok):
        if qi % every == 0:
            scored = sorted((-long(sum(a * b for a, b in zip(qv, v))), i) for n, (i, v) in enumerate(ok) if n != at and len(v) == len(qv))
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_matches_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 37)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(400, 40)).astype(np.float32)
    m[10:20] = m[9]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    rows += [(500, None), (501, []), (502, [float("nan")] * 40), (550, [float("inf")] + [0.0] * 39), (503, [None] + [1.0] * 39), (504, [0.0] * 40)]
    spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, dims int, row string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op1_exact_topk(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_repeated_ids_empty_and_huge_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i // 2, rng.normal(size=20).tolist()) for i in range(220)] + [(0, [1.0] * 20), (0, [1.0] * 20), (None, [1.0] * 20)]
    rows += [(300, []), (301, []), (50, []), (400, [3e17] + [1.0] * 19), (401, [-1e300] + [1.0] * 19), (402, [2.0**40] * 20)]
    spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "vec_id long, embedding array<double>, row int, query_row int, V int, q_cell int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op1_exact_topk(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_most_candidates_are_dropped_early():
    rng = np.random.default_rng(4)
    centre = np.repeat(rng.normal(size=(40, 64)), 64, axis=0) * 256
    m = np.floor(centre + rng.normal(size=centre.shape) * 40)
    best, ids, shares = np.full((8, 5), np.iinfo(np.int64).min + 1), np.full((8, 5), np.iinfo(np.int64).max), []
    for at in range(0, len(m), 512):
        topk.search_block(m[:8], np.arange(8), m[at : at + 512].T, np.arange(at, at + 512), np.arange(at, at + 512), best, ids, 5, shares)
    assert shares[-1] < 0.2
    assert (ids < 64).all()


def test_grid_and_large_values(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-(2**25), 2**25, 30).tolist()) for i in range(120)]
    df = spark.createDataFrame([(i, i, v) for i, v in rows], "row long, vec_id long, v array<bigint>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df.filter("vec_id % 5 = 0"), df, 7, 4, 16).collect())
    want = []
    for qi, qv in rows[::5]:
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != qi)[:7]
        want += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == sorted(want)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert topk.op1_exact_topk(spark, str(tmp_path)).collect() == []
