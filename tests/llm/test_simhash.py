import random
import re

import numpy as np
import xxhash

from lodestone.llm import simhash


def brute_fp(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids, radius=4):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), d), d)
    return [low[root(i)] for i in range(len(fps))]


def test_matches_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(200)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 300))) for _ in range(30)]
    texts = list(base) + ["", None, " \t\n", "one", "ONE", "É é"]
    for b in base:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append("  ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    texts.append(" ".join(rng.choices(vocab, k=90_000)))
    rng.shuffle(texts)
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)] + [(5, texts[5], None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, fp string, row string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op6_simhash_dedup(spark, str(tmp_path)).collect())
    fps = [brute_fp(r[1]) for r in rows]
    want = sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(fps, [r[0] for r in rows])))
    assert got == want


def test_cut_shards_and_long_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 16)
    rng = np.random.default_rng(1)
    x, values = 0, []
    for _ in range(150):  # a chain: neighbours differ by up to four bits, ends by many
        values.append(x)
        for b in rng.choice(64, 4, replace=False):
            x ^= 1 << int(b)
    values = sorted({int(v) for v in values} | {int(v) for v in rng.integers(0, 2**63, 50)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    root = {r["node"]: r["root"] for r in found}
    groups = {}
    for (s,), c in zip(signed, brute_components(values, list(range(len(values)))), strict=True):
        groups.setdefault(c, set()).add(root.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    items = rng.integers(0, 1 << 12, 600).astype(np.uint64)
    items = np.unique(items)
    pairs = {(int(i), int(j)) for q, t in simhash.BKTree(items).search(items, 2) for i, j in zip(q, t, strict=True)}
    assert pairs == {(i, j) for i in range(len(items)) for j in range(len(items)) if (int(items[i]) ^ int(items[j])).bit_count() <= 2}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert simhash.op6_simhash_dedup(spark, str(tmp_path)).collect() == []
