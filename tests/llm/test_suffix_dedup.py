import hashlib
import random
import re
from collections import Counter

import numpy as np

from lodestone.llm import suffix_dedup
from lodestone.sources import scratch


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~gone[1:]).sum())
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(texts, length, words):
    """Runs under repeated strings with so many whole words; a text that occurs twice has one if it has the words."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
        whole = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)]
        found = sum(sum(s <= a and z <= e for a, z in whole) >= words for s, e in edge.tolist())
        out.append(int(len(whole) >= words and len(d) >= length) if data.count(d) > 1 else found)
    return out


def test_passages_of_over_fifty_words_are_told(spark, tmp_path):
    rng = random.Random(7)
    new = lambda n: " ".join(f"{rng.choice('bdfglmn')}{rng.choice('aeiou')}{rng.choice('rst')}{rng.randrange(10)}" for _ in range(n))
    rows = []
    for i in range(20):
        p = new(rng.randint(51, 70))  # most are shorter than 400 bytes
        rows += [(2 * i, f"{new(30)} {p} {new(40)}"), (2 * i + 1, f"{new(10)} {p} {new(60)}")]
    line = new(20)
    rows += [(100 + i, f"{new(100)} {line} {new(100)}") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_passages"] for r in suffix_dedup.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    assert all(got[i] == 1 for i in range(40)) and not any(got[i] for i in range(100, 120))


def digest(row):
    n = sum(s["end"] - s["start"] for s in row["spans"])
    return (row["n_bytes"], n, len(row["spans"]), row["kept_sha256"])


def texts_with_repeats(rng, size):
    alphabet = "abcdé \n"
    new = lambda n: "".join(rng.choices(alphabet, k=n))
    passages = [new(rng.randint(size // 2, 4 * size)) for _ in range(6)]
    texts = [new(rng.randint(0, 6 * size)) for _ in range(15)]
    for _ in range(45):
        p = rng.choice(passages)
        a = rng.randint(0, len(p) // 3)
        texts.append(new(rng.randint(0, size)) + p[a : a + rng.randint(size // 2, 3 * size)] + new(rng.randint(0, size)) + (rng.choice(passages) if rng.random() < 0.3 else ""))
    texts += [texts[3], texts[20], texts[20], "", None, "a" * (5 * size), "ab" * (3 * size), "xyz" * (2 * size) + new(30)]
    rng.shuffle(texts)
    return texts


def test_production_length(spark, tmp_path):
    texts = texts_with_repeats(random.Random(1), 400)
    rows = [(i, t, i, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, sha long, tid string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 400)


def test_small_length_with_many_halvings_and_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPAN", 128)
    texts = texts_with_repeats(random.Random(2), 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for group_rows, short in ((1, 40), (3, 40), (1000, 40), (1, 24), (1000, 9)):
        rows = suffix_dedup.dedup(df, length=40, gram=8, group_rows=group_rows, short=short, words=3).collect()
        got = {r["doc_id"]: digest(r) for r in rows}
        assert [got[i] for i in range(len(texts))] == brute(texts, 40), (group_rows, short)
        passages = {r["doc_id"]: r["n_passages"] for r in rows}
        assert [passages[i] for i in range(len(texts))] == brute_passages(texts, short, 3), (group_rows, short)


def test_merge_equals_sort(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_ROWS", 50)
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 4, 400)
    raw = rng.integers(97, 99, (400, 32), dtype=np.uint8)
    raw[200:250] = raw[100:150]
    order, lcp = suffix_dedup.merged(keys, raw.view(">u8").astype(np.uint64))
    rows = [(keys[i], raw[i].tobytes()) for i in order]
    assert rows == sorted(rows)
    for i in range(1, 400):
        (k, a), (q, b) = rows[i - 1], rows[i]
        want = -1 if k != q else next((j for j in range(32) if a[j] != b[j]), 32)
        assert lcp[i] == want


def test_repeated_rows_nulls_and_empty(spark, tmp_path):
    text = "".join(random.Random(5).choices("abcdef ", k=1000))
    df = spark.createDataFrame([(1, text), (1, text), (None, "z" * 399), (2, None)], "doc_id long, text string")
    got = sorted(digest(r) for r in suffix_dedup.dedup(df).collect())
    assert got == sorted(brute([text, text, "z" * 399, None], 400))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert suffix_dedup.op4_suffix_dedup(spark, str(tmp_path)).collect() == []


def test_dead_tables_are_freed(spark):
    """Only tables that the result still reads stay on disk."""
    scratch.forget(spark)
    rng = random.Random(3)
    found = suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts_with_repeats(rng, 40))), "doc_id long, text string"), length=40, gram=8)
    held = {p.rsplit("/", 1)[-1][:-33] for p in scratch._KEPT}
    assert not held & {"anchors", "text-anchors", "anchor-keys", "records-0", "record-kinds", "record-sizes", "record-keys"}
    assert found.count() == found.select("doc_id").distinct().count() > 0
    scratch.forget(spark)
