import hashlib
import random
import zlib

from lodestone.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, n int, digest string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i % 2 == 1, level[i ^ 1] if i ^ 1 < len(level) else ""))
        i //= 2
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([leaf(r) for r in sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for x in order}
    top = climb([trees[x][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        for i, r in enumerate(sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            path = siblings(trees[x], i) + siblings(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf((*r[:3], r[3] if r[3] is None else r[3] + 1, r[4])) if hit else leaf(r)
            for left, s in path:
                folded = h(s, folded) if left else h(folded, s)
            out.append((str(r[0]), leaf(r), trees[x][-1][0], top[-1][0], h(*(s for _, s in path)), folded, folded == top[-1][0]))
    return sorted(out)


def check(spark, rows, at):
    spark.createDataFrame([(*r, "t", 1, 2, "d", "p") for r in rows], SCHEMA).repartition(5).write.parquet(f"{at}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(at)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)
    return got


def rows_of(rng, n, langs):
    return [(i, rng.choice(["a", "é", None]), rng.choice(langs), rng.choice([None, 0, 5, 2**63 - 1]), rng.choice(["text", "", None, "ü" * 3])) for i in range(n)]


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = rows_of(rng, 700, ["en"] * 20 + ["de", None, "", "=", "é", "zz", "z"])
    rows += [(9000 + i, "a", "long", 1, "x") for i in range(17)] + [(9900, "a", "alone", 1, "x" * 300_000), (9901, None, "two", None, None), (9902, None, "two", None, None)]
    rows += [(5, "s", "en", i % 3, "one id holds many rows") for i in range(400)] + [rows[3]] * 9 + [(None, "a", "en", 1, "x"), (None, "b", "en", 1, "y"), (None, "a", "en", 1, "x"), (7, "q", "en", 3, "again")]
    rng.shuffle(rows)
    got = check(spark, rows, tmp_path)
    assert any(r["verified"] for r in got) and not all(r["verified"] for r in got)


def test_every_small_size(spark, tmp_path):
    sizes = [1, 2, 3, 4, 5, 15, 16, 17, 31, 33, 255, 257]
    rows = [(1000 * n + i, "s", f"l{n:03d}", i, "t") for n in sizes for i in range(n)]
    check(spark, rows, tmp_path)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op12_merkle_manifest(spark, str(tmp_path)).collect() == []
