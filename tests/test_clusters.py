"""Components, near clusters and the incremental store beside plain Python and full runs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import clusters, duplicates, lsh_store
from lodestone.operators.components import components
from lodestone.sources.versions import Tables

WORDS = [f"word{i}" for i in range(400)]


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def texts_of(rng, families=8, size=7):
    out = []
    for f in range(families):
        base = rng.choices(WORDS, k=150)
        for j in range(size):
            base = edited(rng, base, rng.choice([0, 1, 2, 4]))  # chains: the ends of a family need not be alike
            out.append(" ".join(base))
    return out + ["", None, "one two", "one two", "... --"]


def test_components_of_a_hub_a_chain_and_pairs(spark):
    rng = random.Random(4)
    links = [(f"n{0:04d}", f"n{i:04d}") for i in range(1, 300)] + [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(120)] + [(f"p{i}", f"p{i + 1}") for i in range(0, 40, 2)] + [("s", "s")]
    links += [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in links], "a string, b string")).collect()}
    want = roots_of({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.fixture(scope="module")
def signed(spark):
    texts = texts_of(random.Random(6))
    rows = [(f"d{i:03d}", 1, t) for i, t in enumerate(texts)]
    return duplicates.signatures(spark.createDataFrame(rows, "id string, connector_id int, text string")).cache()


def pair_rows(signed):
    return {(r["a"], r["b"]): r["similarity"] for r in duplicates.near_pairs(signed).collect()}


def test_clusters_are_those_of_all_pairs(spark, signed):
    got = clusters.near_clusters(signed, part=2).collect()
    nodes = [r["id"] for r in signed.collect()]
    want = roots_of(nodes, pair_rows(signed))
    assert {r["document_id"]: r["cluster_id"] for r in got} == want and len(got) == len(nodes)
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert all(r["cluster_size"] == sizes[r["cluster_id"]] for r in got) and 5 < len(sizes) < 40


def test_clusters_that_only_unlike_members_join(spark):
    """Neither the first nor the last of a bucket is alike to all: the cells must join the rest."""
    sig = lambda *blocks: [b for b in blocks for _ in range(32)]
    rows = [("a", sig(1, 2, 3, 4)), ("z", sig(9, 8, 7, 4)), ("m", sig(5, 6, 3, 4)), ("n", sig(5, 6, 3, 40)), ("o", sig(5, 6, 30, 41))]
    df = spark.createDataFrame([(i, s, [7]) for i, s in rows], "id string, sig array<long>, bands array<long>")
    got = {r["document_id"]: r["cluster_id"] for r in clusters.near_clusters(df, 0.75, part=1).collect()}
    assert got == {"a": "a", "z": "z", "m": "m", "n": "m", "o": "o"}


def test_no_documents(spark):
    none = spark.createDataFrame([], "id string, sig array<long>, bands array<long>")
    assert clusters.near_clusters(none).collect() == []


def stored(tables):
    return {(r["a"], r["b"]): r["similarity"] for r in lsh_store.pairs(tables).collect()}


def full(spark, texts):
    df = spark.createDataFrame([(k, 1, t) for k, t in texts.items()], "id string, connector_id int, text string")
    signed = duplicates.signatures(df).cache()
    first = {}
    for r in sorted(signed.collect(), key=lambda r: r["id"]):
        first.setdefault(tuple(r["sig"]), r["id"])
    keep = set(first.values())
    return {p: s for p, s in pair_rows(signed).items() if set(p) <= keep}, {r["document_id"]: r["cluster_id"] for r in clusters.near_clusters(signed).collect()}


def test_three_batches_equal_a_full_run(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    texts = {f"d{i:03d}": t for i, t in enumerate(texts_of(rng, 9, 6))}
    ids = list(texts)
    tables = Tables(spark, f"{tmp_path}/s", 24)
    lsh_store.create(tables)
    frame = lambda own: spark.createDataFrame(list(own.items()), "id string, text string")
    only = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    now = {k: texts[k] for k in ids[::2]}
    assert lsh_store.update(tables, frame(now), batch=("docs", 1))
    second = {k: texts[k] for k in ids[1::2]} | {ids[0]: texts[ids[20]], ids[4]: "", ids[6]: " ".join(edited(rng, texts[ids[6]].split(), 3))}
    now |= second
    assert lsh_store.update(tables, frame(second).union(frame({ids[0]: texts[ids[20]]})), only(["never there"]), ("docs", 2))
    third, gone = {ids[8]: texts[ids[9]]}, [ids[3], ids[10], ids[11]]
    read, buckets = Tables.read, []
    monkeypatch.setattr(Tables, "read", lambda self, name, hit=None, state=None: (buckets.append((name, hit)), read(self, name, hit, state))[1])
    before = tables.state()
    assert lsh_store.update(tables, frame(third), only(gone), ("docs", 3))
    monkeypatch.undo()
    now = {k: t for k, t in (now | third).items() if k not in gone}
    pairs, clustered = full(spark, now)
    assert stored(tables) == pairs and len(pairs) > 20
    assert {r["document_id"]: r["cluster_id"] for r in lsh_store.clusters(tables).collect()} == clustered
    # only the buckets of what changed were read, and all others still are the files they were
    assert all(hit is not None and len(hit) < 24 for _, hit in buckets)
    for name, most in (("lsh_document", 4), ("lsh_signature", 8)):
        old, new = before.tables[name]["parts"], tables.state().tables[name]["parts"]
        assert sum(old.get(b) != new.get(b) for b in set(old) | set(new)) <= most
    assert not lsh_store.update(tables, frame(texts), batch=("docs", 3)) and stored(tables) == pairs
    assert {r["id"] for r in lsh_store.unsigned(tables, frame(texts)).collect()} >= set(gone)
    assert lsh_store.update(tables, frame({}), only(ids), ("docs", 4)) and stored(tables) == {}
    assert all(tables.read(n).isEmpty() for n in lsh_store.SCHEMAS)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = rng.choices(WORDS, k=120)
    rows = [(f"d{i:05d}", 1, " ".join([*base, *edited(rng, base[:2], 2)])) for i in range(3000)]
    signed = duplicates.signatures(spark.createDataFrame(rows, "id string, connector_id int, text string").repartition(4))
    got = clusters.near_clusters(signed).groupBy("cluster_id").agg(F.count("*").alias("n")).collect()
    assert [r["n"] for r in got] == [3000]
