import random

import corpus_pipeline
from lodestone.llm import exact_dedup, mixing, quality, simhash
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_components, brute_fp


def documents():
    rng = random.Random(8)
    vocab = ["the", "house", "of", "river,", "stone.", "wind", "and", "to", "small", "tree.", "over", "light"] + [f"word{i}" for i in range(300)]
    new = lambda n: " ".join(rng.choices(vocab, k=n)).capitalize() + "."
    rows = [(i, new(rng.randint(20, 400)), "en", f"s{i % 4}", 1) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s0", 1) for i in range(30)]
    rows += [(300 + i, rows[i][1] + " extra", "en", "s1", 1) for i in range(10)]
    rows += [(400 + i, "BUY!! NOW!! CHEAP!! " * 60, "en", "s2", 1) for i in range(20)]
    rows += [(500, None, None, None, None), (501, "", "en", None, None), (5, rows[5][1], "en", "s1", 1)]
    return rows


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    accepted = stages["quality classifier"](spark, docs, "").collect()
    ids = [r["doc_id"] for r in accepted]
    assert set(range(120)) <= set(ids) and not set(range(400, 420)) & set(ids)

    docs = spark.createDataFrame(accepted, docs.schema)
    unique = stages["exact dedup"](spark, docs, "").collect()
    want = {}
    for r in accepted:
        want[r["text"] or ""] = min(want.get(r["text"] or "", 1 << 60), r["doc_id"])
    assert sorted(r["doc_id"] for r in unique) == sorted(want.values())

    docs = spark.createDataFrame(unique, docs.schema)
    apart = stages["SimHash near-dedup"](spark, docs, "").collect()
    groups = brute_components([brute_fp(r["text"]) for r in unique], [r["doc_id"] for r in unique])
    assert sorted(r["doc_id"] for r in apart) == sorted(set(groups))

    docs = spark.createDataFrame(apart, docs.schema)
    mixed = stages["mixing sources"](spark, docs, "").collect()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    for r in apart:
        assert sum(m["doc_id"] == r["doc_id"] for m in mixed) == copies[r["doc_id"]] <= 3
    assert all(list(r.asDict()) == columns for r in (*accepted, *unique, *apart, *mixed))

    once = {m["doc_id"]: m for m in mixed}
    pieces = stages["packing"](spark, spark.createDataFrame(list(once.values()), docs.schema), "").collect()
    check(pieces, {i: m["text"] for i, m in once.items()})


def test_run_and_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents(), schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 100
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
    assert len(corpus_pipeline.STAGES) == 5
    assert all(m for m in (exact_dedup, quality, simhash))


def test_columns_of_clashing_names_pass_unchanged(spark):
    names = ["_text", "Keep", "keep_", "_copies", "copies", "_time", "time", "_pipeline_row", "row", "p_quality", "p_weak", "votes", "_order", "fp", "c0", "size"]
    rows = [(*r[:2], "en", r[3], *range(i, i + len(names))) for i, r in enumerate(documents())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` long" for n in names))
    own = {r[4]: r for r in rows}
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(tuple(r) == own[r["_text"]] for r in found)


def test_a_very_long_text(spark):
    long = "the house of stone and light " * 60000
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, long, "en", "s"), (3, "a small tree over the river", "en", "t")], "doc_id long, text string, lang string, source string")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert {r["doc_id"] for r in stage(spark, docs, "").select("doc_id").collect()} <= {1, 2, 3}, name
    assert sorted(r["doc_id"] for r in corpus_pipeline.exact_stage(spark, docs, "").collect()) == [1, 3]
