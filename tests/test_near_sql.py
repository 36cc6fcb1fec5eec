"""MinHash and its pairs beside their SQL, on texts with accents, copies, edits and none at all."""

import random

import duckdb
import pytest

from lodestone.plans import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(2)
    words = [f"wörd{i}" if i % 3 else f"Term{i}," for i in range(200)]
    base = rng.choices(words, k=120)
    edited = [*base[:60], "other", *base[61:]]
    texts = [" ".join(base), " ".join(base), " ".join(edited), "\n".join(base), "one two", "", None, "... --", *(" ".join(rng.choices(words, k=60)) for _ in range(4))]
    rows = [(i, t, f"src{i % 3}", "en", len(t or "")) for i, t in enumerate(texts)]
    at = tmp_path_factory.mktemp("near")
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    for name, columns in (("events", "0 AS event_id, TIMESTAMP '2024-01-01' AS ts, 0 AS user_id, '' AS event_type, 0.0 AS value"), ("conversations", "0 AS conv_id, 0 AS turn, '' AS text, '' AS role")):
        db.sql(f"CREATE VIEW {name} AS SELECT {columns}")
    return str(at), db


@pytest.mark.parametrize("name", ["minhash_signature", "minhash_bands", "near_dup_pairs", "verified_jaccard", "max_similarity", "near_dup_reasons"])
def test_query_equals_its_sql(spark, tables, name):
    at, db = tables
    got = registry.QUERIES[name](spark, at)
    want = db.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(tuple(r) for r in got.select(names).collect())
    assert rows and rows == sorted(want.fetchall())
