"""Policy commits, visibility through staging and restoring, examples of gates, references of connectors."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import fleet, lifecycle, policy, selection, triage
from lodestone.plans import curation


def test_a_commit_needs_the_count_that_was_seen(spark):
    rows = curation._prepared(spark, "/root/testdata/sf0.001").cache()
    p = policy.PRESETS["standard"]
    n = policy.members(rows, p, "review").count()
    hits = policy.commit(rows, p, "review", n, "standard").collect()
    assert len(hits) == n > 0 and all(r["reasons"][0]["code"] == "policy_review" and abs(r["reasons"][0]["confidence"] - 0.7) < 1e-6 for r in hits)
    assert '"tier":"standard"' in hits[0]["reasons"][0]["evidence"]
    with pytest.raises(selection.Drift):
        policy.commit(rows, p, "review", n + 1)
    with pytest.raises(ValueError, match="unknown band"):
        policy.commit(rows, p, "none", 0)


def test_staging_hides_and_restoring_shows_what_was_shown(spark):
    docs = spark.createDataFrame([("a", False), ("b", True), ("c", None), ("d", False)], "id string, hidden boolean")
    rows = [(1, "a", "candidate"), (2, "b", "candidate"), (3, "c", "candidate"), (4, "gone", "candidate"), (5, "d", "staged")]
    c = spark.createDataFrame([(*r, None) for r in rows], "candidate_id long, document_id string, state string, stage_expires_at timestamp")
    ask = lambda *ids, command: spark.createDataFrame([(i, command) for i in ids], "candidate_id long, command string")
    after, outcomes = lifecycle.transition(c, ask(1, 2, 3, 4, 5, command="stage"), "2024-01-01")
    noted, hidden = lifecycle.visibility(after, docs, outcomes)
    assert {r["id"]: r["hidden"] for r in hidden.collect()} == {"a": True, "b": True, "c": True, "d": False}  # 5 was staged before: a conflict
    assert {r["candidate_id"]: r["prev_hidden"] for r in noted.collect()} == {1: False, 2: True, 3: False, 4: None, 5: None}
    after, outcomes = lifecycle.transition(noted, ask(1, 2, 3, command="restore"), "2024-01-02")
    assert {r["id"]: r["hidden"] for r in lifecycle.visibility(after, hidden, outcomes)[1].collect()} == {"a": False, "b": True, "c": False, "d": False}


def test_first_examples_of_each_gate(spark):
    rows = [(i, ["g", "h"] if i % 50 == 0 else ["g"] if i % 3 else []) for i in range(500, 0, -1)]
    found = triage.gate_examples(spark.createDataFrame(rows, "id int, gates array<string>"))
    assert {r["gate"]: r["examples"] for r in found.collect()} == {"g": [1, 2, 4], "h": [50, 100, 150]}


def test_references_go_by_the_first_step_that_fits(spark):
    own = spark.createDataFrame([(1, 10, "Docs"), (2, 20, "docs"), (3, 30, "my docs"), (4, 4, "7"), (5, 50, None), (7, 70, "x")], "cc_pair_id int, connector_id int, name string")
    asked = ["Docs", "DOCS", "y d", "7", "70", "doc", "", "none", " docs ", "99"]
    got = {r["reference"]: (r["outcome"], r["cc_pair_id"]) for r in fleet.resolve(own, spark.createDataFrame([(a,) for a in asked], "reference string")).collect()}
    assert got == {"Docs": ("found", 1), "DOCS": ("found", 1), "y d": ("found", 3), "7": ("found", 4), "70": ("found", 7), "doc": ("ambiguous", None), "": ("not found", None),
                   "none": ("not found", None), " docs ": ("found", 2), "99": ("not found", None)}
    plan = fleet.resolve(own, spark.createDataFrame([("a",)], "reference string"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_intermediate_tables_go_when_they_are_forgotten(spark, tmp_path):
    from lodestone.sources import scratch

    scratch.forget(spark)
    one, two = scratch.keep(spark.range(5), "one"), scratch.keep(spark.range(7), "two")
    one.write.parquet(f"{tmp_path}/result")
    assert two.count() == 7 and scratch.forget(spark) == 2 and scratch.forget(spark) == 0
    assert spark.read.parquet(f"{tmp_path}/result").count() == 5
