import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import fleet, lifecycle, selection, stores
from lodestone.sources.spread import spread

CANDIDATE = "candidate_id long, document_id string, state string, reasons array<struct<detector:string,code:string,detail:string,confidence:float,evidence:string>>, stage_expires_at timestamp, created_at timestamp"


def candidates(spark):
    rows = [(1, "a", "candidate", [("thin", "thin_content", "", 0.5, None)], None, None), (2, "b", "staged", [], None, None), (3, "c", "deleted", None, None, None)]
    return spark.createDataFrame(rows, CANDIDATE)


def test_selections_are_named_or_filtered_and_confirmed(spark):
    c = candidates(spark)
    for wrong in ({}, {"ids": []}, {"ids": [1], "states": ("staged",)}, {"states": ("deleted",), "allowed": ("candidate", "staged")}):
        with pytest.raises(ValueError):
            selection.resolve(c, **wrong)
    rows = selection.resolve(c, states=("staged",), allowed=("candidate", "staged"))
    assert [r["candidate_id"] for r in rows.collect()] == [2]
    assert selection.confirmed(rows, 1).count() == 1 and selection.confirmed(rows, None, required=False).count() == 1
    with pytest.raises(selection.Drift):
        selection.confirmed(rows, 2)
    with pytest.raises(ValueError):
        selection.confirmed(rows, None)


def test_one_command_of_several_counts_whatever_the_order(spark):
    commands = [(1, "stage", 2), (1, "dismiss", 1), (2, "restore", 1), (2, "stage", 1)]
    for turn in (commands, commands[::-1]):
        df = spark.createDataFrame(turn, "candidate_id long, command string, seq int").repartition(3)
        _, out = lifecycle.transition(candidates(spark), df, "2024-01-31")
        assert sorted((r["candidate_id"], r["command"]) for r in out.collect()) == [(1, "dismiss"), (2, "restore")]


def test_restored_rows_lack_and_exceed_the_schema(spark):
    table = spark.createDataFrame([("x", 1)], "id string, n int")
    back = spark.createDataFrame([("y", '{"id": "y", "more": 3}'), ("x", '{"id": "x", "n": 9}'), ("z", '{"id": "z", "n": 4}')], "key string, row string")
    assert sorted(map(tuple, selection.restore(table, back, "id").collect())) == [("x", 1), ("y", None), ("z", 4)]


def test_columns_and_sorts_are_checked(spark):
    df = spark.createDataFrame([(1, "n")], "cc_pair_id int, name string")
    assert fleet.columns(df, ["NAME"]).columns == ["name"]
    for f in (lambda: fleet.columns(df, ["nope"]), lambda: fleet.ordered(df, "size")):
        with pytest.raises(ValueError):
            f()


def test_narrations_and_links(spark):
    df = spark.createDataFrame([('{"title": " a ", "summary": "b"}',), ('"{\\"title\\": \\"a\\", \\"summary\\": \\"b\\"}"',), ('{"title": "", "summary": "b"}',), ('{"title": 1, "summary": "b"}',), ("no",), (None,)], "a string")
    assert [r[0] and tuple(r[0]) for r in df.select(tx.narration(F.col("a"))).collect()] == [("a", "b"), ("a", "b"), None, None, None, None]
    assert spark.range(1).select(tx.clamp_words(F.lit("word " * 50), 23)).first()[0] == "word word word word…"
    assert spark.range(1).select(tx.clamp_words(F.lit("x" * 50), 10)).first()[0] == "xxxxxxxxx…"


def test_empty_tables(spark):
    empty = candidates(spark).filter("false")
    pairs = "a string, b string, method string, estimated double, verified double, cosine double, same_connector boolean"
    assert selection.remembered(empty).count() == 0
    assert stores.upsert_pairs(spark.createDataFrame([], pairs), spark.createDataFrame([], pairs)).count() == 0


def test_small_inputs_are_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(0, 1000, 1, 8 * cores + 1)).rdd.getNumPartitions() == 8 * cores + 1
