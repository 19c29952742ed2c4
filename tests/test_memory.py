import uuid

import pytest
from pyspark.sql import functions as F

from tmengine.operators import memory

SPACE = uuid.UUID(int=7)
TM = "row_id long, source string, target string, status string"


def test_best_status_wins_and_the_first_of_equals(spark):
    rows = [(1, "a", "x", "Done"), (2, "a", "x", "CQA_Done"), (3, "a", "x", "CQA_Done"), (4, "a", "y", None), (5, "b", "x", "weird")]
    got = {(r.source, r.target): (r.row_id, r.rank, r.n_rows) for r in memory.best_by_pair(spark.createDataFrame(rows, TM)).collect()}
    assert got == {("a", "x"): (2, 2, 3), ("a", "y"): (4, 99, 1), ("b", "x"): (5, 99, 1)}


def test_exact_matches(spark):
    tm = spark.createDataFrame([(1, " a ", "x", "Done"), (2, "a", "y", "CQA_Done"), (3, "a", "y ", None), (4, "long a text", "z", "Done"), (5, "", "e", "Done")], TM)
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, None), (5, "a")], "row_id long, source string")
    got = {r.row_id: (r.target, r.is_exact, r.score) for r in memory.exact_matches(asked, tm).collect()}
    assert got == {1: ("y", True, 1.0), 2: (None, False, None), 3: (None, False, None), 4: (None, False, None), 5: ("y", True, 1.0)}
    assert sorted((r.nth, r.target) for r in memory.exact_matches(asked.where("row_id = 1"), tm, 5).collect()) == [(1, "y"), (2, "x")]


def test_plan_and_application_are_idempotent(spark):
    stored = spark.createDataFrame([("p1", "a", "x", "Done"), ("p2", "a", "x", "Draft"), ("p3", "b", "x", "CQA_Done"), ("p4", "c", "x", "Done")], "pair_id string, source string, target string, status string")
    incoming = spark.createDataFrame([(1, "a", "x", "CQA_Done"), (2, "b", "x", "CQA_Done"), (3, "c", "x", None), (4, "d", "x", "Done"), (5, "d", "x", "Done")], TM)
    plan = memory.import_plan(incoming, stored)
    got = {r.source: (r.action, r.reuse_id, r.obsolete_ids) for r in plan.collect()}
    assert got == {"a": ("clone", "p1", ["p1", "p2"]), "b": ("skip", None, None), "c": ("skip", None, None), "d": ("embed", None, None)}
    assert memory.plan_summary(plan).first().asDict() == {"candidates": 5, "unique_pairs": 4, "duplicates": 1, "skipped": 2, "new": 1, "new_sources": 1, "upgraded": 1}
    index = memory.apply_plan(plan, stored, SPACE)
    rows = {(r.source, r.status) for r in index.collect()}
    assert rows == {("a", "CQA_Done"), ("b", "CQA_Done"), ("c", "Done"), ("d", "Done")}
    again = memory.import_plan(incoming, index)
    assert {r.action for r in again.collect()} == {"skip"}
    assert memory.apply_plan(again, index, SPACE).count() == 4


def test_upsert_replaces_and_drops_blank_sides(spark):
    old = spark.createDataFrame([("p1", "a", "x", "Done")], "pair_id string, source string, target string, status string")
    new = spark.createDataFrame([("p1", "a", "x2", "Done"), ("p2", "", "y", None), ("p3", "c", None, None), ("p4", "d", "z", None)], old.schema)
    assert sorted((r.pair_id, r.target) for r in memory.upsert(old, new).collect()) == [("p1", "x2"), ("p4", "z")]


def test_vectors_are_reused_and_sources_embedded_once(spark):
    plan = spark.createDataFrame([("a", "x", "Done", "clone", "p1"), ("b", "x", "Done", "clone", "p9"), ("c", "x", "Done", "embed", None)], "source string, target string, status string, action string, reuse_id string")
    index = spark.createDataFrame([("p1", [1.0])], "pair_id string, dense array<float>")
    assert sorted((r.source, r.missing) for r in memory.reused_vectors(plan, index).collect()) == [("a", False), ("b", True)]
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "source string, n int")
    asked = []

    def embed(d):
        asked.append(d.count())
        return d.selectExpr("source", "array(1.0) as dense")

    assert memory.vectors_for_sources(rows, embed).count() == 3 and asked == [2]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], TM)
    assert memory.best_by_pair(empty).count() == 0
    assert memory.plan_summary(memory.import_plan(empty, spark.createDataFrame([], "pair_id string, source string, target string, status string"))).first()["candidates"] == 0


def test_upgraded_points_keep_vector_and_collection(spark):
    columns = "pair_id string, source string, target string, status string, context string, priority_rank int, source_tm string, dense array<float>, collection string"
    stored = spark.createDataFrame([("p1", "a", "x", "Done", "ctx", 4, "old.tm", [1.0], "c1"), ("p2", "a", "x", "Draft", None, 99, None, [5.0], "c2"), ("p3", "b", "y", "CQA_Done", None, 2, "b.tm", [2.0], "c1")], columns)
    incoming = spark.createDataFrame([(1, "a", "x", "CQA_Done", "n.tm"), (2, "b", "y", "Done", "n.tm"), (3, "d", "z", None, "n.tm")], TM + ", source_file string")
    plan = memory.import_plan(incoming, stored)
    rows = {r.source: r for r in memory.apply_plan(plan, stored, SPACE, collection="c9").collect()}
    a = rows["a"]
    assert (a.status, a.context, a.priority_rank, a.source_tm, a.dense, a.collection) == ("CQA_Done", "ctx", 2, "n.tm", [1.0], "c1")
    assert (rows["b"].pair_id, rows["b"].dense, rows["d"].dense, rows["d"].collection) == ("p3", [2.0], None, "c9")
    gone = stored.withColumn("dense", F.when(F.col("pair_id") != "p1", F.col("dense")))
    assert {r.source: r.dense for r in memory.apply_plan(plan, gone, SPACE).collect()} == {"a": None, "b": [2.0], "d": None}
    with pytest.raises(Exception, match="no stored vector"):
        memory.apply_plan(plan, gone, SPACE, strict=True).collect()
