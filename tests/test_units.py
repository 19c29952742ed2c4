from tmengine.operators import units

SEGMENTS = "row_id long, source string, content_type string"
DIALOGS = "row_id long, source string, dialog_id string, time double"


def test_dedup_is_aware_of_types_and_fans_out(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "t"), (3, "a", None), (4, None, None), (5, None, None)], SEGMENTS)
    out = {r.row_id: (r.unique_id, r.n_copies) for r in units.fan_out(rows, units.distinct_segments(rows)).collect()}
    assert out == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 2), 5: (4, 2)}
    assert tuple(units.dedup_saving(rows).first()) == (5, 3, 2, 40.0)


def test_dialogs_in_time_order_with_orphans(spark):
    rows = [(1, "a", "d1", 2.0), (2, "b", "d2", None), (3, "c", "d1", None), (4, "d", " d1 ", 1.0), (5, "e", "solo", 1.0), (6, "f", None, 1.0), (7, "g", " ", None), (8, "h", "d2", None)]
    got = {r.row_id: (r.kind, r.pos) for r in units.dialog_members(spark.createDataFrame(rows, DIALOGS)).collect()}
    assert got == {3: ("dialog", 0), 4: ("dialog", 1), 1: ("dialog", 2), 2: ("dialog", 0), 8: ("dialog", 1), 5: ("single", 0), 6: ("single", 0), 7: ("single", 0)}


def test_chunks_are_gapless(spark):
    got = units.single_units(spark.range(0, 230, 2).withColumnRenamed("id", "row_id").repartition(7), 50).orderBy("row_id").collect()
    assert [(r.unit_id, r.pos) for r in got] == [(f"single-{i // 50}", i % 50) for i in range(115)]


def test_resume_and_progress(spark):
    u = spark.createDataFrame([("a", 2), ("b", 3)], "unit_id string, n_members int")
    done = spark.createDataFrame([("a",), ("a",)], "unit_id string")
    assert [r.unit_id for r in units.pending(u, done).collect()] == ["b"]
    assert tuple(units.progress(u, done).first()) == (5, 2, 2, 1, 40.0, "running")
    assert units.progress(u, u).first()["status"] == "completed"


def test_offsets_context_types_and_merge(spark):
    chunks = spark.createDataFrame([(0, 10), (10, 20), (20, 25)], "start long, stop long")
    assert tuple(units.contiguous_offset(chunks, chunks.where("start <> 10")).first()) == (10, 15)
    assert tuple(units.contiguous_offset(chunks, chunks).first()) == (25, 25)
    kv = "key string, value string"
    old, new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], kv), spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "9")], kv)
    assert [(r.key, r.stored, r.asked) for r in units.context_difference(old, new).collect()] == [("b", "2", "3")]
    members = spark.createDataFrame([("u", 1, "x"), ("u", 0, None), ("u", 2, "y"), ("v", 0, None)], "unit_id string, pos int, content_type string")
    assert {r.unit_id: r.content_type for r in units.unit_types(members).collect()} == {"u": "x", "v": None}
    a, b = spark.createDataFrame([(1, "direct")], "row_id long, t string"), spark.createDataFrame([(1, "x"), (2, "y")], "row_id long, t string")
    assert sorted(map(tuple, units.merge_direct(a, b).collect())) == [(1, "direct"), (2, "y")]
