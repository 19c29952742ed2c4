from pyspark.sql import functions as F

from tmengine.operators import infer, render

OUT = "unit_id string, expected int, raw string"


def test_numbered_outputs(spark):
    raw = [
        ("ok", 2, '1. {"translation": "A", "reason": "r"}\n\n2) plain'), ("wide", 3, "1、a\n2：b\n3。c"), ("missing", 3, "1. a\n3. c"), ("offset", 2, "7. a\n8. b"),
        ("repeat", 2, "1. a\n1. b\n2. c"), ("none", 1, "no number"), ("null", 1, None),
    ]
    got = {}
    for r in infer.parse_numbered(spark.createDataFrame(raw, OUT)).collect():
        got.setdefault(r.unit_id, {})[r.pos] = (r.translation, r.reason)
    assert got == {"ok": {1: ("A", "r"), 2: ("plain", None)}, "wide": {1: ("a", None), 2: ("b", None), 3: ("c", None)}, "repeat": {1: ("a", None), 2: ("c", None)}}
    got = {}
    for r in infer.parse_positional(spark.createDataFrame(raw, OUT)).collect():
        got.setdefault(r.unit_id, []).append((r.pos, r.translation))
    assert sorted(got["offset"]) == [(1, "a"), (2, "b")] and "repeat" not in got and set(got) == {"ok", "wide", "offset"}


def test_a_failing_row_fails_alone(spark):
    def model(message):
        if message == "bad":
            raise ValueError("no")
        return message.upper()

    units = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "y")], "unit_id string, message string").coalesce(1)
    got = {r.unit_id: (r.raw, r.error) for r in infer.answers(units, model).collect()}
    assert got == {"a": ("X", None), "b": (None, "ValueError: no"), "c": ("Y", None)}


def test_classification_uses_hints_first(spark):
    rows = spark.createDataFrame([("s1", "任务"), ("s2", None), ("s2", "odd"), ("s3", None)], "source string, content_type string")
    got = sorted((r.source, r.content_type) for r in infer.classified(rows, lambda t: "剧情!" if t == "s2" else "?").collect())
    assert got == [("s1", "任务"), ("s2", "剧情"), ("s2", "剧情"), ("s3", "未知")]


def test_embedding_is_cut_and_normalised(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "source string")
    got = {r.source: r.dense for r in infer.embedded(rows, lambda ts: [[3.0, 4.0, 9.0] for _ in ts], dim=2).collect()}
    assert [round(x, 6) for x in got["a"]] == [0.6, 0.8]


def test_sections(spark):
    terms = "array<struct<source:string,target:string,category:string>>"
    refs = "array<struct<source:string,target:string,score:double,status:string>>"
    df = spark.createDataFrame([([("a", "b", "c"), ("d", "e", None)], [("s", "t", 0.12345, None)], [("hi", " Bob "), ("yo", None)])], f"terms {terms}, refs {refs}, turns array<struct<source:string,speaker:string>>")
    row = df.select(render.term_lines(df.terms).alias("t"), render.reference_lines(df.refs).alias("r"), render.dialog_lines(df.turns).alias("d"), render.term_view(df.terms).alias("tv"), render.reference_view(df.refs).alias("rv")).first()
    assert row.t == '- 「a」（c） → "b"\n- 「d」 → "e"' and row.r == '1. [score=0.123] 「s」 → "t"' and row.d == "1. [Bob] hi\n2. yo"
    assert row.tv == '[{"source":"a","target":"b","category":"c"},{"source":"d","target":"e"}]' and row.rv == '[{"source":"s","target":"t","score":0.1235}]'


def test_calls_keep_order_and_a_hanging_one_fails_alone():
    import threading
    import time

    at_once, most, lock = 0, 0, threading.Lock()

    def model(said):
        nonlocal at_once, most
        with lock:
            at_once += 1
            most = max(most, at_once)
        time.sleep(30 if said == "hang" else 0.02 * (5 - int(said) % 5))
        with lock:
            at_once -= 1
        if said == "7":
            raise ValueError("seven")
        return said * 2

    said = [str(i) for i in range(20)] + ["hang", "21"]
    began = time.time()
    got = infer.called(said, model, workers=4, timeout=0.5, retries=1, pause=0.01)
    assert time.time() - began < 10 and 2 <= most <= 6
    assert [g[0] for g in got] == [None if s in ("7", "hang") else s * 2 for s in said]
    assert got[7][1] == "ValueError: seven" and got[20][1].startswith("TimeoutError")


def test_a_failing_call_is_tried_again_after_a_growing_pause():
    import time

    seen = []

    def model(said):
        seen.append(time.time())
        if len(seen) < 3:
            raise OSError("busy")
        return "done"

    assert infer.called(["x"], model, retries=2, pause=0.1) == [("done", None)]
    assert seen[1] - seen[0] >= 0.1 and seen[2] - seen[1] >= 0.2


def test_pooled_answers_and_unguided_types(spark):
    units = spark.createDataFrame([(str(i), f"m{i}") for i in range(30)], "unit_id string, message string")
    got = {r.unit_id: r.raw for r in infer.answers(units, lambda m: m.upper(), workers=5, timeout=5.0).collect()}
    assert got == {str(i): f"M{i}" for i in range(30)}
    rows = spark.createDataFrame([("a", None), ("b", "任务")], "source string, content_type string")
    calls = lambda text: 1 / 0
    assert {r.source: r.content_type for r in infer.classified(rows, calls, guided=False).collect()} == {"a": "未知", "b": "任务"}
    echo = lambda text: "剧情" if text.endswith("T: a") else "?"
    assert {r.source: r.content_type for r in infer.classified(rows, echo, lambda c: F.concat(F.lit("T: "), c)).collect()} == {"a": "剧情", "b": "任务"}
