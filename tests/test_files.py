import json
import sqlite3

import pytest

from tmengine.sources import files, sinks


def write(path, text, mode="w", **kw):
    with open(path, mode, **kw) as f:
        f.write(text)
    return str(path)


def test_corpus_csv_and_json(spark, tmp_path):
    csv = write(tmp_path / "c.csv", "﻿ Source ,译文,状态\n a ,b,Done\nnan,x,\n\"q,\n1\",z,\n")
    assert sorted((r.source, r.target, r.status) for r in files.read_corpus(spark, csv).collect()) == [("a", "b", "Done"), ("q,\n1", "z", None)]
    data = [{"SRC": "a", "src": " ", "tgt": "b"}, {"zh": "x"}, 5, "text", {"原文": "c", "en": 7}]
    path = write(tmp_path / "c.json", json.dumps(data, ensure_ascii=False))
    assert sorted((r.source, r.target) for r in files.read_corpus(spark, path).collect()) == [("a", "b"), ("c", "7")]
    with pytest.raises(ValueError):
        files.read_corpus(spark, write(tmp_path / "one.csv", "only\nx\n"))


def test_positional_columns(spark, tmp_path):
    path = write(tmp_path / "p.csv", "foo,bar\n1,2\n")
    assert [(r.source, r.target) for r in files.read_corpus(spark, path).collect()] == [("1", "2")]


def test_glossary_with_items(spark, tmp_path):
    path = write(tmp_path / "g.json", json.dumps({"items": [{"source": "a", "target": "b", "category": "k"}, {"source": "", "target": "x"}, [1]]}))
    assert [(r.source, r.target, r.category, r.notes) for r in files.read_glossary(spark, path).collect()] == [("a", "b", "k", None)]


def test_texts(spark, tmp_path):
    txt = write(tmp_path / "t.txt", "﻿one\r\n\r\n  two \n")
    assert [r.source for r in files.read_texts(spark, txt).orderBy("row_id").collect()] == ["one", "two"]
    csv = write(tmp_path / "t.csv", "id,说话人,time,原文,类型\nd1,Bob,1.5,hi,任务\nd1,,x,yo,\n")
    got = [(r.source, r.content_type, r.dialog_id, r.speaker, r.time) for r in files.read_texts(spark, csv).orderBy("row_id").collect()]
    assert got == [("hi", "任务", "d1", "Bob", 1.5), ("yo", None, "d1", None, None)]
    mixed = write(tmp_path / "t.json", json.dumps(["plain", {"src": "s", "type": "剧情"}, None, 3]))
    assert [(r.source, r.content_type) for r in files.read_texts(spark, mixed).orderBy("row_id").collect()] == [("plain", None), ("s", "剧情")]


def test_memory_exports_and_broken_segments(spark, tmp_path):
    base = sqlite3.connect(tmp_path / "Designer.sdltm")
    base.execute("create table translation_units (source_segment text, target_segment text)")
    seg = "<S><Text><Value>{}</Value></Text></S>".format
    base.executemany("insert into translation_units values (?, ?)", [(seg("a"), seg("b")), (seg(" "), seg("x")), ("<broken", seg("y"))])
    base.commit()
    base.close()
    got = files.read_memory_exports(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("a", "b", "Designer Reviewed", "Designer.sdltm")]


def test_style_guides(spark, tmp_path):
    for project, name, data in (("p1", "b.txt", b"x"), ("p1", "a.md", b"\xef\xbb\xbfrules\r\nmore "), ("p2", "g.txt", b"\xff\xfe"), ("p3", "g.md", b" \n"), ("p4", "g.md", b"x" * ((1 << 20) + 1))):
        (tmp_path / project).mkdir(exist_ok=True)
        write(tmp_path / project / name, data, "wb")
    got = {r.project_id: (r.text, r.error) for r in files.read_style_guides(spark, str(tmp_path)).collect()}
    assert got == {"p1": ("rules\nmore", None), "p2": (None, "not UTF-8"), "p3": (None, "empty"), "p4": (None, "too large")}


def test_export_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None, [], True), (1, "a", "t", [("x",)], None)], "row_id int, source string, target string, terms array<struct<source:string>>, ok boolean")
    sinks.write_csv(rows.coalesce(1), ["source", "target", "terms", "ok"], str(tmp_path / "out"), "row_id")
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*.csv")))
    lines = [x for x in text.splitlines() if "source,target" not in x]
    assert text.startswith("﻿source,target,terms,ok") and len(lines) == 2 and lines[0].startswith("a,t,") and lines[1].endswith(",true")
    root = str(tmp_path / "index")
    assert sinks.read_version(spark, root) is None
    sinks.write_version(spark.createDataFrame([("x", 1), ("y", 2)], "collection string, n int"), root, "collection")
    sinks.reset_collection(spark, root, "x")
    assert [tuple(r) for r in sinks.read_version(spark, root).select("collection", "n").collect()] == [("y", 2)]


def test_pending_files_and_results(spark, tmp_path):
    for name in ("a.csv", "b.csv", "~$c.csv"):
        write(tmp_path / name, "x")
    done = spark.createDataFrame([("a.csv",)], "task_id string")
    assert [r.task_id for r in files.pending_files(spark, str(tmp_path), "*.csv", done).collect()] == ["b.csv"]
    rows = spark.createDataFrame([("t", "u2", 0, "x"), ("t", "u1", 0, "y"), ("s", "u1", 0, "z")], "task_id string, unit_id string, pos int, result string")
    path = str(tmp_path / "results")
    sinks.append_results(rows, path)
    sinks.append_results(rows.limit(1), path)
    assert files.read_job_results(spark, path, "t").count() == 2


def test_segments_are_parsed_once_and_show_what_xpath_finds(spark):
    """One Python stage for both sides and no XPath in the plan; the text is that of ``segment_text``."""
    from pyspark.sql import functions as F

    from tmengine.functions.text import segment_text

    shown = [
        "<S><Text><Value>a</Value>out<b/></Text>tail<Text>own<i>in</i>after</Text></S>", '<x:S xmlns:x="u"><x:Text><x:Value>v<t>w</t>x</x:Value></x:Text></x:S>', "<Text>only &lt;  here</Text>",
        "<S><Text>no<Text><Value>yes</Value></Text><Value>too<Tag>9</Tag></Value></Text><Value>lost</Value></S>", "<S><Text>x<!-- note -->y</Text></S>", "<Value>none</Value>", "<S><Text>a<Text>b<Value>c</Value></Text>d</Text></S>",
    ]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*shown, "<Segment>", None, ""])], "row_id long, xml string")
    got = {r.row_id: r for r in files.checked_segments(rows).withColumn("by_xpath", F.when(F.col("row_id") < len(shown), segment_text(F.col("xml")))).collect()}
    assert [got[i].text for i in range(len(shown))] == [got[i].by_xpath for i in range(len(shown))] and got[0].text == "aowninafter" and got[3].text == "yestoo9"
    assert all(got[i].text is None and got[i].error for i in range(len(shown), len(got))) and got[0].error is None
    deep = "<S>" + "<a>" * 5000 + "<Text>t</Text>" + "</a>" * 5000 + "</S>"
    sides = spark.createDataFrame([("a_cqa.x", deep, shown[0]), ("a_cqa.x", shown[0], "<Text> </Text>"), ("a_cqa.x", "<Segment>", shown[0])], "file string, source_xml string, target_xml string")
    found = files.memory_candidates(sides)
    assert [(r.source, r.target, r.status) for r in found.collect()] == [("t", "aowninafter", "CQA_Done")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "xpath" not in plan and plan.count("MapInPandas") == 1 and "EvalPython" not in plan
