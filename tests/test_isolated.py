import pytest

from tmengine.sources import files, isolated, sinks


def test_a_broken_file_does_not_stop_the_rest(spark, tmp_path):
    said = {
        "good.csv": "first,second,Status\n a ,x,Done\n,y,\nb,nan,\nc,z,\n", "canon.csv": "id,译文,原文\n1,t,s\n", "list.json": '[{"k": "j", "v": "w", "级别": "CQA_Done"}, 5]',
        "empty.csv": "", "head.csv": "a,b\n", "one.csv": "only\nx\n", "broken.json": '{"items": ', "quote.csv": 'a,b\n"open,1\n', "~$good.csv": "a,b\n1,2\n", "done.csv": "a,b\nq,r\n",
    }
    for name, text in said.items():
        (tmp_path / name).write_text(text, encoding="utf-8-sig" if name == "canon.csv" else "utf-8")
    (tmp_path / "bytes.csv").write_bytes(b"a,b\n\xff\xfe,1\n")
    rows, outcomes = isolated.corpora(spark, str(tmp_path), "*.*", spark.createDataFrame([("done.csv",)], "task_id string"))
    assert sorted((r.file.rsplit("/", 1)[1], r.source, r.target, r.status) for r in rows.collect()) == [("canon.csv", "s", "t", None), ("good.csv", "a", "x", "Done"), ("good.csv", "c", "z", None), ("list.json", "j", "w", "CQA_Done")]
    got = {r.file.rsplit("/", 1)[1]: (r.outcome, r.n_rows, r.n_blank) for r in outcomes.collect()}
    assert got == {
        "good.csv": ("ok", 2, 2), "canon.csv": ("ok", 1, 0), "list.json": ("ok", 1, 0), "empty.csv": ("skipped", 0, 0), "head.csv": ("skipped", 0, 0), "done.csv": ("skipped", 0, 0),
        "one.csv": ("failed", 0, 0), "broken.json": ("failed", 0, 0), "quote.csv": ("failed", 0, 0), "bytes.csv": ("failed", 0, 0),
    }


def test_a_project_replaces_its_own_glossary_at_once(spark, tmp_path):
    root = str(tmp_path / "g")
    terms = lambda *s: spark.createDataFrame([(x, x.upper(), None) for x in s], "source string, target string, category string")
    sinks.replace_glossary(terms("a", "b"), root, "p")
    sinks.replace_glossary(terms("c"), root, "q")
    sinks.replace_glossary(terms("d"), root, "p")
    assert sorted((r.project_id, r.source) for r in sinks.read_version(spark, root).collect()) == [("p", "d"), ("q", "c")]
    broken = terms("x").selectExpr("source", "cast(raise_error('torn') as string) as target", "'c' as category")
    with pytest.raises(Exception, match="torn"):
        sinks.replace_glossary(broken, root, "p")
    assert sorted((r.project_id, r.source) for r in sinks.read_version(spark, root).collect()) == [("p", "d"), ("q", "c")]


def test_reading_a_broken_export_alone_is_an_error(spark, tmp_path):
    (tmp_path / "x.sdltm").write_bytes(b"nothing")
    rows, failed = files.isolated_exports(spark, str(tmp_path))
    assert rows.count() == 0 and failed.count() == 1
