import re
import sqlite3
import uuid

import pytest

from tmengine.operators import enrich, infer
from tmengine.plans import index, jobs
from tmengine.sources import files, sinks
from tmengine.streaming import ingest

TM = "row_id long, source string, target string, status string"
GLOSSARY = "row_id long, source string, target string, category string"


def model(message):
    """Answers every numbered source line in capitals; refuses what holds 'refuse'."""
    if "refuse" in message:
        raise RuntimeError("refused")
    lines = re.findall(r"^(\d+)\. (?:\[[^\]]*\] )?(.*)$", message.split("## Source")[1], re.M)
    return "\n".join(f"{n}. {s.upper()}" for n, s in lines)


def test_translate_segments(spark):
    texts = ["go to hall 1 now", "go to hall 2 now", "go to hall 3 now", "known text", "known text", "lonely words", "", None, "refuse this", "go to hall 1 now"]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "row_id long, source string, content_type string")
    tm = spark.createDataFrame([(1, "known text", "texte", "Done"), (2, "other", "autre", "Done")], TM)
    terms = spark.createDataFrame([(1, "hall", "salle", None)], GLOSSARY)
    got = {r.row_id: r for r in jobs.translate(rows, tm, terms, model).collect()}
    assert len(got) == 10
    assert got[0].translation == "GO TO HALL 1 NOW" == got[9].translation and got[2].translation == "GO TO HALL 3 NOW"
    assert got[3].translation == got[4].translation == "texte" and got[3].tm_exact and not got[0].tm_exact
    assert got[6].error == got[7].error == "empty source" and got[5].translation == "LONELY WORDS"
    assert "refused" in got[8].error and got[8].translation is None


def test_translate_dialogs(spark):
    rows = spark.createDataFrame([(1, "hello", None, "d", "Ann", 2.0), (2, "bye", None, "d", "Bob", None), (3, "alone", None, None, None, None)], "row_id long, source string, content_type string, dialog_id string, speaker string, time double")
    none = spark.createDataFrame([], TM)
    got = {r.row_id: r.translation for r in jobs.translate(rows, none, spark.createDataFrame([], GLOSSARY), model, dialogs=True).collect()}
    assert got == {1: "HELLO", 2: "BYE", 3: "ALONE"}


def test_a_failed_dialog_is_an_error_as_a_whole(spark):
    members = spark.createDataFrame([("a", 0, 1, "x"), ("a", 1, 2, "y"), ("b", 0, 3, "z"), ("c", 0, 4, "v"), ("d", 0, 5, None)], "unit_id string, pos int, row_id long, source string")
    said = spark.createDataFrame([("a", 2, "1. only", None), ("b", 1, None, "Timeout: t"), ("c", 1, "7. good", None)], "unit_id string, expected int, raw string, error string")
    got = {r.row_id: (r.translation, r.status, r.error) for r in infer.dialog_results(members, said).collect()}
    lines = "the answer does not have the expected lines"
    assert got == {
        1: ("[ERROR: DIALOG_PARSE_FAIL] x", "error", lines), 2: ("[ERROR: DIALOG_PARSE_FAIL] y", "error", lines), 3: ("[ERROR: DIALOG_LLM_FAIL] z", "error", "Timeout: t"),
        4: ("good", "success", None), 5: ("[ERROR: DIALOG_PARSE_FAIL] ", "error", lines),
    }
    rows = [(1, "refuse me", None, "d", "Ann", 2.0), (2, "bye", None, "d", "Bob", None), (3, "alone", None, None, None, None)]
    df = spark.createDataFrame(rows, "row_id long, source string, content_type string, dialog_id string, speaker string, time double")
    got = {r.row_id: r for r in jobs.translate(df, spark.createDataFrame([], TM), spark.createDataFrame([], GLOSSARY), model, dialogs=True).collect()}
    assert got[1].translation == "[ERROR: DIALOG_LLM_FAIL] refuse me" and got[2].translation == "[ERROR: DIALOG_LLM_FAIL] bye" and "refused" in got[2].error
    assert got[3].translation == "ALONE" and got[3].error is None


def test_import_keeps_columns_and_vectors(spark):
    index = spark.createDataFrame(
        [("p1", "a", "x", "Done", "ctx", [1.0]), ("p2", " b ", "x", "CQA_Done", "kept", [2.0]), ("p3", "c", "x", "Draft", None, None)],
        "pair_id string, source string, target string, status string, context string, dense array<double>",
    )
    incoming = [(1, "a", "x", "CQA_Done", "new"), (2, "b", "x", "Done", None), (3, "c", "x", "Done", None), (4, "d", "x", "Done", None), (5, "d", "y", "Done", None)]
    asked = []

    def embed(sources):
        asked.append(sorted(r.source for r in sources.collect()))
        return sources.selectExpr("source", "array(9.0D) as dense")

    rows = spark.createDataFrame(incoming, "row_id long, source string, target string, status string, context string")
    summary, made = jobs.import_memory(rows, index, uuid.UUID(int=1), embed=embed)
    got = {(r.source, r.target): (r.status, r.context, r.dense) for r in made.collect()}
    assert got == {
        ("a", "x"): ("CQA_Done", "new", [1.0]), (" b ", "x"): ("CQA_Done", "kept", [2.0]), ("c", "x"): ("Done", None, [9.0]),
        ("d", "x"): ("Done", None, [9.0]), ("d", "y"): ("Done", None, [9.0]),
    }
    assert asked == [["c", "d"]] and summary.first()["upgraded"] == 2 and made.columns[0] == "pair_id"


def test_enrichment_only_if_asked(spark):
    asked = spark.createDataFrame([("u1", "q", 0, 0, None)], "unit_id string, query string, term_count int, sparse_hits int, dense_top1 double")
    cache = spark.createDataFrame([], enrich.CACHE)
    calls = lambda q: 1 / 0
    for refs, filled in (jobs.enrich_weak_units(asked, cache, calls, asked=False), jobs.enrich_weak_units(asked, cache, None)):
        assert refs.count() == 0 and filled.count() == 0


def test_resuming_with_another_context_is_refused(spark, tmp_path):
    units_in, results, seen = str(tmp_path / "u"), str(tmp_path / "r"), str(tmp_path / "m")
    spark.createDataFrame([("u1", "m")], "unit_id string, message string").write.parquet(units_in)
    answer = lambda df: df.selectExpr("unit_id", "message as raw", "cast(null as string) as error")
    run = lambda context: ingest.run_units(spark, units_in, results, seen, "t", answer, context).awaitTermination()
    run({"project": "one"})
    run({"project": "one"})
    with pytest.raises(ValueError, match="project"):
        run({"project": "two"})
    assert [(r.unit_id, r.pos, r.raw) for r in files.read_job_results(spark, results, "t").collect()] == [("u1", 0, "m")]


def test_latest_good_result_wins(spark):
    rows = [("t", "u", 0, "bad", "E", 3), ("t", "u", 0, "old", None, 1), ("t", "u", 0, "new", None, 2), ("t", "v", 0, "x", "E", 1), ("t", "v", 0, "y", "F", 2)]
    df = spark.createDataFrame(rows, "task_id string, unit_id string, pos int, raw string, error string, saved_at int")
    assert sorted((r.unit_id, r.raw) for r in files.latest_results(df).collect()) == [("u", "new"), ("v", "y")]


def test_dry_import_and_enrichment(spark):
    incoming = spark.createDataFrame([(1, "a", "x", "Done")], TM)
    index = spark.createDataFrame([], "pair_id string, source string, target string, status string")
    summary, made = jobs.import_memory(incoming, index, uuid.UUID(int=1), commit=False)
    assert summary.first()["new"] == 1 and made is None
    body = '{"data": {"webPages": {"value": [{"name": "n", "url": "u", "snippet": "s"}]}}}'
    asked = spark.createDataFrame([("u1", "Q ", 0, 0, None), ("u2", "q", 0, 0, 0.1), ("u3", "z", 1, 0, None)], "unit_id string, query string, term_count int, sparse_hits int, dense_top1 double")
    cache = spark.createDataFrame([], "key string, results string")
    refs, filled = jobs.enrich_weak_units(asked, cache, lambda q: body)
    assert sorted(r.unit_id for r in refs.collect()) == ["u1", "u2"] and filled.count() == 1


def test_streams_restart_without_repeating(spark, tmp_path):
    folder, root, mark = (str(tmp_path / n) for n in ("in", "index", "mark"))
    rows = lambda *r: spark.createDataFrame(list(r), "source string, target string, status string").coalesce(1).write.mode("append").parquet(folder)
    rows(("a", "x", "Done"), ("a", "x", "Draft"), ("b", "y", None))
    for _ in range(2):
        ingest.ingest_memory(spark, folder, root, mark, uuid.UUID(int=3)).awaitTermination()
    assert index.points(spark, root).count() == 2
    rows(("a", "x", "CQA_Done"), ("c", "z", "Done"))
    ingest.ingest_memory(spark, folder, root, mark, uuid.UUID(int=3)).awaitTermination()
    assert sorted((r.source, r.status) for r in index.points(spark, root).collect()) == [("a", "CQA_Done"), ("b", None), ("c", "Done")]

    units_in, results, seen = str(tmp_path / "units"), str(tmp_path / "results"), str(tmp_path / "m2")
    put = lambda *u: spark.createDataFrame([(x, "m") for x in u], "unit_id string, message string").coalesce(1).write.mode("append").parquet(units_in)
    answer = lambda df: df.selectExpr("unit_id", "message as raw", "cast(null as string) as error")
    put("u1", "u2", "u1")
    ingest.run_units(spark, units_in, results, seen, "t", answer).awaitTermination()
    put("u2", "u3")
    ingest.run_units(spark, units_in, results, seen, "t", answer).awaitTermination()
    assert sorted(r.unit_id for r in spark.read.parquet(results).collect()) == ["u1", "u2", "u3"]

    asked, cache, m3, calls = str(tmp_path / "asked"), str(tmp_path / "cache"), str(tmp_path / "m3"), lambda q: "{}"
    spark.createDataFrame([("k", "q"), ("k", "q "), ("l", "r")], "key string, query string").write.parquet(asked)
    ingest.fill_cache(spark, asked, cache, m3, calls).awaitTermination()
    assert ingest.cached(spark, cache).count() == 2


MEMBERS = "unit_id string, pos int, row_id long, source string, speaker string, content_type string"


def test_message_sections_in_order(spark):
    members = spark.createDataFrame([("u", 0, 1, "the hall", "Ann", None), ("u", 1, 2, "go", None, "任务"), ("v", 0, 3, "stay", None, None)], MEMBERS)
    seen = spark.createDataFrame([(1, ["hall"]), (2, []), (3, [])], "row_id long, terms array<string>")
    terms = spark.createDataFrame([(1, "hall", "salle", None)], GLOSSARY)
    refs = spark.createDataFrame([(2, 7, "go now", "va", "Done", 0.5, 1)], "query_id long, pair_id long, source string, target string, status string, score double, nth int")
    style = spark.createDataFrame([(None, "be brief"), ("任务", "be bold")], "content_type string, rules string")
    web = spark.createDataFrame([("u", [("t", "s", "u", None, None, None)])], "unit_id string, web array<struct<title:string,snippet:string,url:string,site_name:string,image_url:string,image_analysis:string>>")
    setting = jobs.Setting(header="HEAD", style=style, rules={"functional": "short", "other": "any"}, contract="lines only")
    got = {r.unit_id: r.message for r in jobs.messages(members, seen, terms, refs, 3, setting, web).collect()}
    parts = ["HEAD", "## Style\n\nbe brief\n\nbe bold", "## Rules\n\nshort", "## Terms\n\n", "## References\n\n1. [score=0.500]", "## Web\n\n1. ", "## Source\n\n1. [Ann] the hall\n2. go", "## Output\n\nlines only"]
    at = [got["u"].index(p) for p in parts]
    assert at == sorted(at)
    assert got["v"] == "HEAD\n\n## Style\n\nbe brief\n\n## Rules\n\nany\n\n## Source\n\n1. stay\n\n## Output\n\nlines only"


def test_translate_with_everything(spark, tmp_path):
    """Dense references, collection, web references of weak units, failing units asked again, results and progress."""
    texts = ["go to hall 1 now", "go to hall 2 now", "zzz qqq", "known text", "refuse this one", ""]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "row_id long, source string, content_type string")
    tm = spark.createDataFrame([(1, "known text", "texte", "Done", [1.0, 0.0], "a"), (2, "far away", "loin", "Done", [0.0, 1.0], "a"), (3, "go to hall 1 now", "no", "Done", [0.0, 1.0], "b")], TM + ", dense array<double>, collection string")
    terms = spark.createDataFrame([(1, "hall", "salle", None)], GLOSSARY)
    embed = lambda s: s.selectExpr("source", "case when source like '%hall%' then array(0.1D, 1.0D) else array(-1.0D, 0.1D) end as dense")
    page = lambda q: '{"data": {"webPages": {"value": [{"name": "page on %s", "url": "u", "snippet": "s"}]}}}' % q

    def said(message):
        if "refuse" in message:
            raise RuntimeError("refused")
        lines = re.findall(r"^(\d+)\. (.*)$", message.split("## Source")[1].split("## Output")[0], re.M)
        extra = ("+loin" if "loin" in message else "") + ("+web" if "page on" in message else "") + ("+no" if '"no"' in message else "")
        return "\n".join(f"{n}. {s.upper()}{extra}" for n, s in lines)

    setting = jobs.Setting(collection="a", embed=embed, web=True, fetch=page, contract="as asked", results=str(tmp_path / "r"), task_id="t", workers=2)
    got = {r.row_id: r for r in jobs.translate(rows, tm, terms, said, setting=setting).collect()}
    assert got[0].translation == "GO TO HALL 1 NOW+loin" and got[1].translation == "GO TO HALL 2 NOW+loin" and not got[0].tm_exact
    assert got[2].translation == "ZZZ QQQ+web" and got[3].translation == "texte"
    assert "refused" in got[4].error and got[5].error == "empty source"
    done = jobs.saved_progress(spark, setting).first()
    assert (done["total"], done["status"]) == (5, "running") and done["completed"] < 5


def test_a_dialog_with_a_blank_member_goes_row_by_row(spark):
    schema = "row_id long, source string, content_type string, dialog_id string, speaker string, time double"
    rows = spark.createDataFrame([(1, "refuse", None, "d", "Ann", 1.0), (2, " ", None, "d", "Bob", 2.0), (3, "fine", None, "d", None, 3.0), (4, "x", None, "e", None, 1.0), (5, "refuse y", None, "e", None, 2.0)], schema)
    got = {r.row_id: r for r in jobs.translate(rows, spark.createDataFrame([], TM), spark.createDataFrame([], GLOSSARY), model, dialogs=True).collect()}
    assert got[3].translation == "FINE" and got[2].error == "empty source" and "refused" in got[1].error and got[1].translation is None
    assert got[4].translation == "[ERROR: DIALOG_LLM_FAIL] x"
    with pytest.raises(ValueError, match="no row has a dialog id"):
        jobs.translate(rows.withColumn("dialog_id", rows["content_type"]), spark.createDataFrame([], TM), spark.createDataFrame([], GLOSSARY), model, dialogs=True)


def test_a_folder_of_exports_becomes_an_index(spark, tmp_path):
    segment = lambda t: f"<Segment><Elements><Text><Value>{t}</Value></Text></Elements></Segment>"
    for name, pairs in {"a_cqa.sdltm": [("s1", "t1"), ("s2", "t2")], "memo.sdltm": [("s1", "t1")], "b_designer.sdltm": [("s2", "t2"), ("", "t")]}.items():
        base = sqlite3.connect(tmp_path / name)
        base.execute("create table translation_units (source_segment text, target_segment text)")
        base.executemany("insert into translation_units values (?, ?)", [(segment(a), segment(b)) for a, b in pairs])
        base.commit()
        base.close()
    (tmp_path / "broken_cqa.sdltm").write_bytes(b"no database at all")
    folder, root = str(tmp_path), str(tmp_path / "index")
    summary, counts, failed = jobs.import_folder(spark, folder, root, uuid.UUID(int=2), commit=False)
    assert index.points(spark, root) is None and summary.first()["new"] == 2
    jobs.import_folder(spark, folder, root, uuid.UUID(int=2), collection="main")
    assert sorted((r.source, r.status, r.source_tm, r.collection) for r in index.points(spark, root).collect()) == [("s1", "CQA_Done", "a_cqa.sdltm", "main"), ("s2", "Designer Reviewed", "b_designer.sdltm", "main")]
    assert {r.source_file: (r.candidates, r.unknown_status) for r in counts.collect()} == {"a_cqa.sdltm": (2, 0), "b_designer.sdltm": (1, 0), "memo.sdltm": (1, 1)}
    assert [r.file.rsplit("/", 1)[1] for r in failed.collect()] == ["broken_cqa.sdltm"]
    assert jobs.import_folder(spark, folder, root, uuid.UUID(int=2))[0].first()["skipped"] == 2
