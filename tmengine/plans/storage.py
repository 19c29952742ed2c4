"""Queries of readers, writers, jobs and streams: the given tables are written in a form, read back and compared."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tmengine.functions import text as fn
from tmengine.operators import infer, render, retrieve, textindex
from tmengine.plans import index, jobs
from tmengine.plans import inputs as src
from tmengine.sources import files, isolated, sinks
from tmengine.streaming import ingest
from tmengine.tables import shared_dir

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RANK = "CASE status WHEN 'Designer Reviewed' THEN 1 WHEN 'CQA_Done' THEN 2 WHEN 'Done_LQA edited' THEN 3 WHEN 'Done' THEN 4 ELSE 99 END"
TM = f"tm AS (SELECT *, {RANK} AS rank FROM (SELECT p_partkey::BIGINT AS row_id, p_name AS source, p_brand || ' ' || p_type AS target, {src.STATUS_SQL} AS status FROM part))"
BEST = f"""{TM}, b AS (SELECT source, target, min(rank) AS rank, first(status ORDER BY rank, row_id) AS status FROM tm GROUP BY source, target),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, target) AS nth FROM b)"""
UUID5 = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr(h, 17, 1))::INT % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


def query(sql: str):
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- readers and writers ------------------------------------------------------------------------------------------


@query("""SELECT trim(p_name) AS source, p_brand || ', "' || p_type || '"' AS target, CASE p_size % 3 WHEN 0 THEN 'Done' WHEN 1 THEN 'Draft' END AS status FROM part WHERE p_size % 9 <> 0 AND p_size % 10 <> 0""")
def corpus_csv(spark, d):
    path = _folder(spark, "corpus")
    target = F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"'))
    rows = src.table(spark, d, "part").select(
        F.when(F.col("p_size") % 9 != 0, F.concat(F.lit("  "), "p_name", F.lit("\n"))).otherwise(" ").alias(" 原文 "), F.when(F.col("p_size") % 10 != 0, target).otherwise("NaN").alias("English"),
        F.expr("CASE p_size % 3 WHEN 0 THEN 'Done' WHEN 1 THEN ' Draft ' END").alias("状态"), F.lit("extra").alias("other"),
    )
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_corpus(spark, path).select("source", "target", "status")


@query("SELECT p_name AS source, CASE WHEN p_size % 2 = 0 THEN p_type END AS content_type, CASE WHEN p_size % 2 = 0 THEN p_size / 2.0::DOUBLE END AS time FROM part")
def texts_json(spark, d):
    path = _folder(spark, "texts") + ".json"
    half = F.format_string("%.1f", F.col("p_size") / 2.0)
    item = F.to_json(F.struct(F.col("p_name").alias("SRC"), F.col("p_type").alias("type"), half.alias("t"), F.lit("x").alias("none")))
    rows = src.table(spark, d, "part").select((F.col("p_partkey") % 16).alias("g"), F.when(F.col("p_size") % 2 == 0, item).otherwise(F.to_json(F.array("p_name")).substr(F.lit(2), F.length("p_name") + 2)).alias("item"))
    each = rows.groupBy("g").agg(F.concat(F.lit('{"items": ['), F.array_join(F.collect_list("item"), ",\n"), F.lit("]}")).alias("value"))  # a file each
    each.write.partitionBy("g").text(path)
    return files.read_texts(spark, path).select("source", "content_type", "time")


@query("SELECT p_partkey || '/' || p_name AS source, p_brand AS target, p_type || ' \"q\"' AS category, p_brand AS notes FROM part")
def glossary_files(spark, d):
    path = _folder(spark, "glossary")
    part = src.table(spark, d, "part")
    rows = part.select(F.concat_ws("/", F.col("p_partkey").cast("string"), "p_name").alias("source"), F.col("p_brand").alias("target"), F.concat("p_type", F.lit(' "q"')).alias("category"), F.col("p_brand").alias("notes"))
    sinks.write_glossary(rows, path, "csv")
    return files.read_glossary(spark, path).select("source", "target", "category", "notes")


@query("SELECT p_partkey::BIGINT AS row_id, 'c' || p_partkey % 3 AS collection, p_name || '!' AS source FROM part WHERE p_partkey % 3 <> 1")
def index_versions(spark, d):
    root = _folder(spark, "index")
    part = src.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("row_id"), F.concat(F.lit("c"), F.col("p_partkey") % 3).alias("collection"), F.col("p_name").alias("source"))
    sinks.write_version(part, root, "collection")
    sinks.write_version(sinks.read_version(spark, root).withColumn("source", F.concat("source", F.lit("!"))), root, "collection")
    sinks.reset_collection(spark, root, "c1")
    return sinks.read_version(spark, root).select("row_id", "collection", "source")


@query("""SELECT DISTINCT l_orderkey::VARCHAR AS unit_id, l_linenumber::INT AS pos, 'second' AS raw, NULL AS error FROM lineitem WHERE l_linenumber <= 3
UNION ALL SELECT DISTINCT l_orderkey::VARCHAR, l_linenumber::INT, NULL, 'E' FROM lineitem WHERE l_linenumber > 3""")
def results_appended(spark, d):
    path = _folder(spark, "results")
    rows = src.table(spark, d, "lineitem").select(F.lit("t1").alias("task_id"), F.col("l_orderkey").cast("string").alias("unit_id"), F.col("l_linenumber").cast("int").alias("pos"))
    none = F.lit(None).cast("string")
    sinks.append_results(rows.select("*", none.alias("raw"), F.lit("E").alias("error"), F.lit(1).alias("saved_at")), path)
    sinks.append_results(rows.where("pos <= 3").select("*", F.lit("second").alias("raw"), none.alias("error"), F.lit(2).alias("saved_at")), path)
    sinks.append_results(rows.select(F.lit("t2").alias("task_id"), "unit_id", "pos", F.lit("other").alias("raw"), none.alias("error"), F.lit(3).alias("saved_at")), path)
    return files.read_job_results(spark, path, "t1").select("unit_id", "pos", "raw", "error")


@query("""SELECT p_name AS source, p_type || ' & more' AS target, CASE p_size % 4 WHEN 0 THEN 'CQA_Done' WHEN 1 THEN 'Done_LQA edited' WHEN 2 THEN 'Draft' ELSE 'Designer Reviewed' END AS status,
CASE p_size % 4 WHEN 0 THEN 'a_cqa.x' WHEN 1 THEN 'LQA.x' WHEN 2 THEN 'memo.x' ELSE 'designer.x' END AS source_file FROM part WHERE p_size % 5 <> 0""")
def memory_segments(spark, d):
    """Segments of memory exports with markup, blank sides and broken XML, as candidates."""
    shaped = lambda c: F.concat(F.lit("<Segment><Elements><Text><Value>"), c, F.lit("</Value></Text><Tag><TagID>1</TagID></Tag></Elements></Segment>"))
    file = F.expr("CASE p_size % 4 WHEN 0 THEN '/cqa/a_cqa.x' WHEN 1 THEN '/x/LQA.x' WHEN 2 THEN '/designer/memo.x' ELSE 'designer.x' END")
    target = F.when(F.col("p_size") % 10 == 0, "<Segment>").otherwise(F.when(F.col("p_size") % 5 == 0, shaped(F.lit(" "))).otherwise(shaped(F.concat("p_type", F.lit(" &amp;  more ")))))
    rows = src.table(spark, d, "part").select(file.alias("file"), shaped(F.concat(F.lit(" "), "p_name")).alias("source_xml"), target.alias("target_xml"))
    return files.memory_candidates(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "Draft")  # a small table's few splits are dealt to all tasks


@query("""SELECT s_name AS project_id, CASE s_suppkey % 5 WHEN 0 THEN 'too large' WHEN 1 THEN 'not UTF-8' WHEN 2 THEN 'empty' END AS error,
CASE WHEN s_suppkey % 5 > 2 THEN md5('Rules of ' || s_name || chr(10) || 'end') END AS text FROM supplier""")
def guide_files(spark, d):
    s = src.table(spark, d, "supplier")
    body = F.concat(F.lit("﻿"), F.lit(" \r\nRules of "), "s_name", F.lit("\r\nend \n"))
    content = F.when(F.col("s_suppkey") % 5 == 1, F.unhex(F.lit("ff41"))).when(F.col("s_suppkey") % 5 == 2, F.encode(F.lit(" \n"), "UTF-8")).otherwise(F.encode(body, "UTF-8"))
    size = F.when(F.col("s_suppkey") % 5 == 0, files.MAX_GUIDE_BYTES + 1).otherwise(F.octet_length(content))
    rows = s.select(F.col("s_name").alias("project_id"), F.lit("/p/guide.md").alias("path"), size.cast("long").alias("length"), content.alias("content"))
    return files.guide_texts(rows).select("project_id", "error", F.md5(F.col("text").cast("binary")).alias("text"))


def _corpus_folder(spark, d) -> str:
    """Customers as forty small corpora, some without rows, with a broken record, or of one column only."""
    path = _folder(spark, "corpora")
    rows = src.table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("g"), F.col("c_custkey").cast("long").alias("k"), "c_name", "c_mktsegment")
    kind = F.col("g") % 5
    line = F.concat("c_name", F.lit(","), F.when(F.col("k") % 7 == 0, " ").otherwise(F.concat("c_mktsegment", F.lit(" "), "k")))
    each = rows.groupBy("g").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))  # a file each
    text = F.when(kind == 1, "name,segment").when(kind == 2, F.concat(F.lit('name,segment\n"open,'), "lines")).when(kind == 3, F.concat(F.lit("name\n"), F.regexp_replace("lines", ",", " ")))
    each.select("g", text.otherwise(F.concat(F.lit("name,segment\n"), "lines")).alias("value")).write.partitionBy("g").text(path)
    return path


@query("""SELECT c_name AS source, c_mktsegment || ' ' || c_custkey AS target FROM customer WHERE c_custkey % 40 % 5 IN (0, 4) AND c_custkey % 7 <> 0""")
def isolated_rows(spark, d):
    """Every row of the readable files of a folder that also holds broken ones."""
    return isolated.corpora(spark, _corpus_folder(spark, d), "*.txt")[0].select("source", "target")


@query("""WITH f AS (SELECT c_custkey % 40 AS g, count(*) AS n, count(*) FILTER (c_custkey % 7 = 0) AS blank FROM customer GROUP BY 1),
o AS (SELECT *, CASE g % 5 WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' ELSE 'ok' END AS outcome FROM f)
SELECT outcome, count(*) AS n_files, sum(CASE WHEN outcome = 'ok' THEN n - blank ELSE 0 END)::BIGINT AS n_rows, sum(CASE WHEN outcome = 'ok' THEN blank ELSE 0 END)::BIGINT AS n_blank FROM o GROUP BY outcome""")
def isolated_totals(spark, d):
    files_ = isolated.corpora(spark, _corpus_folder(spark, d), "*.txt")[1]
    return files_.groupBy("outcome").agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("n_blank").alias("n_blank"))


@query("SELECT p_partkey || '/' || p_name AS source, p_brand AS target, p_type AS category FROM part")
def glossary_json(spark, d):
    path = _folder(spark, "glossary") + ".json"
    item = F.to_json(F.struct(F.concat_ws("/", F.col("p_partkey").cast("string"), "p_name").alias("原文"), F.col("p_brand").alias("English"), F.col("p_type").alias("分类")))
    rows = src.table(spark, d, "part").select((F.col("p_partkey") % 16).alias("g"), item.alias("item"))
    each = rows.groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("item"), ","), F.lit("]")).alias("value"))  # a file each
    each.write.partitionBy("g").text(path)
    return files.read_glossary(spark, path).select("source", "target", "category")


@query("SELECT p_name || ' ' || p_partkey AS source FROM part WHERE p_size % 4 <> 0")
def texts_lines(spark, d):
    path = _folder(spark, "texts") + ".txt"
    src.table(spark, d, "part").select(F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" "), "p_partkey", F.lit("\t")))).write.text(path)
    return files.read_texts(spark, path).select("source")


@query("""SELECT 'c' || c_custkey % 5 AS project_id, c_name AS source, c_mktsegment AS target FROM customer WHERE c_custkey % 5 IN (0, 1) AND c_custkey % 2 = 0 OR c_custkey % 5 = 2""")
def project_glossaries(spark, d):
    """Glossaries of three projects, of which two are replaced by half of theirs."""
    root = _folder(spark, "glossaries")
    c = src.table(spark, d, "customer").select(F.col("c_name").alias("source"), F.col("c_mktsegment").alias("target"), F.lit(None).cast("string").alias("category"), "c_custkey")
    for project in (0, 1, 2):
        sinks.replace_glossary(c.where(F.col("c_custkey") % 5 == project), root, f"c{project}")
    for project in (0, 1):
        sinks.replace_glossary(c.where((F.col("c_custkey") % 5 == project) & (F.col("c_custkey") % 2 == 0)), root, f"c{project}")
    return sinks.read_version(spark, root).select("project_id", "source", "target")


def _named_files(rows, folder: str) -> str:
    """Small text files ``(name, body)``, written by the tasks that hold them."""
    folder = folder.removeprefix("file:")

    def put(batches):
        import os

        for batch in batches:
            for name, body in zip(batch["name"], batch["body"]):
                os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
                with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
                    f.write(body)
            yield batch[["name"]]

    rows.select("name", "body").mapInPandas(put, "name string").write.format("noop").mode("overwrite").save()
    return folder


@query("SELECT 'job' || s_suppkey || '.txt' AS task_id FROM supplier WHERE s_suppkey % 3 <> 0")
def pending_files(spark, d):
    """Job files without a finished task, temporary files aside."""
    s = src.table(spark, d, "supplier")
    each = s.select(F.explode(F.array(F.concat(F.lit("job"), "s_suppkey", F.lit(".txt")), F.concat(F.lit("~$job"), "s_suppkey", F.lit(".txt")))).alias("name"), F.col("s_name").alias("body"))
    done = s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("job"), "s_suppkey", F.lit(".txt")).alias("task_id"))
    return files.pending_files(spark, _named_files(each, _folder(spark, "tasks")), "*.txt", done).select("task_id")


@query("""SELECT 'p' || s_suppkey AS project_id, CASE s_suppkey % 3 WHEN 0 THEN 'md ' WHEN 1 THEN 'markdown ' ELSE 'txt ' END || s_name AS text FROM supplier""")
def guide_folders(spark, d):
    """A folder a project with up to three guides, of which the first kind counts."""
    s = src.table(spark, d, "supplier")
    kinds = F.slice(F.array(F.lit("md"), F.lit("markdown"), F.lit("txt")), (F.col("s_suppkey") % 3 + 1).cast("int"), F.lit(3))
    each = s.withColumn("kind", F.explode(kinds)).select(F.concat(F.lit("p"), "s_suppkey", F.lit("/guide."), "kind").alias("name"), F.concat("kind", F.lit(" "), "s_name", F.lit("\n")).alias("body"))
    return files.read_style_guides(spark, _named_files(each, _folder(spark, "guides"))).select("project_id", "text")


@query("SELECT o_orderkey::BIGINT AS row_id, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def export_order(spark, d):
    """An export of shuffled rows is read back in the rows' own order."""
    path = _folder(spark, "export")
    rows = src.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("row_id"), "o_orderpriority").repartition(7, "o_orderpriority")
    sinks.write_csv(rows, ["row_id", "o_orderpriority"], path, "row_id")
    back = spark.read.csv(path, header=True).select(F.col("row_id").cast("long").alias("row_id"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    per = back.groupBy("file").agg(F.min("row_id").alias("least"), F.min("at").alias("start"), F.count("*").alias("n"))  # a row a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return back.join(F.broadcast(per.select("file", "start", before.alias("before"))), "file").select("row_id", (F.col("before") + F.col("at") - F.col("start") + 1).alias("place"))


# --- models and jobs ----------------------------------------------------------------------------------------------


def capitals(message: str) -> str:
    """A stand-in for a model: answers every numbered source line in capitals."""
    lines = re.findall(r"^(\d+)\. (?:\[[^\]]*\] )?(.*)$", message.split("## Source")[1], re.M)
    return "\n".join(f"{n}. {s.upper()}" for n, s in lines)


@query("""SELECT p_partkey::BIGINT AS row_id, p_name AS source, CASE WHEN p_size % 3 = 0 THEN '任务' WHEN length(p_name) % 2 = 0 THEN 'UI文本' ELSE '未知' END AS content_type FROM part""")
def classified_types(spark, d):
    rows = src.segments(spark, d).withColumn("content_type", F.when(F.col("content_type") == "任务", F.lit(" 任务 ")))
    return infer.classified(rows, lambda text: "a UI文本 text" if len(text) % 2 == 0 else "?").select("row_id", "source", "content_type")


@query("""SELECT source, round(length(source) / sqrt(length(source) * length(source) + 9.0::DOUBLE), 4) AS a, round(3 / sqrt(length(source) * length(source) + 9.0::DOUBLE), 4) AS b FROM (SELECT DISTINCT p_name AS source FROM part)""")
def embedded_sources(spark, d):
    made = infer.embedded(src.segments(spark, d).select("source").distinct(), lambda some: [[float(len(s)), 3.0, 4.0] for s in some], 7, dim=2)
    return made.select("source", F.round(F.col("dense")[0].cast("double"), 4).alias("a"), F.round(F.col("dense")[1].cast("double"), 4).alias("b"))


@query(f"""WITH {BEST}, s AS (SELECT p_partkey::BIGINT AS row_id, CASE WHEN p_size % 5 = 0 THEN p_name || ' x' WHEN p_size % 7 = 0 THEN ' ' ELSE p_name END AS source FROM part)
SELECT row_id, CASE WHEN s.source = ' ' THEN NULL ELSE coalesce(n.target, upper(s.source)) END AS translation, CASE WHEN s.source = ' ' THEN 'empty source' END AS error, n.target IS NOT NULL AS tm_exact
FROM s LEFT JOIN n ON s.source = n.source AND nth = 1""")
def translate_job(spark, d):
    part = src.table(spark, d, "part")
    name = F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit(" x"))).when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_name"))
    rows = part.select(F.col("p_partkey").cast("long").alias("row_id"), name.alias("source"), F.lit(None).cast("string").alias("content_type"))
    terms = part.where("p_size < 5").groupBy(F.col("p_name").alias("source")).agg(F.min(F.col("p_partkey").cast("long")).alias("row_id"), F.min("p_brand").alias("target"), F.lit(None).cast("string").alias("category"))
    return jobs.translate(rows, src.memory(spark, d), terms, capitals).select("row_id", "translation", "error", "tm_exact")


@query("""SELECT p_partkey::VARCHAR AS unit_id, i::INT AS pos, 'page ' || i || ' on ' || lower(p_name) AS title FROM part, (SELECT unnest([0, 1]) AS i)
WHERE p_size % 2 = 0 AND p_size % 3 = 0 AND NOT (p_size % 5 = 0)""")
def enrich_job(spark, d):
    part = src.table(spark, d, "part")
    asked = part.select(
        F.col("p_partkey").cast("string").alias("unit_id"), F.upper("p_name").alias("query"), (F.col("p_size") % 2).cast("int").alias("term_count"), (F.col("p_size") % 3).cast("int").alias("sparse_hits"),
        F.when(F.col("p_size") % 5 == 0, 0.9).when(F.col("p_size") % 5 == 1, 0.1).alias("dense_top1"),
    )
    cache = spark.createDataFrame([], "key string, results string")
    page = lambda q: json.dumps({"data": {"webPages": {"value": [{"name": f"page {i} on {q.lower()}", "url": "u", "snippet": "s"} for i in (0, 1)]}}})
    return jobs.enrich_weak_units(asked, cache, page, 0.5)[0].select("unit_id", "pos", "title")


def _write_exports(rows, folder: str) -> None:
    """Memory exports of ``(file, source, target)``, a database a file; one more that is none."""
    import os
    import sqlite3

    def put(part):
        name = part["file"].iloc[0]
        os.makedirs(folder, exist_ok=True)
        if name.startswith("torn"):
            with open(f"{folder}/{name}", "wb") as f:
                f.write(b"torn off")
        else:
            shaped = lambda t: f"<Segment><Elements><Text><Value>{t}</Value></Text></Elements></Segment>"
            base = sqlite3.connect(f"{folder}/{name}")
            base.execute("drop table if exists translation_units")
            base.execute("create table translation_units (source_segment text, target_segment text)")
            base.executemany("insert into translation_units values (?, ?)", [(shaped(a), shaped(b)) for a, b in zip(part["source"], part["target"])])
            base.commit()
            base.close()
        return part[["file"]].head(1)

    rows.groupBy("file").applyInPandas(put, "file string").write.format("noop").mode("overwrite").save()


EXPORTED = """WITH e AS (SELECT p_name AS source, p_type AS target, CASE p_partkey % 4 WHEN 0 THEN 'a_cqa.sdltm' WHEN 1 THEN 'b_lqa.sdltm' WHEN 2 THEN 'memo.sdltm' ELSE 'torn_cqa.sdltm' END AS file,
CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS rank FROM part),
b AS (SELECT source, target, min(rank) AS rank FROM e WHERE rank IS NOT NULL GROUP BY source, target)"""


def _exports(spark, d) -> str:
    folder = _folder(spark, "exports").removeprefix("file:")
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'a_cqa.sdltm' WHEN 1 THEN 'b_lqa.sdltm' WHEN 2 THEN 'memo.sdltm' ELSE 'torn_cqa.sdltm' END")
    _write_exports(src.table(spark, d, "part").select(name.alias("file"), F.col("p_name").alias("source"), F.col("p_type").alias("target")), folder)
    return folder


@query(EXPORTED + " SELECT source, target, CASE rank WHEN 2 THEN 'CQA_Done' ELSE 'Done_LQA edited' END AS status, CASE rank WHEN 2 THEN 'a_cqa.sdltm' ELSE 'b_lqa.sdltm' END AS source_tm FROM b")
def folder_import(spark, d):
    """A folder of exports, one of them torn off and one of unknown status, made into an index."""
    root = _folder(spark, "index")
    jobs.import_folder(spark, _exports(spark, d), root, NAMESPACE, collection="main")
    return index.points(spark, root).select("source", "target", "status", "source_tm")


@query(EXPORTED + """ SELECT (SELECT count(*) FROM e WHERE rank IS NOT NULL) AS candidates, count(*) AS unique_pairs, (SELECT count(*) FROM e WHERE rank IS NOT NULL) - count(*) AS duplicates,
0::BIGINT AS skipped, count(*) AS new, count(DISTINCT source) AS new_sources, 0::BIGINT AS upgraded, (SELECT count(DISTINCT file) FROM e WHERE file LIKE 'torn%') AS failed FROM b""")
def folder_import_summary(spark, d):
    summary, _, failed = jobs.import_folder(spark, _exports(spark, d), _folder(spark, "index"), NAMESPACE, commit=False)
    return summary.crossJoin(F.broadcast(failed.agg(F.count("*").alias("failed"))))  # one row each


def stubborn(message: str) -> str:
    """A stand-in for a model that fails for some units: a unit whose answer it loses is asked again member by member."""
    lines = re.findall(r"^(\d+)\. (?:\[[^\]]*\] )?(.*)$", message.split("## Source")[1].split("## Output")[0], re.M)
    if len(lines) > 1 and any("7" in s for _, s in lines):
        return "no numbers here"
    if len(lines) == 1 and "13" in lines[0][1]:
        raise RuntimeError("refused")
    return "\n".join(f"{n}. {s.upper()}" for n, s in lines)


@query("""SELECT c_custkey::BIGINT AS row_id, CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN position('13' IN t) > 0 AND asked THEN NULL ELSE upper(t) END AS translation,
CASE WHEN c_custkey % 50 = 0 THEN 'empty source' WHEN position('13' IN t) > 0 AND asked THEN 'RuntimeError: refused' END AS error
FROM (SELECT *, 'order ' || c_custkey || ' of ' || c_mktsegment AS t, true AS asked FROM customer)""")
def translate_failing(spark, d):
    """Units that lose their answer are asked again member by member, and only members that fail themselves stay errors."""
    c = src.table(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 50 == 0, " ").otherwise(F.concat(F.lit("order "), "c_custkey", F.lit(" of "), "c_mktsegment"))
    rows = c.select(F.col("c_custkey").cast("long").alias("row_id"), text.alias("source"), F.lit(None).cast("string").alias("content_type"))
    none = spark.createDataFrame([], "row_id long, source string, target string, status string")
    terms = spark.createDataFrame([], "row_id long, source string, target string, category string")
    loses = lambda m: stubborn(m) if len(re.findall(r"^\d+\. ", m.split("## Source")[1], re.M)) == 1 else "lost"
    return jobs.translate(rows, none, terms, loses).select("row_id", "translation", "error")


@query("""WITH c AS (SELECT conv_id::BIGINT * 1000 + turn AS row_id, conv_id, turn, CASE WHEN conv_id % 6 = 1 AND turn = 0 THEN ' ' ELSE coalesce(role, '') || ' ' || conv_id || '.' || turn END AS source FROM conversations)
SELECT row_id, CASE WHEN source = ' ' THEN NULL WHEN conv_id % 6 = 2 AND (SELECT count(*) FROM c x WHERE x.conv_id = c.conv_id) > 1 THEN '[ERROR: DIALOG_LLM_FAIL] ' || source ELSE upper(source) END AS translation,
CASE WHEN source = ' ' THEN 'empty source' WHEN conv_id % 6 = 2 AND (SELECT count(*) FROM c x WHERE x.conv_id = c.conv_id) > 1 THEN 'RuntimeError: refused' END AS error FROM c""")
def translate_dialogs(spark, d):
    """Dialogs, a sixth with a blank member (row by row) and a sixth whose call fails (an error as a whole)."""
    c = src.table(spark, d, "conversations")
    text = F.when((F.col("conv_id") % 6 == 1) & (F.col("turn") == 0), " ").otherwise(F.concat(F.coalesce("role", F.lit("")), F.lit(" "), "conv_id", F.lit("."), "turn"))
    rows = c.select(
        (F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("row_id"), text.alias("source"), F.lit(None).cast("string").alias("content_type"), F.col("conv_id").cast("string").alias("dialog_id"),
        F.lit(None).cast("string").alias("speaker"), F.col("turn").cast("double").alias("time"),
    )

    def said(message: str) -> str:
        lines = re.findall(r"^(\d+)\. (.*)$", message.split("## Source")[1], re.M)
        owners = {s.split(" ")[-1].split(".")[0] for _, s in lines}
        if len(lines) > 1 and len(owners) == 1 and int(next(iter(owners))) % 6 == 2:
            raise RuntimeError("refused")
        return "\n".join(f"{n}. {s.upper()}" for n, s in lines)

    none = spark.createDataFrame([], "row_id long, source string, target string, status string")
    terms = spark.createDataFrame([], "row_id long, source string, target string, category string")
    return jobs.translate(rows, none, terms, said, dialogs=True).select("row_id", "translation", "error")


@query("""WITH u AS (SELECT conv_id, string_agg((n || '. [' || role || '] turn ' || turn), chr(10) ORDER BY turn) AS body, min(kind) AS kind FROM
(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CASE conv_id % 3 WHEN 0 THEN '任务' WHEN 1 THEN '剧情' END AS kind FROM conversations) GROUP BY conv_id)
SELECT conv_id::VARCHAR AS unit_id, 'Project' || chr(10) || chr(10) || '## Style' || chr(10) || chr(10) || 'general' || CASE WHEN kind = '任务' THEN chr(10) || chr(10) || 'brief' ELSE '' END ||
CASE kind WHEN '任务' THEN chr(10) || chr(10) || '## Rules' || chr(10) || chr(10) || 'short' WHEN '剧情' THEN chr(10) || chr(10) || '## Rules' || chr(10) || chr(10) || 'with context' ELSE '' END ||
chr(10) || chr(10) || '## Source' || chr(10) || chr(10) || body || chr(10) || chr(10) || '## Output' || chr(10) || chr(10) || 'one line each' AS message FROM u""")
def message_sections(spark, d):
    """Whole messages of every conversation: header, style, rules by class, source, contract; empty sections are left out."""
    c = src.table(spark, d, "conversations")
    members = c.select(
        F.col("conv_id").cast("string").alias("unit_id"), F.col("turn").cast("int").alias("pos"), (F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("row_id"),
        F.concat(F.lit("turn "), "turn").alias("source"), F.col("role").alias("speaker"), F.expr("CASE conv_id % 3 WHEN 0 THEN '任务' WHEN 1 THEN '剧情' END").alias("content_type"),
    )
    seen = members.select("row_id", F.array().cast("array<string>").alias("terms"))
    terms = spark.createDataFrame([], "source string, target string, category string")
    refs = spark.createDataFrame([], "query_id long, pair_id long, source string, target string, status string, score double, nth int")
    style = spark.createDataFrame([(None, "general"), ("任务", "brief")], "content_type string, rules string")
    setting = jobs.Setting(header="Project", style=style, rules={"functional": "short", "contextual": "with context"}, contract="one line each")
    return jobs.messages(members, seen, terms, refs, 3, setting).select("unit_id", "message")


@query("""SELECT p_partkey::BIGINT AS row_id, 'Choose a type.' || chr(10) || chr(10) || '- UI：on buttons' || chr(10) || '- story：told' || chr(10) || chr(10) || p_name AS message FROM part""")
def classification_messages(spark, d):
    part = src.table(spark, d, "part")
    return part.select(F.col("p_partkey").cast("long").alias("row_id"), render.classification_message(F.col("p_name"), [("UI", "on buttons"), ("story", "told")], "Choose a type.").alias("message"))


@query("""SELECT p_partkey::BIGINT AS row_id, CASE WHEN p_size % 4 = 0 THEN '' ELSE '[{"source":"' || p_name || '","target":"' || p_brand || '"' || CASE WHEN p_size % 2 = 0 THEN ',"category":"' || p_type || '"' ELSE '' END || '}]' END AS terms,
'[{"source":"' || p_name || '","target":"' || p_brand || '","score":' || round(p_size / 7.0::DOUBLE, 4) || CASE WHEN p_size % 3 = 0 THEN ',"status":"Done"' ELSE '' END || '}]' AS refs,
CASE WHEN p_size % 5 <> 0 THEN 'note ' || p_size END AS note FROM part""")
def result_views(spark, d):
    """Views of used terms and references for results, and the first picture note."""
    part = src.table(spark, d, "part")
    term = F.struct(F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("category"))
    terms = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<struct<source:string,target:string,category:string>>")).otherwise(F.array(term))
    ref = F.struct(F.col("p_name").alias("source"), F.col("p_brand").alias("target"), (F.col("p_size") / 7.0).alias("score"), F.when(F.col("p_size") % 3 == 0, "Done").alias("status"))
    notes = F.array(F.struct(F.lit(None).cast("string").alias("image_analysis")), F.struct(F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("note "), "p_size")).otherwise("").alias("image_analysis")))
    return part.select(F.col("p_partkey").cast("long").alias("row_id"), render.term_view(terms).alias("terms"), render.reference_view(F.array(ref)).alias("refs"), render.first_image_note(notes).alias("note"))


@query("""SELECT c_custkey::BIGINT AS project_id, '## Project' || chr(10) || chr(10) || 'Name: ' || c_name || chr(10) || 'Direction: ' || CASE WHEN c_custkey % 2 = 0 THEN 'zh-en' ELSE 'zh>xx' END ||
chr(10) || 'From: Chinese' || chr(10) || 'To: ' || CASE WHEN c_custkey % 2 = 0 THEN 'English' ELSE 'xx' END || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'Background: ' || c_mktsegment ELSE '' END ||
CASE WHEN c_custkey % 5 = 0 THEN chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || 'kept' ELSE '' END AS header FROM customer""")
def project_headers(spark, d):
    c = src.table(spark, d, "customer")
    rows = c.select(
        F.col("c_custkey").cast("long").alias("project_id"), F.col("c_name").alias("game"), F.when(F.col("c_custkey") % 2 == 0, "zh-en").otherwise("zh>xx").alias("language_pair"),
        F.lit(None).cast("string").alias("source_lang"), F.lit(None).cast("string").alias("target_lang"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("background"),
        F.when(F.col("c_custkey") % 5 == 0, "kept").alias("notes"),
    )
    return render.project_header(rows).select("project_id", "header")


@query("""SELECT true AS asked, p_partkey::VARCHAR AS unit_id FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0 AND p_size % 5 <> 0""")
def enrich_gated(spark, d):
    """The same units with the look-up asked for and not: only the first have references."""
    part = src.table(spark, d, "part")
    units_ = part.select(F.col("p_partkey").cast("string").alias("unit_id"), F.col("p_name").alias("query"), (F.col("p_size") % 2).alias("term_count"), (F.col("p_size") % 3).alias("sparse_hits"), F.when(F.col("p_size") % 5 == 0, 0.9).alias("dense_top1"))
    cache = spark.createDataFrame([], "key string, results string")
    page = lambda q: json.dumps({"data": {"webPages": {"value": [{"name": q, "url": "u", "snippet": "s"}]}}})
    both = [jobs.enrich_weak_units(units_, cache, page, asked=on)[0].select(F.lit(on).alias("asked"), "unit_id") for on in (True, False)]
    return both[0].unionByName(both[1])


# --- streams ------------------------------------------------------------------------------------------------------

#: Each pair's best status, and whether rows of the first load had it.
LOADED = f"""{TM}, b AS (SELECT source, target, first(CASE WHEN rank < 99 THEN status END ORDER BY rank) AS status, bool_or(row_id % 2 = 1) AS early FROM tm GROUP BY source, target),
x AS (SELECT *, sha1(from_hex('{NAMESPACE.hex}') || encode(source || chr(31) || target || chr(31) || coalesce(status, ''))) AS h FROM b),
points AS (SELECT {UUID5} AS pair_id, source, target, status, early FROM x)"""


def _loads(spark, d, root: str, embed: bool = False) -> None:
    """The memory loaded as a stream of files in small batches, odd rows first, with a restart in between."""
    folder, mark = (_folder(spark, n) for n in ("in", "mark"))
    rows = src.memory(spark, d).withColumn("status", F.when(F.col("status") != "Draft", F.col("status")))
    for number, part in enumerate((1, 0), 1):
        rows.where(F.col("row_id") % 2 == part).select("source", "target", "status").repartition(2).write.mode("append").parquet(folder)
        made = (lambda s, n=number: s.select("source", F.array(F.length("source").cast("float"), F.lit(float(n)).cast("float")).alias("dense"))) if embed else None
        ingest.ingest_memory(spark, folder, root, mark, NAMESPACE, files_a_batch=1, collection="main", embed=made, n_buckets=4).awaitTermination()


@query(f"WITH {LOADED} SELECT pair_id, source, target, status, 'main' AS collection, NULL::DOUBLE AS total FROM points")
def stream_memory(spark, d):
    root = _folder(spark, "index")
    _loads(spark, d, root)
    return index.points(spark, root).select("pair_id", "source", "target", "status", "collection", F.element_at("dense", 1).cast("double").alias("total"))


@query(f"WITH {LOADED} SELECT pair_id, status, 'main' AS collection, length(source) + CASE WHEN early THEN 0.1 ELSE 0.2 END::DOUBLE AS total FROM points")
def stream_vectors(spark, d):
    """Vectors come from the load that first had the pair, and upgrades keep them."""
    root = _folder(spark, "index")
    _loads(spark, d, root, embed=True)
    total = F.round(F.col("dense")[0].cast("double") + F.col("dense")[1].cast("double") / 10, 1)
    return index.points(spark, root).select("pair_id", "status", "collection", total.alias("total"))


def _three_loads(spark, d) -> str:
    """The memory in three loads, the worst statuses first, so that the later ones upgrade."""
    root = _folder(spark, "index")
    rows = src.memory(spark, d)
    load = F.when(fn.status_rank(F.col("status")) > 3, 0).when(fn.status_rank(F.col("status")) > 1, 1).otherwise(2)
    for number in range(3):
        index.load(spark, root, rows.where(load == number), NAMESPACE, n_buckets=4)
    return root


@query(f"""WITH {TM}, p AS (SELECT DISTINCT source, target FROM tm), t AS (SELECT DISTINCT source, target, unnest(regexp_extract_all(lower(source), '[0-9a-z]+')) AS token FROM p)
SELECT token, count(*) AS df, (SELECT count(*) FROM p) AS n FROM t GROUP BY token""")
def kept_frequencies(spark, d):
    """Token frequencies kept through three loads with upgrades, against a full count."""
    held, n = index.frequencies(spark, _three_loads(spark, d))
    return held.crossJoin(F.broadcast(n))  # one row


@query(f"""WITH {BEST}, x AS (SELECT *, sha1(from_hex('{NAMESPACE.hex}') || encode(source || chr(31) || target || chr(31) || coalesce(status, ''))) AS h FROM b),
ix AS (SELECT {UUID5} AS pair_id, token, count(*) AS tf FROM (SELECT *, unnest(regexp_extract_all(lower(source), '[0-9a-z]+')) AS token FROM x) GROUP BY ALL),
idf AS (SELECT token, ln(1.0::DOUBLE + ((SELECT count(*) FROM b)::DOUBLE - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM ix GROUP BY token),
qs AS (SELECT query_id, token, count(*) AS q_tf FROM (SELECT source AS query_id, unnest(regexp_extract_all(lower(source), '[0-9a-z]+')) AS token FROM (SELECT DISTINCT source FROM b)) GROUP BY ALL),
sp AS (SELECT query_id, pair_id, round(sum(q_tf * idf * tf), 6) AS score FROM qs JOIN idf USING (token) JOIN ix USING (token) GROUP BY ALL)
SELECT * FROM (SELECT query_id, pair_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pair_id) AS nth FROM sp) WHERE nth <= 5""")
def sparse_kept(spark, d):
    """Every distinct source asked of the loaded index, with its kept frequencies and with bounds."""
    root = _three_loads(spark, d)
    held, n = index.frequencies(spark, root)
    posted = textindex.postings(index.points(spark, root), "pair_id", "source")
    asked = textindex.postings(src.memory(spark, d).select(F.col("source").alias("query_id"), "source").distinct(), "query_id", "source")
    return retrieve.sparse_hits(asked, posted, n, 5, held, direct=0).select("query_id", "pair_id", "score", "nth")


@query("SELECT DISTINCT md5(lower(p_name)) AS key, 'found ' || upper(p_name) AS results FROM part")
def stream_cache(spark, d):
    """Every name asked for twice, as a stream; each is looked up once."""
    folder, root, mark = (_folder(spark, n) for n in ("asked", "cache", "mark"))
    rows = src.table(spark, d, "part").select(fn.cache_key(F.col("p_name")).alias("key"), F.col("p_name").alias("query"))
    for _ in range(2):
        rows.repartition(2).write.mode("append").parquet(folder)
        ingest.fill_cache(spark, folder, root, mark, lambda q: "found " + q.upper()).awaitTermination()
    return ingest.cached(spark, root).select("key", "results")


@query("SELECT md5(lower(p_name)) AS key, length(p_name) % 2 = 0 AS found, 1 AS lookups FROM part GROUP BY p_name")
def stream_requests(spark, d):
    """Names asked for in three batches within the expiry, half of whose lookups fail: each is looked up once all the same."""
    folder, root, mark = (_folder(spark, n) for n in ("asked", "cache", "mark"))
    part = src.table(spark, d, "part")
    asked_at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("p_partkey") % 600)
    rows = part.select(fn.cache_key(F.col("p_name")).alias("key"), F.col("p_name").alias("query"), asked_at.alias("asked_at"))
    for _ in range(3):
        rows.coalesce(1).write.mode("append").parquet(folder)
    fetch = lambda q: "found " + q if len(q) % 2 == 0 else 1 / 0
    ingest.fill_cache(spark, folder, root, mark, fetch, "1 hour", files_a_batch=1).awaitTermination()
    return ingest.tried(spark, root).groupBy("key", "found").agg(F.count("*").cast("int").alias("lookups"))


@query("SELECT conv_id::VARCHAR AS unit_id, 0 AS pos, reverse(conv_id::VARCHAR) AS raw FROM conversations GROUP BY conv_id")
def stream_units(spark, d):
    """Units asked for twice, as a stream; the second time nothing is answered again."""
    folder, results, mark = (_folder(spark, n) for n in ("units", "results", "mark"))
    rows = src.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("unit_id"), F.col("conv_id").cast("string").alias("message"))
    answer = lambda units: infer.answers(units, lambda m: m[::-1])
    for _ in range(2):
        rows.repartition(2).write.mode("append").parquet(folder)
        ingest.run_units(spark, folder, results, mark, "t", answer, {"project": "p"}).awaitTermination()
    return spark.read.parquet(results).select("unit_id", "pos", "raw")
