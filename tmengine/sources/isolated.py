"""Folders of small files, each decoded alone: one that cannot be read is put aside and does not stop the rest."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmengine.functions.text import clean_cell
from tmengine.tables import written

# The headers that name a corpus's columns wherever they stand; other corpora have them first and second.
CANONICAL = ("原文", "译文")
# Headers of a review status.
STATUS_HEADERS = ("状态", "status", "审校状态", "review_status", "state", "级别")


def cells(content: bytes) -> list[tuple]:
    """(source, target, status) of a csv corpus or a JSON array of objects; raises if it is neither."""
    text = content.decode("utf-8-sig")
    if text.lstrip()[:1] in ("[", "{"):
        items = json.loads(text)
        items = items.get("items") if isinstance(items, dict) else items
        if not isinstance(items, list):
            raise ValueError("a JSON array, or an object with an items array, is needed")
        items = [x for x in items if isinstance(x, dict)]
        headers = list(dict.fromkeys(k for x in items for k in x))
        rows = [[x.get(h) for h in headers] for x in items]
    else:
        lines = list(csv.reader(io.StringIO(text), strict=True))
        headers, rows = (lines[0], lines[1:]) if lines else ([], [])
    if not rows:
        return []
    if len(headers) < 2:
        raise ValueError(f"at least 2 columns are needed, found {len(headers)}")
    pair = [headers.index(c) for c in CANONICAL] if all(c in headers for c in CANONICAL) else [0, 1]
    named = {str(h).strip().lower(): i for i, h in enumerate(headers)}
    status = next((named[s] for s in STATUS_HEADERS if s in named), None)
    at = lambda row, i: None if i is None or i >= len(row) or row[i] is None else str(row[i])
    return [(at(r, pair[0]), at(r, pair[1]), at(r, status)) for r in rows]


def decoded(files: DataFrame, parse: Callable[[bytes], list[tuple]], columns: str) -> DataFrame:
    """``(file, at, *columns, error)`` of ``(file, content)``, written out: rows of files as ``parse`` gives them, each file in its own call.

    A file that cannot be read gives one row with ``error``, one without rows a row without ``at``.
    """
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                try:
                    rows, error = parse(bytes(content)), None
                except Exception as e:  # whatever a broken file raises stays with that file
                    rows, error = [], f"{type(e).__name__}: {e}"
                out = pd.DataFrame(rows or [(None,) * len(names)], columns=names)
                yield out.assign(file=file, at=pd.array(range(len(out)), "Int64") if rows else pd.array([None], "Int64"), error=error)

    return written(files.select("file", "content").mapInPandas(run, f"file string, at long, {columns}, error string"))


def _empty(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files ``(file)`` without a byte, which Spark's readers leave out; their names come from a listing in the driver."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    each, names = target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True), []
    while each.hasNext():
        status = each.next()
        if status.getLen() == 0 and fnmatchcase(status.getPath().getName(), pattern):
            names.append((status.getPath().toString(),))
    return spark.createDataFrame(names, "file string")


def found(spark: SparkSession, folder: str, pattern: str = "*", finished: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files ``(file, content)`` to decode and those ``(file)`` that have a finished task of their name; temporary ones (~$) are neither.

    Spark reads a file whole, in one task: files up to 2 GB.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    rows = rows.select(F.col("path").alias("file"), F.regexp_extract("path", r"[^/]+$", 0).alias("task_id"), "content").where("task_id not like '~$%'")
    done = spark.createDataFrame([], "task_id string") if finished is None else finished.select("task_id").distinct()
    return rows.join(done.hint("merge"), "task_id", "left_anti").select("file", "content"), rows.select("file", "task_id").join(done.hint("merge"), "task_id", "left_semi").select("file")


def corpora(spark: SparkSession, folder: str, pattern: str = "*", finished: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows ``(file, at, source, target, status)`` of all readable corpora of a folder, and ``(file, outcome, n_rows, n_blank, error)`` of every file.

    Rows without source or target are left out and counted as blank. Outcomes: ok, failed (with the error), and skipped for
    files without a row and those finished before.
    """
    open_, done = found(spark, folder, pattern, finished)
    table = decoded(open_, cells, "source string, target string, status string")
    table = table.select("file", "at", *[clean_cell(F.col(c)).alias(c) for c in ("source", "target", "status")], "error")
    whole = F.col("at").isNotNull() & (F.col("source") != "") & (F.col("target") != "")
    files = table.groupBy("file").agg(F.count_if(whole).alias("n_rows"), F.count_if(F.col("at").isNotNull() & ~whole).alias("n_blank"), F.max("error").alias("error"))
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("n_rows") + F.col("n_blank") > 0, "ok").otherwise("skipped")
    none = F.lit(0).cast("long")
    files = files.select("file", outcome.alias("outcome"), "n_rows", "n_blank", "error")
    done = done.unionByName(_empty(spark, folder, pattern).where(~F.col("file").rlike(r"/(~\$|_|\.)[^/]*$")))
    files = files.unionByName(done.select("file", F.lit("skipped").alias("outcome"), none.alias("n_rows"), none.alias("n_blank"), F.lit(None).cast("string").alias("error")))
    rows = table.where(whole).withColumn("status", F.when(F.col("status") != "", F.col("status"))).drop("error")
    return rows, files
