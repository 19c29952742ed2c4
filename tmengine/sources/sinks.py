"""Writers: indexes, results, glossaries, caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"

# The columns of an exported task, in their order.
RESULT_COLUMNS = [
    "source", "translation", "translation_reason", "status", "content_type", "terminology_used", "rag_references", "tm_exact_match_used",
    "tm_exact_match_source", "tm_exact_match_target", "tm_exact_match_status", "tm_exact_match_score", "web_references", "web_search_triggered",
    "image_analysis", "error_msg",
]


def export_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as text cells: nested values as JSON, booleans in lower case, nulls and empty lists empty; a mark before the first header."""
    kinds = dict(rows.dtypes)
    cells = []
    for i, c in enumerate(columns):
        value = F.col(c)
        if kinds[c].startswith(("array", "map", "struct")):
            cell = F.when(F.size(value) > 0, F.to_json(value)) if kinds[c].startswith(("array", "map")) else F.to_json(value)
        else:
            cell = value.cast("string")
        cells.append(F.coalesce(cell, F.lit("")).alias(BOM + c if i == 0 else c))
    return rows.select(*cells)


def result_cells(results: DataFrame) -> DataFrame:
    """Results as the cells of an exported task: all RESULT_COLUMNS, those that the results lack empty."""
    missing = [F.lit(None).cast("string").alias(c) for c in RESULT_COLUMNS if c not in results.columns]
    return export_columns(results.select("*", *missing), RESULT_COLUMNS)


def write_csv(rows: DataFrame, columns: list[str], path: str, order: str | None = None) -> None:
    """Export with a header; ``order`` restores the rows' original order."""
    sorted_rows = rows.orderBy(order) if order else rows
    export_columns(sorted_rows, columns).write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder of the newest complete version of a table kept in versions."""
    fs, target = _files(spark, root)
    if not fs.exists(target):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(target) if s.getPath().getName().startswith("v"))
    done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return f"{root}/{done[-1]}" if done else None


def read_version(spark: SparkSession, root: str) -> DataFrame | None:
    path = current_version(spark, root)
    return spark.read.parquet(path) if path else None


def write_version(df: DataFrame, root: str, partition: str | None = None) -> str:
    """Write a new version next to the one being read; readers switch once it is complete."""
    spark = df.sparkSession
    last = current_version(spark, root)
    number = int(last.rsplit("/v", 1)[1].split("-")[0]) + 1 if last else 1
    path = f"{root}/v{number:08d}-{uuid.uuid4().hex[:8]}"
    writer = df.write
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return path


def reset_collection(spark: SparkSession, root: str, collection: str) -> None:
    """A new version without the collection's rows."""
    rows = read_version(spark, root)
    if rows is not None:
        write_version(rows.where(F.col("collection") != collection), root, "collection")


def append_results(results: DataFrame, path: str) -> None:
    """Append unit results by task; readers drop what was written twice."""
    results.write.mode("append").partitionBy("task_id").parquet(path)


def write_glossary(terms: DataFrame, path: str, form: str = "json") -> None:
    """Persist a glossary as csv or json files, replacing what is there; ``replace_glossary`` does so at once and by project."""
    rows = terms.select("source", "target", "category", *(["notes"] if "notes" in terms.columns else []))
    writer = rows.write.mode("overwrite")
    writer.json(path) if form == "json" else writer.csv(path, header=True, escape='"')


def replace_glossary(terms: DataFrame, root: str, project_id: str) -> str:
    """A new version of all glossaries at ``root`` with the project's own replaced; readers see the old one until it is complete."""
    spark = terms.sparkSession
    rows = terms.select("source", "target", "category", (F.col("notes") if "notes" in terms.columns else F.lit(None).cast("string")).alias("notes"))
    rows = rows.withColumn("project_id", F.lit(project_id))
    held = read_version(spark, root)
    others = held.where(F.col("project_id") != project_id) if held is not None else None
    return write_version(rows if others is None else others.select(*rows.columns).unionByName(rows), root, "project_id")
