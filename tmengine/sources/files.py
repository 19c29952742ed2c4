"""Readers: corpora, glossaries, texts, memory exports, style guides, job results."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmengine.functions.text import clean_cell, lenient_double, memory_text, status_from_file
from tmengine.sources import isolated

# Headers that name a column, in order of preference.
SOURCE = ("中文", "原文", "source", "src", "zh", "zh_cn", "chinese")
TARGET = ("英语", "英文", "译文", "target", "tgt", "en", "english")
CATEGORY = ("category", "类型", "分类")
NOTES = ("notes", "note", "备注", "说明")
CONTEXT = ("context", "上下文")
STATUS = ("status", "状态")
CONTENT_TYPE = ("content_type", "文本类型", "类型", "type", "category", "分类")
DIALOG_ID = ("id", "dialog_id", "对话id", "对话编号", "dialogue_id")
SPEAKER = ("说话人", "speaker", "角色", "name", "character", "actor")
TIME = ("time", "时间", "时刻", "timestamp", "t")

GLOSSARY_ALIASES = {"source": SOURCE, "target": TARGET, "category": CATEGORY, "notes": NOTES}
CORPUS_ALIASES = {"source": SOURCE, "target": TARGET, "context": CONTEXT, "status": STATUS}
#: Dialog columns come first: a header that names one is not taken for the content type as well.
TEXT_ALIASES = {"source": SOURCE, "dialog_id": DIALOG_ID, "speaker": SPEAKER, "time": TIME, "content_type": CONTENT_TYPE}

MAX_GUIDE_BYTES = 1 << 20


def resolve(df: DataFrame, aliases: dict[str, tuple[str, ...]], required: list[str]) -> DataFrame:
    """Rename columns found by alias, cells cleaned, all other columns kept as they are.

    A required column without an alias takes the column at its place; a missing optional one is null.
    """
    headers: dict[str, str] = {}
    for c in df.columns:
        headers.setdefault(c.lstrip("﻿").strip().lower(), c)
    chosen: dict[str, str] = {}
    for name, options in aliases.items():
        found = next((headers[a] for a in options if a in headers and headers[a] not in chosen.values()), None)
        if found is not None:
            chosen[name] = found
    for place, name in enumerate(required):
        if name not in chosen:
            if place >= len(df.columns):
                raise ValueError(f"at least {len(required)} columns are needed, found {df.columns}")
            chosen[name] = df.columns[place]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    out = []
    for name in aliases:
        cell = clean_cell(quoted(chosen[name])) if name in chosen else F.lit(None).cast("string")
        cell = lenient_double(cell) if name == "time" else cell
        out.append((cell if name in required or name == "time" else F.when(cell != "", cell)).alias(name))
    rest = [quoted(c) for c in df.columns if c not in chosen.values() and c not in aliases]
    return df.select(*out, *rest)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A csv or json corpus as (source, target, context, status); rows without source or target are left out."""
    rows = json_rows(spark, path, CORPUS_ALIASES) if path.endswith(".json") else resolve(_csv(spark, path), CORPUS_ALIASES, ["source", "target"])
    return rows.select(*CORPUS_ALIASES).where("source <> '' and target <> ''")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """A csv or json glossary as (row_id, source, target, category, notes), rows in file order."""
    rows = json_rows(spark, path, GLOSSARY_ALIASES) if path.endswith(".json") else resolve(_csv(spark, path), GLOSSARY_ALIASES, ["source", "target"])
    rows = rows.withColumn("row_id", F.monotonically_increasing_id())
    return rows.select("row_id", *GLOSSARY_ALIASES).where("source <> '' and target <> ''")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts to translate from txt (a line each), csv or json, as (row_id, source, content_type, dialog_id, speaker, time)."""
    if path.endswith(".txt"):
        lines = spark.read.text(path).select(clean_line(F.col("value")).alias("source"))
        rows = lines.select("source", *[F.lit(None).cast("double" if c == "time" else "string").alias(c) for c in TEXT_ALIASES if c != "source"])
    elif path.endswith(".json"):
        rows = json_rows(spark, path, TEXT_ALIASES)
    else:
        rows = resolve(_csv(spark, path), TEXT_ALIASES, ["source"])
    rows = rows.withColumn("row_id", F.monotonically_increasing_id())
    return rows.select("row_id", "source", "content_type", "dialog_id", "speaker", "time").where("source <> ''")


def clean_line(c):
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), r"(?U)^\s+|\s+$", "")


def json_rows(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows of a JSON array of objects and strings, or of an object's ``items`` array; other members are dropped.

    An object's columns are the first aliases with a value that is not blank, keys without regard to case.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    parsed = whole.select(F.parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    own = F.try_variant_get("v", "$.items", "variant")
    listed = F.when(kind.startswith("ARRAY"), F.col("v")).when(F.schema_of_variant(own).startswith("ARRAY"), own).otherwise(F.raise_error(F.lit("a JSON array, or an object with an items array, is needed")))
    items = F.explode(F.coalesce(F.try_variant_get(listed, "$", "array<variant>"), F.array().cast("array<variant>")))
    items = parsed.select(items.alias("item")).withColumn("kind", F.schema_of_variant("item"))
    items = items.where(F.col("kind").startswith("OBJECT") | (F.col("kind") == "STRING"))
    pairs = F.map_entries(F.try_variant_get("item", "$", "map<string,string>"))
    text = F.try_variant_get("item", "$", "string")

    def under(option: str):
        held = F.filter(pairs, lambda e: (F.lower(F.trim(e["key"])) == option) & (clean_cell(e["value"]) != ""))
        return F.try_element_at(held, F.lit(1))["value"]

    def cell(name: str, options: tuple[str, ...]):
        found = clean_cell(F.coalesce(*[under(o) for o in options]))
        own = F.when(F.col("kind") == "STRING", clean_cell(text) if name == "source" else F.lit("")).otherwise(found)
        if name in ("source", "target"):
            return own
        return lenient_double(own) if name == "time" else F.when(own != "", own)

    return items.select(*[cell(n, o).alias(n) for n, o in aliases.items()])


def _segment(xml: str | None) -> tuple[str | None, str | None]:
    """``(text, error)`` of a segment, parsed once: its Text elements' Value text, or their own where they have none."""
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError as e:
        return None, str(e)
    local = lambda e: e.tag.rpartition("}")[2]
    out, open_ = [], [(root, False)]
    while open_:  # in document order, however deep
        at, shown = open_.pop()
        if isinstance(at, str):
            out.append(at)
            continue
        held = local(at) == "Text" and any(local(c) == "Value" for c in at)
        shown = shown or (local(at) == "Text" and not held)
        if shown and at.text:
            out.append(at.text)
        for c in reversed(at):
            if shown and c.tail:
                open_.append((c.tail, True))
            open_.append((c, shown or (held and local(c) == "Value")))
    return "".join(out), None


def checked_segments(segments: DataFrame) -> DataFrame:
    """``text`` of the column xml; malformed XML gives a null text and ``error``, and does not fail the job."""

    @F.pandas_udf("text string, error string")
    def parsed(xml: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_segment(x) for x in xml], columns=["text", "error"])

    out = segments.withColumn("_parsed", parsed("xml"))
    return out.withColumn("error", F.col("_parsed.error")).withColumn("text", memory_text(F.col("_parsed.text"))).drop("_parsed")


def _units(content: bytes) -> list[tuple]:
    base = sqlite3.connect(":memory:")
    try:
        base.deserialize(content)
        return base.execute("select source_segment, target_segment from translation_units").fetchall()
    finally:
        base.close()


def isolated_exports(spark: SparkSession, folder: str, default_status: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates (source, target, status, source_file) of all memory exports under a folder, and the files ``(file, error)`` that could not be read.

    Spark reads the files, a task each, and opens them as databases in memory. A file whose name tells no
    status, without a default, gives null for quarantine. With ``limit`` only the first candidates in name order
    are taken; a folder without an export is an error.
    """
    found, _ = isolated.found(spark, folder, "*.sdltm")
    if found.isEmpty():
        raise ValueError(f"no memory export in {folder}")
    table = isolated.decoded(found, _units, "source_xml string, target_xml string")
    rows = memory_candidates(table.where("at is not null"), default_status)
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).orderBy("source_file", "_at").limit(limit).drop("_at") if limit is not None else rows
    return rows, table.where("error is not null").select("file", "error")


def read_memory_exports(spark: SparkSession, folder: str, default_status: str | None = None, limit: int | None = None) -> DataFrame:
    """The candidates of ``isolated_exports``; a file that cannot be read is an error here."""
    rows, failed = isolated_exports(spark, folder, default_status, limit)
    broken = failed.first()
    if broken is not None:
        raise ValueError(f"{broken['file']}: {broken['error']}")
    return rows


def memory_candidates(segments: DataFrame, default_status: str | None = None) -> DataFrame:
    """Candidates of ``(file, source_xml, target_xml)``; blank sides and malformed segments are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # both sides in one pass that no filter repeats
        for batch in batches:
            yield batch[["file"]].assign(**{side: [_segment(x)[0] for x in batch[f"{side}_xml"]] for side in ("source", "target")})

    rows = segments.select("file", "source_xml", "target_xml").mapInPandas(run, "file string, source string, target string")
    rows = rows.withColumns({side: memory_text(F.col(side)) for side in ("source", "target")})
    name = F.regexp_extract("file", r"[^/\\]+$", 0)
    rows = rows.where("source <> '' and target <> ''")
    return rows.select("source", "target", status_from_file(F.col("file"), F.lit(default_status)).alias("status"), name.alias("source_file"))


def read_style_guides(spark: SparkSession, folder: str) -> DataFrame:
    """One guide a sub-folder (project_id) of ``folder``: .md before .markdown before .txt, then by name; with ``error`` if unusable."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = rows.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    order = F.when(F.col("suffix") == "md", 0).when(F.col("suffix") == "markdown", 1).when(F.col("suffix") == "txt", 2)
    rows = rows.withColumn("order", order).where("order is not null").withColumn("project_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return guide_texts(rows.groupBy("project_id").agg(F.min_by(F.struct("path", "length", "content"), F.struct("order", "path")).alias("g")).select("project_id", "g.*"))


def guide_texts(files_: DataFrame) -> DataFrame:
    """``(project_id, path, text, error)`` of guide files: UTF-8 without mark, CRLF as LF, trimmed; at most 1 MiB."""
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(decoded, "^﻿", ""), "\r\n?", "\n"), r"(?U)^\s+|\s+$", "")
    out = files_.withColumn("text", text)
    error = F.when(F.col("length") > MAX_GUIDE_BYTES, "too large").when(F.col("text").isNull(), "not UTF-8").when(F.col("text") == "", "empty")
    out = out.withColumn("error", error)
    return out.select("project_id", "path", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")


def pending_files(spark: SparkSession, folder: str, pattern: str, finished: DataFrame, recursive: bool = True) -> DataFrame:
    """Job files by name, without temporary ones (~$), that have no finished ``task_id`` (the file's name) yet."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(folder).select("path", F.regexp_extract("path", r"[^/]+$", 0).alias("task_id")).where("task_id not like '~$%'")
    return rows.join(finished.select("task_id").distinct(), "task_id", "left_anti")


def read_job_results(spark: SparkSession, path: str, task_id: str) -> DataFrame:
    """Results of a task, one row of each (unit, position) however often it was written: the latest without an error, else the latest."""
    return latest_results(spark.read.parquet(path).where(F.col("task_id") == task_id))


def latest_results(rows: DataFrame) -> DataFrame:
    """One row of each (task, unit, position): the latest by ``saved_at`` without an error, else the latest with one.

    Results without ``error`` count as good, those without ``saved_at`` as equally old.
    """
    others = [c for c in rows.columns if c not in ("task_id", "unit_id", "pos")]
    good = F.col("error").isNull() if "error" in others else F.lit(True)
    best = F.max_by(F.struct(*others), F.struct(good.alias("good"), (F.col("saved_at") if "saved_at" in others else F.lit(0)).alias("at")))
    return rows.groupBy("task_id", "unit_id", "pos").agg(best.alias("r")).select("task_id", "unit_id", "pos", "r.*")
