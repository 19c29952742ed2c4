"""Batch inference through user callables, and parsing of what it returns."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmengine.functions.text import NUMBERED, content_type, parsed_answer, stripped
from tmengine.schemas import UNKNOWN_TYPE
from tmengine.tables import written


def called(messages: list[str], model: Callable[[str], str], workers: int = 1, timeout: float | None = None, retries: int = 2, pause: float = 0.0) -> list[tuple]:
    """``(answer, error)`` of each message in order, up to ``workers`` calls at a time.

    A call that raises, or has not returned after ``timeout`` seconds, is tried again ``retries`` times, after a pause that
    doubles; then its error stands, and only its own. A call that hangs is left behind in its thread.
    """

    def tried(said: str) -> tuple:
        box: list = []

        def run() -> None:
            try:
                box.append((model(said), None))
            except Exception as e:  # a user's callable may raise anything; the row carries it
                box.append((None, f"{type(e).__name__}: {e}"))

        if timeout is None:
            run()
        else:
            thread = threading.Thread(target=run, daemon=True)
            thread.start()
            thread.join(timeout)
        return box[0] if box else (None, f"TimeoutError: no answer in {timeout} seconds")

    def one(said: str) -> tuple:
        for attempt in range(retries + 1):
            got = tried(said)
            if got[1] is None:
                break
            if pause and attempt < retries:
                time.sleep(pause * 2**attempt)
        return got

    if workers == 1:
        return [one(m) for m in messages]
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(one, messages))


def answers(
    units: DataFrame, model: Callable[[str], str], parallel: int | None = None, retries: int = 2, workers: int = 1, timeout: float | None = None, pause: float = 0.0
) -> DataFrame:
    """``(unit_id, raw, error)``: the model called once a message; a call that fails gives an error row only for itself.

    ``parallel`` tasks of ``workers`` calls each bound the calls made at once; see ``called`` for the rest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = called(batch["message"].tolist(), model, workers, timeout, retries, pause)
            yield pd.DataFrame({"unit_id": batch["unit_id"], "raw": [g[0] for g in got], "error": [g[1] for g in got]})

    rows = units.select("unit_id", "message")
    rows = rows.repartition(parallel) if parallel else rows
    return rows.mapInPandas(run, "unit_id string, raw string, error string")


def classified(texts: DataFrame, model: Callable[[str], str], message: Callable[[Column], Column] | None = None, guided: bool = True) -> DataFrame:
    """Segments with a content type: their hint's if it resolves, else the model's answer for the distinct text, else unknown.

    ``message`` makes what the model is sent of the text (``render.classification_message``). Without a guide, which types
    would choose the rules of, nothing is asked.
    """
    hinted = texts.withColumn("content_type", content_type(F.col("content_type")))
    if not guided:
        return hinted.withColumn("content_type", F.coalesce("content_type", F.lit(UNKNOWN_TYPE)))
    sent = (message or (lambda text: text))(F.col("source"))
    asked = hinted.where("content_type is null").select("source").distinct().select(F.col("source").alias("unit_id"), sent.alias("message"))
    found = written(answers(asked, model).select(F.col("unit_id").alias("source"), content_type(F.col("raw")).alias("_answer")))
    out = hinted.join(found.hint("merge"), "source", "left")
    return out.withColumn("content_type", F.coalesce("content_type", "_answer", F.lit(UNKNOWN_TYPE))).drop("_answer")


def embedded(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 30, dim: int | None = None) -> DataFrame:
    """``(source, dense)`` by a model that takes lists of texts; cut to ``dim`` and normalised again if asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows["source"].iloc[at : at + batch].tolist()
                yield pd.DataFrame({"source": part, "dense": model(part)})

    out = texts.select("source").mapInPandas(run, "source string, dense array<float>")
    if dim:
        cut = F.slice("dense", 1, dim)
        length = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        out = out.withColumn("dense", F.transform(cut, lambda x: F.when(length > 0, x / length).otherwise(x).cast("float")))
    return out


def parse_single(outputs: DataFrame) -> DataFrame:
    return outputs.withColumn("p", parsed_answer(F.coalesce("raw", F.lit("")))).select("unit_id", "p.translation", "p.reason")


def _lines(outputs: DataFrame) -> DataFrame:
    """``(unit_id, expected, at, number, body)`` of the numbered lines."""
    each = outputs.select("unit_id", "expected", F.posexplode(F.split("raw", r"\r\n|\r|\n")).alias("at", "line")).where(F.col("line").rlike(NUMBERED))
    each = each.withColumn("number", F.regexp_extract("line", NUMBERED, 1).try_cast("bigint")).withColumn("body", stripped(F.regexp_extract("line", NUMBERED, 2)))
    return each.where("body <> '' and number is not null")


def _answer_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", parsed_answer(F.col("body"))).select("unit_id", "pos", "p.translation", "p.reason")


def parse_numbered(outputs: DataFrame) -> DataFrame:
    """``(unit_id, pos, translation, reason)`` of the units whose numbers are exactly 1 to expected; the first of a repeat counts."""
    first = _lines(outputs).groupBy("unit_id", "expected", "number").agg(F.min_by("body", "at").alias("body"))
    whole = Window.partitionBy("unit_id")
    checked = first.withColumn("n", F.count("*").over(whole)).withColumn("lo", F.min("number").over(whole)).withColumn("hi", F.max("number").over(whole))
    return _answer_rows(checked.where("n = expected and lo = 1 and hi = expected").withColumn("pos", F.col("number").cast("int")))


def parse_positional(outputs: DataFrame) -> DataFrame:
    """As ``parse_numbered``, the lines taken in order whatever their numbers, if there are as many as expected."""
    unit = Window.partitionBy("unit_id")
    rows = _lines(outputs).withColumn("pos", F.row_number().over(unit.orderBy("at"))).withColumn("n", F.count("*").over(unit))
    return _answer_rows(rows.where("n = expected"))


def dialog_results(members: DataFrame, said: DataFrame) -> DataFrame:
    """``(row_id, translation, reason, status, error)`` of dialogs' members ``(unit_id, pos, row_id, source)`` from 0.

    ``said(unit_id, expected, raw, error)`` has one answer a dialog. A dialog whose call failed, whose answer does
    not have the expected lines, or that has no answer, is an error as a whole: no member of it is kept or asked alone.
    """
    parsed = parse_positional(said.where("error is null")).withColumn("pos", F.col("pos") - 1)
    rows = members.join(said.select("unit_id", F.col("error").alias("_failed")).hint("merge"), "unit_id", "left")
    rows = rows.join(parsed.hint("merge"), ["unit_id", "pos"], "left")
    good = F.col("translation").isNotNull()
    kind = F.when(F.col("_failed").isNotNull(), "DIALOG_LLM_FAIL").otherwise("DIALOG_PARSE_FAIL")  # fixed values
    missed = F.concat(F.lit("[ERROR: "), kind, F.lit("] "), F.coalesce("source", F.lit("")))
    return rows.select(
        "row_id", F.coalesce("translation", missed).alias("translation"), F.when(good, F.col("reason")).alias("reason"),
        F.when(good, "success").otherwise("error").alias("status"), F.when(~good, F.coalesce("_failed", F.lit("the answer does not have the expected lines"))).alias("error"),
    )


def failed_members(members: DataFrame, parsed: DataFrame) -> DataFrame:
    """Members of units without a parsed answer, each as a unit of its own that keeps its content type."""
    rest = members.join(parsed.select("unit_id").distinct(), "unit_id", "left_anti")
    single = F.concat("unit_id", F.lit("/"), F.col("pos").cast("string"))
    return rest.withColumn("unit_id", single).withColumn("pos", F.lit(0)).withColumn("kind", F.lit("single"))
