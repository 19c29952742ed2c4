"""Work units: dedup with fan-out, dialogs, chunks, resuming and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmengine.functions.text import stripped
from tmengine.tables import written

KEY = ["source", "content_type"]


def distinct_segments(segments: DataFrame) -> DataFrame:
    """One row a (source, content type), null type apart: ``unique_id`` (first row_id) and ``n_copies``."""
    return segments.groupBy(*KEY).agg(F.min("row_id").alias("unique_id"), F.count("*").alias("n_copies"))


def fan_out(segments: DataFrame, unique: DataFrame) -> DataFrame:
    """Every segment with the columns of its distinct segment."""
    same = F.lit(True)
    for c in KEY:
        same = same & segments[c].eqNullSafe(unique[c])
    return segments.join(unique, same).drop(*[unique[c] for c in KEY])


def dedup_saving(segments: DataFrame) -> DataFrame:
    n = distinct_segments(segments).agg(F.coalesce(F.sum("n_copies"), F.lit(0)).alias("total"), F.count("*").alias("unique"))
    saved = F.col("total") - F.col("unique")
    return n.select("total", "unique", saved.alias("saved"), F.round(F.when(F.col("total") > 0, saved * 100.0 / F.col("total")).otherwise(0.0), 2).alias("saved_pct"))


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Gapless places from 0 along ``order`` (unique together), without a window over all rows.

    Rows are range-partitioned and written; each partition is numbered alone and shifted by the counts before.
    """
    spark = df.sparkSession
    laid = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    laid = written(laid.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = laid.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # one row a partition
    starts, before = [], 0
    for r in counts:
        starts.append((r["p"], before))
        before += r["n"]
    table = spark.createDataFrame(starts or [(0, 0)], "_p long, _start long")
    out = laid.withColumn("_p", part).join(F.broadcast(table), "_p")
    return out.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_start", "_at")


def single_units(rows: DataFrame, size: int) -> DataFrame:
    """Chunks of ``size`` along row_id: ``unit_id`` (single-<number>) and ``pos``."""
    out = numbered(rows, "row_id")
    unit = F.concat(F.lit("single-"), F.floor(F.col("place") / size).cast("string"))
    return out.withColumn("unit_id", unit).withColumn("pos", (F.col("place") % size).cast("int")).drop("place")


def dialog_members(segments: DataFrame) -> DataFrame:
    """Segments with ``kind`` and ``pos``: dialogs of two rows or more in time order, nulls first; all others single.

    The order inside a dialog is computed per dialog id; blank ids never enter the window, so they don't meet.
    """
    rows = segments.withColumn("dialog_id", F.when(stripped(F.col("dialog_id")) != "", stripped(F.col("dialog_id"))))
    sizes = rows.where("dialog_id is not null").groupBy("dialog_id").agg(F.count("*").alias("n")).where("n > 1").select("dialog_id", F.lit("dialog").alias("kind"))
    rows = rows.join(sizes, "dialog_id", "left").withColumn("kind", F.coalesce("kind", F.lit("single")))
    order = Window.partitionBy("dialog_id").orderBy(F.col("time").asc_nulls_first(), "row_id")
    dialogs = rows.where("kind = 'dialog'").withColumn("pos", F.row_number().over(order) - 1)
    return dialogs.unionByName(rows.where("kind = 'single'").withColumn("pos", F.lit(0)))


def unit_types(members: DataFrame) -> DataFrame:
    """The first content type of each unit's members that is not null."""
    known = F.min_by("content_type", F.when(F.col("content_type").isNotNull(), F.col("pos")))
    return members.groupBy("unit_id").agg(known.alias("content_type"), F.count("*").alias("n_members"))


def pending(units: DataFrame, done: DataFrame) -> DataFrame:
    return units.join(done.select("unit_id").distinct(), "unit_id", "left_anti")


def progress(units: DataFrame, done: DataFrame) -> DataFrame:
    """``units(unit_id, n_members)`` against finished units: completed members, percentage and status."""
    state = units.join(done.select("unit_id").distinct().withColumn("ok", F.lit(1)), "unit_id", "left")
    out = state.agg(
        F.coalesce(F.sum("n_members"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("ok") == 1, F.col("n_members"))), F.lit(0)).alias("completed"),
        F.count("*").alias("units"), F.coalesce(F.sum("ok"), F.lit(0)).alias("units_done"),
    )
    pct = F.round(F.when(F.col("total") > 0, F.col("completed") * 100.0 / F.col("total")).otherwise(100.0), 2)
    return out.withColumn("progress_pct", pct).withColumn("status", F.when(F.col("units") == F.col("units_done"), "completed").otherwise("running"))


def contiguous_offset(expected: DataFrame, done: DataFrame) -> DataFrame:
    """The end offset before which every chunk of ``expected(start, stop)`` is done, and rows done in all."""
    state = expected.join(done.select("start").distinct().withColumn("ok", F.lit(1)), "start", "left")
    return state.agg(
        F.coalesce(F.min(F.when(F.col("ok").isNull(), F.col("start"))), F.max("stop"), F.lit(0)).alias("safe_offset"),
        F.coalesce(F.sum(F.when(F.col("ok") == 1, F.col("stop") - F.col("start"))), F.lit(0)).alias("rows_done"),
    )


def context_difference(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Fields ``(key, value)`` that differ; what is not stored is not compared."""
    both = stored.withColumnRenamed("value", "stored").join(asked.withColumnRenamed("value", "asked").hint("merge"), "key", "full")
    return both.where("stored is not null and not (stored <=> asked)")


def part_of(rows: DataFrame, order: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A stretch of the rows along ``order`` (unique), for trial runs; all rows without limit and offset."""
    out = rows.orderBy(order).offset(offset) if offset or limit is not None else rows
    return out.limit(limit) if limit is not None else out


def representatives(members: DataFrame) -> DataFrame:
    """One text to look up for each unit of ``(unit_id, pos, source, template)``: its template if it has one, else its first source."""
    first = F.min_by("source", "pos")
    named = F.min_by("template", F.when(F.coalesce("template", F.lit("")) != "", F.col("pos")))
    return members.groupBy("unit_id").agg(F.coalesce(named, first).alias("query"))


def outcome_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("outcome").agg(F.count("*").alias("n_files"))


def merge_direct(direct: DataFrame, rest: DataFrame) -> DataFrame:
    """Rows answered directly, and the others', by row_id; a direct answer wins."""
    return direct.unionByName(rest.join(direct.select("row_id"), "row_id", "left_anti"))
