"""Restartable incremental loads and exactly-once results with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tmengine.operators import units
from tmengine.operators.enrich import CACHE, cache_with, enriched
from tmengine.plans import index
from tmengine.sources import buckets, sinks
from tmengine.tables import written


def ingest_memory(
    spark: SparkSession, folder: str, root: str, checkpoint: str, namespace: uuid.UUID, files_a_batch: int = 100, collection: str | None = None, embed=None, n_buckets: int = 64
) -> StreamingQuery:
    """Load new corpus files (Parquet rows source, target, status) of ``folder`` into the bucketed index at ``root``.

    Each micro-batch is planned against the buckets of its pairs and changes only those. The checkpoint folder
    holds what has been read; a batch that is repeated after a crash is known to the index if it was published, and
    loaded as the first time if it was not.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("row_id", F.monotonically_increasing_id())
        index.load(batch.sparkSession, root, rows, namespace, collection, embed, n_buckets, f"{checkpoint}#{batch_id}")

    stream = spark.readStream.schema("source string, target string, status string").option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_units(
    spark: SparkSession, folder: str, results: str, checkpoint: str, task_id: str, answer: Callable[[DataFrame], DataFrame], context: dict[str, str] | None = None
) -> StreamingQuery:
    """Answer unit files (unit_id, message) with ``answer`` and append ``(unit_id, raw, error, pos, saved_at)`` once a unit.

    A task that has been begun with another ``context`` (project, languages, ...) is not resumed but refused. An
    answer of a unit with failed attempts only is appended again; ``latest_results`` picks the good one.
    """
    held = f"{results.rstrip('/')}-contexts"
    fs, target = sinks._files(spark, held)
    if context:
        asked = spark.createDataFrame(list(context.items()), "key string, value string")
        stored = spark.read.parquet(held).where(F.col("task_id") == task_id).select("key", "value") if fs.exists(target) else asked.limit(0)
        differing = [r["key"] for r in units.context_difference(stored, asked).collect()]  # fields of one task
        if differing:
            raise ValueError(f"task {task_id} was begun with other values of {', '.join(sorted(differing))}")
        if stored.isEmpty():
            sinks.append_results(asked.withColumn("task_id", F.lit(task_id)), held)

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh = batch.dropDuplicates(["unit_id"])
        fs, target = sinks._files(session, results)
        if fs.exists(target):
            done = session.read.parquet(results).where((F.col("task_id") == task_id) & F.col("error").isNull())
            fresh = units.pending(fresh, done)
        done = answer(fresh)
        done = done if "pos" in done.columns else done.withColumn("pos", F.lit(0))
        sinks.append_results(done.withColumn("saved_at", F.current_timestamp()).withColumn("task_id", F.lit(task_id)), results)

    stream = spark.readStream.schema("unit_id string, message string").parquet(folder)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CACHED, TRIED = "cache", "tried"


def cached(spark: SparkSession, root: str) -> DataFrame | None:
    return buckets.read(spark, root, CACHED, buckets.load(spark, root))


def tried(spark: SparkSession, root: str) -> DataFrame | None:
    """Every lookup that was made: ``(key, query, found)``."""
    return buckets.read(spark, root, TRIED, buckets.load(spark, root))


def add_to_cache(spark: SparkSession, root: str, asked: DataFrame, fetch: Callable[[str], str | None], n_buckets: int = 64, batch: str | None = None) -> None:
    """Look up the keys of ``asked(key, query)`` that the cache at ``root`` lacks, and add them; only their buckets are read and written."""
    held = buckets.load(spark, root) or buckets.Manifest(buckets=n_buckets, facts={"batches": []})
    if batch is not None and batch in held.facts["batches"]:
        return
    asked = written(asked.select("key", "query").dropDuplicates(["key"]))
    place = buckets.bucket_of(held.buckets, "key")
    touched = [r["b"] for r in asked.select(place.alias("b")).distinct().collect()]  # at most as many as buckets
    cache = buckets.read(spark, root, CACHED, held, touched)
    cache = spark.createDataFrame([], CACHE) if cache is None else cache
    got = written(enriched(asked.join(cache.select("key").hint("merge"), "key", "left_anti"), fetch))
    buckets.changed(held, CACHED, touched, buckets.stage(cache_with(cache, got), root, place))
    made = got.select("key", "query", F.col("body").isNotNull().alias("found"))
    before = buckets.read(spark, root, TRIED, held, touched)
    buckets.changed(held, TRIED, touched, buckets.stage(made if before is None else before.unionByName(made), root, place))
    if batch is not None:
        held.facts["batches"] = [*held.facts["batches"], batch][-100:]
    buckets.publish(spark, root, held)
    buckets.retire(spark, root)


def fill_cache(spark: SparkSession, folder: str, root: str, checkpoint: str, fetch: Callable[[str], str | None], expiry: str | None = None, files_a_batch: int = 100) -> StreamingQuery:
    """Look up requested keys (key, query) once each, however often they are asked for, into the bucketed cache at ``root``.

    A lookup that fails is tried again whenever its key is asked for. With ``expiry`` (an interval), requests also
    have asked_at, and a key asked for again within that time of its first request is not looked up again even if that failed.
    The keys in flight are the stream's state, which survives restarts; a key leaves it once the watermark passes its expiry.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        add_to_cache(batch.sparkSession, root, batch, fetch, batch=f"{checkpoint}#{batch_id}")

    columns = "key string, query string" + (", asked_at timestamp" if expiry else "")
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    if expiry:
        stream = stream.withWatermark("asked_at", expiry).dropDuplicatesWithinWatermark(["key"])
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
