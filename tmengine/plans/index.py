"""The memory index as a table of buckets: loads that touch only their pairs' buckets, with kept token frequencies."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tmengine import schemas
from tmengine.functions.text import memory_text
from tmengine.operators import memory, textindex
from tmengine.sources import buckets
from tmengine.tables import discard, written

POINTS, TOKENS = "points", "tokens"
#: Versions that stay readable after a load.
KEEP = 2


def _pair_bucket(n: int) -> Column:
    """Buckets go by the cleaned pair, so a pair's points of every status are together."""
    return buckets.bucket_of(n, *[memory_text(F.coalesce(c, F.lit(""))) for c in memory.PAIR])


def points(spark: SparkSession, root: str) -> DataFrame | None:
    return buckets.read(spark, root, POINTS, buckets.load(spark, root))


def frequencies(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame] | None:
    """The kept ``(token, df)`` of all points' sources and the number of points, as one row (n)."""
    held = buckets.load(spark, root)
    if held is None:
        return None
    return buckets.read(spark, root, TOKENS, held), spark.range(1).select(F.lit(held.facts["points"]).cast("long").alias("n"))


def load(
    spark: SparkSession, root: str, candidates: DataFrame, namespace: uuid.UUID, collection: str | None = None, embed=None, n_buckets: int = 64, batch: str | None = None
) -> int | None:
    """Import candidates (row_id, source, target, status, ...) into the index at ``root``; returns the new version.

    Only buckets with a pair of the candidates are read and written again, and only token counts of texts that went
    or came change. Points and counts are published together. A ``batch`` that the newest version has seen already
    is not loaded again (None): a load repeated after a crash before publishing plans the same as the first time.
    """
    held = buckets.load(spark, root) or buckets.Manifest(buckets=n_buckets, facts={"points": 0, "batches": []})
    if batch is not None and batch in held.facts["batches"]:
        return None
    rows = written(candidates)
    n = held.buckets
    touched = [r["b"] for r in rows.select(_pair_bucket(n).alias("b")).distinct().collect()]  # at most n numbers
    index = buckets.read(spark, root, POINTS, held, touched)
    index = spark.createDataFrame([], schemas.INDEX) if index is None else index
    plan = written(memory.import_plan(rows, index))
    vectors = memory.plan_vectors(plan, index, embed) if embed else None
    made = memory.apply_plan(plan, index, namespace, vectors, collection)
    made = written(made.select(*[F.col(c).cast(t).alias(c) for c, t in index.dtypes]))
    come = made.join(index.select("pair_id").hint("merge"), "pair_id", "left_anti")
    gone = index.join(made.select("pair_id").hint("merge"), "pair_id", "left_anti")
    buckets.changed(held, POINTS, touched, buckets.stage(made, root, _pair_bucket(n)))
    _count_tokens(spark, root, held, *[written(textindex.postings(x, "pair_id", "source")) for x in (gone, come)])
    held.facts["points"] += come.count() - gone.count()
    if batch is not None:
        held.facts["batches"] = [*held.facts["batches"], batch][-100:]
    version = buckets.publish(spark, root, held)
    buckets.retire(spark, root, KEEP)
    for table in (rows, plan, made):
        discard(table)
    return version


def _count_tokens(spark: SparkSession, root: str, held: buckets.Manifest, gone: DataFrame, come: DataFrame) -> None:
    place = buckets.bucket_of(held.buckets, "token")
    touched = [r["b"] for r in gone.select("token").union(come.select("token")).select(place.alias("b")).distinct().collect()]
    kept = buckets.read(spark, root, TOKENS, held, touched)
    kept = spark.createDataFrame([], "token string, df long") if kept is None else kept
    buckets.changed(held, TOKENS, touched, buckets.stage(textindex.changed_frequencies(kept, gone, come), root, place))
