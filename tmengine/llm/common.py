"""Helpers shared by the operators: durable intermediate tables, components, global ranks, Arrow text access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmengine.operators.graph import components, salted, with_minimum
from tmengine.tables import BROADCAST_ROWS, discard, shared_dir
from tmengine.tables import written as materialize

__all__ = ["BROADCAST_ROWS", "LOWER_AZ", "components", "discard", "materialize", "partitions_for", "ranked", "salted", "shared_dir", "texts", "with_minimum"]


def ranked(df: DataFrame, order: list[str], partitions: int, rank: str = "rank") -> tuple[DataFrame, int]:
    """Add the gapless position of each row under ``order`` (which should be a total order); returns it and the row count.

    Range partitioning spreads the rows evenly, each partition is sorted alone, and only one count per
    partition reaches the driver. The sorted table is written first, so positions cannot change on recovery.
    """
    spark = df.sparkSession
    laid = (
        df.repartitionByRange(partitions, *[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn("_at", F.monotonically_increasing_id())
    )
    laid = materialize(laid)
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in laid.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((int(p), before))
        before += counts[p]
    starts = spark.createDataFrame(offsets or [(0, 0)], "p long, start long")
    out = laid.withColumn("_p", part).join(F.broadcast(starts), F.col("_p") == F.col("p"))
    out = out.withColumn(rank, F.col("start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_p", "p", "start", "_at"), before


def partitions_for(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value, straight from the Arrow buffers; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = memoryview(column.buffers()[2] or b"")
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    for a, z, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid.tolist()):
        yield bytes(data[a:z]) if ok else b""


LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
