"""Durable intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of up to this many rows, counted, may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and all tasks run on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tmengine-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut durably and sizes are true."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    They go once nothing on the driver refers to them, which it only notices when it collects garbage; in a loop
    of many small jobs that comes too late for the disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
