"""Hilbert-curve ordering: shards as equal runs along a curve over several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmengine.llm.common import BROADCAST_ROWS, partitions_for, ranked, salted


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer cells, shape (rows, dimensions), each below ``2**bits``.

    The cells' axes are turned into the curve's transposed form bit by bit (undoing rotations and
    exchanges, then Gray-coding), and the bits are interleaved.
    """
    axes = [cells[:, k].astype(np.uint64) for k in range(cells.shape[1])]
    n, one = len(axes), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        low = bit - one
        for k in range(n):
            inverted = (axes[k] & bit) != 0
            swap = np.where(inverted, np.uint64(0), (axes[0] ^ axes[k]) & low)
            axes[0] = np.where(inverted, axes[0] ^ low, axes[0] ^ swap)
            if k:
                axes[k] = axes[k] ^ swap
    for k in range(1, n):
        axes[k] = axes[k] ^ axes[k - 1]
    flip = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        flip = np.where(axes[n - 1] & bit, flip ^ (bit - one), flip)
    out = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            out = (out << one) | (((axes[k] ^ flip) >> np.uint64(level)) & one)
    return out.astype(np.int64)


def category_cells(df: DataFrame, column: str, bits: int, by: str) -> DataFrame:
    """Add ``_cell_<column>``: values in order spread over the cells, so equal and neighbouring values stay together.

    The distinct values are ranked by range partitions, whatever their number, and joined back: as a broadcast
    of up to ``BROADCAST_ROWS`` counted values, else by value and piece, so a hot value's rows are spread.
    """
    top, name = (1 << bits) - 1, f"_cell_{column}"
    spread = salted(df, by)
    values = spread.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.collect_set("_salt").alias("_salts"))
    placed, n = ranked(values, ["_v"], partitions_for(df), "_place")
    cells = placed.select("_v", "_salts", F.expr(f"1 + _place * {top} div {max(n, 1)}").cast("long").alias(name))
    if n <= BROADCAST_ROWS:
        joined = df.join(F.broadcast(cells.drop("_salts")), F.col(column) == F.col("_v"), "left")
    else:
        cells = cells.select("_v", name, F.explode("_salts").alias("_piece"))
        joined = spread.join(cells.hint("merge"), (F.col(column) == F.col("_v")) & (F.col("_salt") == F.col("_piece")), "left").drop("_salt", "_piece")
    return joined.drop("_v").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def number_cell(value: Column, low: float, high: float, bits: int) -> Column:
    top = (1 << bits) - 1
    share = (value.cast("double") - F.lit(low)) / F.lit(max(high - low, 1e-9))
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(top), F.floor(share * top))), F.lit(0)).cast("long")


def hilbert_shards(docs: DataFrame, n_shards: int = 16, bits: int = 8) -> DataFrame:
    """Cut ``docs`` into ``n_shards`` runs of the Hilbert curve over (lang, source, log size, doc_id).

    Result: every row once, as doc_id, size, text_crc32, lang, source, curve, shard, slot. Law ``rows``:
    shard row counts differ by at most one, and slots are 0, 1, ... within a shard along the curve. Only
    metadata is shuffled; texts are read once for size and checksum. Null text: size 1, checksum of the
    empty string; null lang, source or doc_id: cell 0; ties and repeated rows are ordered by doc_id,
    checksum and size; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    cells = category_cells(category_cells(slim, "lang", bits, "doc_id"), "source", bits, "doc_id")
    cells = cells.withColumn("_cell_size", number_cell(F.log2("size"), 0.0, 32.0, bits))
    cells = cells.withColumn("_cell_id", number_cell(F.col("doc_id"), float(ends["low"] or 0), float(ends["high"] or 0), bits))

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([a, b, c, d]), bits))

    cells = cells.withColumn("curve", curve("_cell_source", "_cell_lang", "_cell_size", "_cell_id"))
    cells = cells.drop("_cell_source", "_cell_lang", "_cell_size", "_cell_id")
    placed, n = ranked(cells, ["curve", "doc_id", "text_crc32", "size"], partitions_for(docs, n_shards))
    shard = F.expr(f"cast(((rank + 1) * {n_shards} - 1) div {max(n, 1)} as int)")
    placed = placed.withColumn("shard", shard)
    start = F.expr(f"(cast(shard as bigint) * {n}) div {n_shards}")
    return placed.withColumn("slot", F.col("rank") - start).drop("rank")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents as one folder per shard, rows along the curve, for file pruning by any dimension.

    Rows are range-partitioned along (shard, slot), so a shard is written by as many tasks as its size asks for.
    Rows equal in doc_id and text are written each, at the first one's place.
    """
    first = F.min(F.struct("shard", "slot")).alias("at")
    keys = placed.groupBy("doc_id", "text_crc32").agg(first).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "at.shard", "at.slot")
    text = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rows = docs.drop("shard", "slot", "_at").withColumn("_at", text)
    rows = rows.join(keys.hint("merge"), rows["doc_id"].cast("long").eqNullSafe(keys["_id"]) & (rows["_at"] == keys["_crc"])).drop("_id", "_crc", "_at")
    rows.repartitionByRange(partitions_for(docs), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = hilbert_shards(docs, 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", "lang", "source",
    )
