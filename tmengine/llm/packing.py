"""Packing by optimal length buckets: dynamic programming picks the boundaries, batches fill a token budget."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmengine.llm.common import partitions_for, ranked

WORD = r"[^\x20\x09-\x0D]+"

#: Lengths are rounded up to a grid whose steps grow by this share, so the histogram stays small at any scale.
GRID_STEPS_PER_OCTAVE = 32


def grid_length(tokens: Column) -> Column:
    """The smallest grid length that is at least ``tokens``: exact to 32, then 32 steps per doubling."""
    octave = F.floor(F.log2(tokens.cast("double")))
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), octave - int(math.log2(GRID_STEPS_PER_OCTAVE))))
    return F.when(tokens <= GRID_STEPS_PER_OCTAVE, tokens).otherwise((F.ceil(tokens / step) * step).cast("long")).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], totals: list[int], buckets: int) -> tuple[list[int], int]:
    """Boundaries (ascending, the last is the largest length) that minimise the padding, and that padding.

    ``lengths`` are the candidate boundaries, ascending; a row of true length l in cell i pads to the boundary
    of its bucket. Exact dynamic programme over prefixes: best[k][j] = min over i of best[k-1][i] + cost(i, j).
    """
    m = len(lengths)
    if not m:
        return [], 0
    size = np.array(lengths, np.float64)
    n = np.concatenate([[0.0], np.cumsum(np.array(counts, np.float64))])
    t = np.concatenate([[0.0], np.cumsum(np.array(totals, np.float64))])
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, m)):
        following, cut = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        following[0] = 0.0
        for j in range(1, m + 1):
            cost = best[:j] + (n[j] - n[:j]) * size[j - 1] - (t[j] - t[:j])
            cut[j] = int(np.argmin(cost))
            following[j] = cost[cut[j]]
        best, cuts = following, [*cuts, cut]
    ends, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    return ends[::-1], int(best[m])


def pack(docs: DataFrame, budget: int = 32_768, buckets: int = 16) -> DataFrame:
    """Batches of similar length: doc_id, n_tokens, bucket, bucket_length, batch_id, row_in_batch, padding.

    Tokens are words. The histogram covers all rows and has at most 32 cells per doubling of the length, each
    with its longest row as a possible boundary; each row goes to the first boundary that holds it; a batch holds floor(budget / bucket_length) rows, at
    least one, so a text longer than the budget is a batch of its own and is never cut. Batches are cut along
    (bucket, n_tokens, doc_id). Null or empty text: 0 tokens, in the first bucket with length counted as 1;
    ties and repeated rows are separate rows; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    slim = slim.withColumn("_cell", grid_length(F.greatest(F.col("n_tokens"), F.lit(1))))
    placed, _ = ranked(slim, ["n_tokens", "doc_id"], partitions_for(docs))
    cells = placed.groupBy("_cell").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.greatest(F.max("n_tokens"), F.lit(1)).alias("top")).orderBy("_cell").collect()
    ends, _ = best_boundaries([r["top"] for r in cells], [r["n"] for r in cells], [r["t"] for r in cells], buckets)
    table, before, k = [], 0, 0
    for i, end in enumerate(ends):
        first = before
        while k < len(cells) and cells[k]["top"] <= end:
            before += cells[k]["n"]
            table.append((int(cells[k]["_cell"]), i, end, max(1, budget // end), first))
            k += 1
    #: one row per grid cell, so at most 32 a doubling
    plan = spark.createDataFrame(table or [(0, 0, 0, 1, 0)], "_cell long, bucket int, bucket_length long, capacity long, first long")
    out = placed.join(F.broadcast(plan), "_cell")
    position = F.col("rank") - F.col("first")
    return out.select(
        "doc_id", "n_tokens", "bucket", "bucket_length",
        F.format_string("%02d-%010d", F.col("bucket"), F.floor(position / F.col("capacity"))).alias("batch_id"),
        (position % F.col("capacity")).alias("row_in_batch"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
