"""Dense top-N by an inverted file of cells with exact bounds.

Centroids are trained on a bounded sample. Every vector lies in the cell of its nearest centroid, cells are cut into blocks, and a
block knows the greatest angle between its centroid and a member. By the triangle inequality no member is nearer to a
query than the angle to the centroid less that one. Each query first visits the blocks with the highest bounds that hold n
vectors; then those alone whose bound reaches the n-th best cosine found. Nothing is missed: the sample only decides how
many blocks are visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmengine.operators.retrieve import _sound, _unit, top
from tmengine.tables import written

#: Vectors that centroids are trained on, at most; rounds of training; vectors of a block; queries of a block scored at once.
SAMPLE, ROUNDS, BLOCK, QUERIES = 20_000, 6, 1_024, 512
#: Slack of bounds against the cosines' rounding to six places.
_SLACK = 2e-6


def centroids(index: DataFrame, cells: int, dim: int) -> np.ndarray:
    """Unit centroids of vectors of one length, by spherical k-means on up to ``SAMPLE`` of them; the seed is fixed."""
    rows = index.where(F.size("vector") == dim).orderBy(F.xxhash64("pair_id")).limit(SAMPLE).select("vector").collect()
    held = [np.asarray(r["vector"], float) for r in rows if _sound(r["vector"])]
    if not held:
        return np.zeros((0, dim))
    points = _unit(np.stack(held))
    middle = points[np.random.default_rng(5).permutation(len(points))[: min(cells, len(points))]]
    for _ in range(ROUNDS):
        near = (points @ middle.T).argmax(1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near, points)
        size = np.linalg.norm(sums, axis=1)
        middle = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], middle)
    return middle


def inverted_file(index: DataFrame, cells: int | None = None) -> DataFrame:
    """Blocks ``(block, dim, size, centroid, radius, ids, values)`` of the index ``(pair_id, vector)``, written out.

    Null, empty, zero and non-finite vectors are left out; vectors of different lengths are in different blocks.
    """
    sizes = {r["d"]: r["count"] for r in index.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).count().collect()}  # lengths are few
    trained = {d: centroids(index, cells or max(1, min(1_024, int((n / 16) ** 0.5) + 1)), d) for d, n in sizes.items()}
    shared = index.sparkSession.sparkContext.broadcast(trained)  # at most 1024 a length

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["vector"].map(_sound)]
            for dim, part in batch.groupby(batch["vector"].map(len)):
                unit = _unit(np.stack(part["vector"].to_numpy()))
                middle = shared.value[dim]
                cell = (unit @ middle.T).argmax(1) if len(middle) else np.zeros(len(unit), int)
                yield pd.DataFrame({"dim": np.int32(dim), "cell": cell.astype(np.int32), "pair_id": part["pair_id"].to_numpy(), "unit": [u.tobytes() for u in unit]})

    slim = index.select("pair_id", F.col("vector").cast("array<double>").alias("vector"))
    rows = written(slim.mapInPandas(placed, "dim int, cell int, pair_id long, unit binary"))
    counts = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces"))  # fewer than 1024 a length
    rows = rows.join(F.broadcast(counts), ["dim", "cell"]).withColumn("piece", F.pmod(F.xxhash64("pair_id"), F.col("pieces")).cast("int"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        dim, cell = int(part["dim"].iloc[0]), int(part["cell"].iloc[0])
        unit = np.frombuffer(b"".join(part["unit"]), float).reshape(-1, dim)
        middle = shared.value[dim][cell] if len(shared.value[dim]) else unit[0]
        radius = float(np.arccos(np.clip(unit @ middle, -1, 1)).max())
        name = (dim << 44) | (cell << 32) | int(part["piece"].iloc[0])
        return pd.DataFrame({"block": [name], "dim": [dim], "size": [len(unit)], "centroid": [middle], "radius": [radius], "ids": [part["pair_id"].to_numpy()], "values": [unit.tobytes()]})

    schema = "block long, dim int, size int, centroid array<double>, radius double, ids array<long>, values binary"
    return written(rows.groupBy("dim", "cell", "piece").applyInPandas(pack, schema))


def _bounded(queries: DataFrame, blocks: DataFrame, n: int, first: bool) -> DataFrame:
    """``(query_id, block)``: with ``first`` each query's best blocks that hold n vectors, else those that reach its ``floor``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_ids, q_values, floors, names, dim, middles, radii, sizes in batch.itertuples(index=False):
                asked, middle = (np.frombuffer(v, float).reshape(-1, dim) for v in (q_values, middles))
                angle = np.arccos(np.clip(asked @ middle.T, -1, 1)) - np.asarray(radii)[None, :]
                bound = np.cos(np.maximum(angle, 0.0)) + _SLACK
                if first:  # of this pack of blocks; the best of all packs are taken below
                    order = np.argsort(-bound, axis=1, kind="stable")
                    before = np.cumsum(np.asarray(sizes)[order], axis=1) - np.asarray(sizes)[order]
                    q, at = np.nonzero(before < n)
                    b = order[q, at]
                else:
                    q, b = np.nonzero(bound >= np.asarray(floors)[:, None])
                yield pd.DataFrame({"query_id": np.asarray(q_ids)[q], "block": np.asarray(names)[b], "bound": bound[q, b], "size": np.asarray(sizes)[b]})

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                middle = np.stack(part["centroid"].to_numpy())
                yield pd.DataFrame({"names": [part["block"].to_numpy()], "b_dim": [dim], "middles": [middle.tobytes()], "radii": [part["radius"].to_numpy()], "sizes": [part["size"].to_numpy()]})

    summaries = written(blocks.select("block", "dim", "size", "centroid", "radius").mapInPandas(group, "names array<long>, b_dim int, middles binary, radii array<double>, sizes array<int>"))
    met = summaries.join(queries.hint("shuffle_replicate_nl"), F.col("b_dim") == F.col("dim"))  # packs of blocks' summaries by packs of the stated queries
    met = met.select("q_ids", "q_values", "floors", "names", "dim", "middles", "radii", "sizes")
    out = met.mapInPandas(run, "query_id long, block long, bound double, size int")
    if first:
        ahead = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0))).where(F.col("before") < n)
    return out.select("query_id", "block")


def _scored(pairs: DataFrame, vectors: DataFrame, blocks: DataFrame, n: int, least: float) -> DataFrame:
    """The n best of each query in each block it visits; queries of a block are packed, so a visit costs no row but a result."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, part in batch.groupby("block"):
                for at in range(0, len(part), QUERIES):
                    some = part.iloc[at : at + QUERIES]
                    yield pd.DataFrame({"block": [block], "q_ids": [some["query_id"].to_numpy()], "q_values": [b"".join(some["unit"])], "floors": [some["floor"].to_numpy()]})

    asked = written(pairs).join(vectors.hint("merge"), "query_id")
    spread = asked.repartition(parts, "block", F.pmod(F.xxhash64("query_id"), F.lit(4))).sortWithinPartitions("block", "query_id")
    packs = written(spread.select("block", "query_id", "unit", "floor").mapInPandas(pack, "block long, q_ids array<long>, q_values binary, floors array<double>"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_ids, q_values, floors, dim, ids, values in batch.itertuples(index=False):
                asked, rows = (np.frombuffer(v, float).reshape(-1, dim) for v in (q_values, values))
                cosines = np.round(asked @ rows.T, 6)
                floor = np.maximum(np.asarray(floors), least)
                if len(rows) > n:
                    floor = np.maximum(floor, np.partition(cosines, len(rows) - n, axis=1)[:, len(rows) - n])
                q, i = np.nonzero(cosines >= floor[:, None])
                order = np.lexsort((np.asarray(ids)[i], -cosines[q, i], q))
                q, i = q[order], i[order]
                few = np.arange(len(q)) - np.searchsorted(q, q) < n
                q, i = q[few], i[few]
                yield pd.DataFrame({"query_id": np.asarray(q_ids)[q], "pair_id": np.asarray(ids)[i], "score": cosines[q, i]})

    met = packs.join(blocks.select("block", "dim", "ids", "values").hint("merge"), "block").select("q_ids", "q_values", "floors", "dim", "ids", "values")
    return met.mapInPandas(best, "query_id long, pair_id long, score double")


def dense_hits(queries: DataFrame, index: DataFrame, n: int, least: float = -1.0, cells: int | None = None, counts: dict | None = None) -> DataFrame:
    """``retrieve.dense_scores``, with the same rows, visiting only blocks that can hold one; ``counts`` takes the visits (tests)."""
    blocks = inverted_file(index, cells)

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["vector"].map(_sound)]
            yield pd.DataFrame({"query_id": batch["query_id"].to_numpy(), "dim": batch["vector"].map(len).astype("int32"), "unit": [_unit(np.asarray(v, float)[None, :])[0].tobytes() for v in batch["vector"]]})

    def packs(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, part in batch.groupby("dim"):
                    for at in range(0, len(part), QUERIES):
                        some = part.iloc[at : at + QUERIES]
                        yield pd.DataFrame({"q_ids": [some["query_id"].to_numpy()], "dim": [dim], "q_values": [b"".join(some["unit"])], "floors": [some["floor"].to_numpy()]})

        return written(rows.select("query_id", "dim", "unit", "floor").mapInPandas(run, "q_ids array<long>, dim int, q_values binary, floors array<double>"))

    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(unit, "query_id long, dim int, unit binary")
    asked = written(asked.withColumn("floor", F.lit(float(least))))
    early = written(_bounded(packs(asked), blocks, n, first=True))
    found = written(_scored(early, asked, blocks, n, least))
    floors = top(found, n).where(F.col("nth") == n).select("query_id", F.col("score").alias("_floor"))
    again = written(asked.join(floors.hint("merge"), "query_id", "left").withColumn("floor", F.greatest("floor", F.coalesce("_floor", F.col("floor")))).drop("_floor"))
    late = written(_bounded(packs(again), blocks, n, first=False).join(early.hint("merge"), ["query_id", "block"], "left_anti"))
    more = _scored(late, again, blocks, n, least)
    if counts is not None:
        counts |= {"visits": early.count() + late.count(), "blocks": blocks.count()}
    return top(found.unionByName(more), n)
