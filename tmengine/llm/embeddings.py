"""Embedding near-dedup by spherical-cap filters.

Filter directions are a random product code: the (randomly rotated) space is cut into blocks, every block has its own
random unit vectors, and a direction is one vector from each block. A vector is decoded to the list of all directions
that exceed its threshold, by extending partial sums block by block and dropping those that cannot reach it any more.
The threshold is the vector's own best direction less ``slack``, so no vector is left without a filter: two vectors v
and w give any direction scores within |v - w| of each other, hence a slack of 2|v - w| (0.4 at cosine 0.98) could
miss nothing; as differences concentrate near |v - w| / sqrt(d), one of 1.75 such deviations finds all but very few.
The number of directions grows with the rows, so that filters stay small and a vector is in few of them.
Vectors that share a filter are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmengine.llm.common import BROADCAST_ROWS, components, materialize, partitions_for, salted, with_minimum
from tmengine.llm.simhash import _Links

#: Vectors of one filter that are compared in one piece; larger filters are cut into chunks of about this size.
CHUNK = 2_000


@lru_cache(maxsize=8)
def product_code(dim: int, blocks: int, words: int, seed: int = 11) -> tuple[np.ndarray, list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    code = []
    for part in np.array_split(np.arange(dim), min(blocks, dim)):
        c = rng.normal(size=(words, len(part)))
        code.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(min(blocks, dim)))
    return rotation, code


def words_for(n: int, points: int = 32) -> int:
    """Random vectors in each of two blocks for ``n`` rows: about one direction for every ``points`` of them."""
    return min(4096, max(16, math.isqrt(n // points)))


def slack_for(dim: int, least: float) -> float:
    """1.75 deviations of the scores of a pair at the threshold: 0.044 at cosine 0.98 and 64 dimensions."""
    return 1.75 * math.sqrt(2 - 2 * least) / math.sqrt(dim)


def decode(vectors: np.ndarray, blocks: int, words: int, slack: float) -> list[np.ndarray]:
    """For each unit vector the sorted keys of all directions whose score is within ``slack`` of its best one."""
    rotation, code = product_code(vectors.shape[1], blocks, words)
    turned = vectors @ rotation
    cuts = np.cumsum([0, *(c.shape[1] for c in code)])
    scores = [turned[:, a:z] @ c.T for a, z, c in zip(cuts[:-1], cuts[1:], code)]
    tops = np.stack([s.max(1) for s in scores], 1)
    later = np.concatenate([np.cumsum(tops[:, ::-1], 1)[:, ::-1][:, 1:], np.zeros((len(vectors), 1))], 1)
    least = tops.sum(1) - slack
    out = []
    for i in range(len(vectors)):
        total, key = np.zeros(1), np.zeros(1, np.int64)
        for k, s in enumerate(scores):
            grown = total[:, None] + s[i][None, :]
            alive = grown + later[i, k] >= least[i]
            key = (key[:, None] * words + np.arange(words)[None, :])[alive]
            total = grown[alive]
        out.append(np.sort(key))
    return out


def piece_links(unit: np.ndarray, filters: pa.ListArray, key: int, side: np.ndarray, split: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one filter's unit vectors with cosine of at least ``least`` that share no smaller filter.

    If ``split``, only pairs across the two sides are wanted: pairs within a side belong to other pieces.
    """
    first, second = [], []
    for at in range(0, len(unit), 1024):
        near = (unit[at : at + 1024] @ unit[at:].T) >= least
        near = np.triu(near, 1)
        if split:
            near &= side[at : at + 1024, None] != side[None, at:]
        i, j = np.nonzero(near)
        first.append(i + at)
        second.append(j + at)
    a, b = np.concatenate(first), np.concatenate(second)
    if not len(a):
        return a, b
    met = np.unique(np.concatenate([a, b]))
    lists = filters.take(pa.array(met))
    values, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(met)), np.diff(lists.offsets.to_numpy()))
    owner, values = owner[values < key], values[values < key]
    if len(values):
        names, column = np.unique(values, return_inverse=True)
        has = np.zeros((len(met), len(names)), np.float32)
        has[owner, column] = 1
        shared = has @ has.T
        alone = shared[np.searchsorted(met, a), np.searchsorted(met, b)] == 0
        a, b = a[alone], b[alone]
    return a, b


def embedding_links(vectors: DataFrame, least: float = 0.98, blocks: int = 2) -> DataFrame:
    """Add n_links and component_id to ``(vec_id, embedding, label)``; see ``op7``'s contract for both.

    Vectors are compared only when their labels and lengths are equal. Null, zero or non-finite vectors, null
    components and null labels link with nothing. Equal vectors are one point with a count, so copies are not
    paired; a filter with many points is cut into chunks compared piece by piece. A row with a null vec_id
    takes part and never names a component; repeated rows count as further vectors; an empty table gives no
    rows; other columns are dropped.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label")
    )
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("sound", F.coalesce(sound & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    point = F.when(F.col("sound"), F.xxhash64("label", "embedding"))
    ids = salted(materialize(rows.select("vec_id", point.alias("point"))), "vec_id")
    words = words_for(ids.count())
    points = rows.where("sound").groupBy(point.alias("point")).agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["embedding"].map(len)):
                v = np.stack(part["embedding"].to_numpy())
                v = v / np.abs(v).max(axis=1, keepdims=True)
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                found = decode(v, blocks, words, slack_for(v.shape[1], least))
                yield pd.DataFrame({"point": part["point"].to_numpy(), "label": part["label"].to_numpy(), "embedding": list(v), "filters": found})

    copies = ids.where("point is not null").groupBy("point").agg(F.count("*").alias("copies"))
    coded = points.mapInPandas(code, "point long, label string, embedding array<double>, filters array<long>")
    coded = materialize(coded.join(copies.hint("merge"), "point"))
    where = ["label", "dim", "filter"]
    listed = coded.select("label", F.size("embedding").alias("dim"), F.explode("filters").alias("filter"), "point")
    large = listed.groupBy(*where).agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    large = materialize(large.select(*where, F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    few = large.count() <= BROADCAST_ROWS
    full = coded.select("*", F.size("embedding").alias("dim"), F.explode("filters").alias("filter"))
    full = full.join(F.broadcast(large) if few else large.hint("merge"), where, "left")
    full = full.withColumn("chunk", F.pmod(F.xxhash64("point"), F.coalesce("chunks", F.lit(1))).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    full = full.withColumn("lower", F.least("chunk", "other")).withColumn("upper", F.greatest("chunk", "other"))
    piece = [*where, "lower", "upper"]
    full = full.select(*piece, "chunk", "point", "copies", "embedding", "filters")
    full = full.repartition(partitions_for(full), *piece).sortWithinPartitions(*piece, "point")

    def links_of(part: dict, a: int, z: int) -> np.ndarray | None:
        """Rows (point, point, links): each point's number of links, then links that connect the points."""
        offsets, filters = part["offsets"], part["filters"].slice(a, z - a)
        unit = part["values"][offsets[a] : offsets[z]].reshape(z - a, -1)
        i, j = piece_links(unit, filters, part["filter"][a], part["chunk"][a:z], part["lower"][a] != part["upper"][a], least)
        if not len(i):
            return None
        n, name = part["copies"][a:z], part["point"][a:z]
        count = np.bincount(i, n[j], z - a) + np.bincount(j, n[i], z - a)
        some, forest = np.flatnonzero(count), _Links()
        tree = np.array([(x, y) for x, y in zip(name[i].tolist(), name[j].tolist()) if forest.join(x, y)], np.int64)
        own = np.column_stack([name[some], name[some], count[some].astype(np.int64)])
        return np.concatenate([own, np.column_stack([tree, np.zeros(len(tree), np.int64)])])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pieces(table: pa.Table, ended: bool) -> tuple[list[np.ndarray], int]:
            """The links of all pieces but an unfinished last one, and where that begins."""
            part = {c: table.column(c).to_numpy() for c in ("filter", "lower", "upper", "dim", "chunk", "point", "copies")}
            label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            vectors = table.column("embedding").combine_chunks()
            part |= {"values": vectors.flatten().to_numpy(), "offsets": vectors.offsets.to_numpy() - vectors.offsets[0].as_py(), "filters": table.column("filters").combine_chunks()}
            differs = np.diff(label) != 0
            for c in ("dim", "filter", "lower", "upper"):
                differs |= np.diff(part[c]) != 0
            cuts = [0, *(np.flatnonzero(differs) + 1).tolist(), table.num_rows]
            done = cuts if ended else cuts[:-1]
            found = (links_of(part, a, z) for a, z in zip(done, done[1:]) if z - a > 1)
            return [x for x in found if x is not None], done[-1]

        def out(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if found:
                rows = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["a", "b", "links"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if table.num_rows:
                found, at = pieces(table, False)
                rest = table.slice(at)
                yield from out(found)
        if rest is not None:
            yield from out(pieces(rest, True)[0])

    found = materialize(full.mapInArrow(compare, "a long, b long, links long"))
    linked = components(found.where("links = 0").select("a", "b"))
    counts = found.where("links > 0").groupBy(F.col("a").alias("point")).agg(F.sum("links").alias("links"))
    named = ids.where("point is not null").groupBy("point").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.collect_set("_salt").alias("salts"))
    named = named.join(linked.hint("merge"), F.col("point") == F.col("id"), "left").join(counts.hint("merge"), "point", "left")
    named = with_minimum(named.withColumn("group", F.coalesce("component", "point")), "group", "least", "point", "top")
    named = materialize(named.select("point", "top", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.explode("salts").alias("_salt")))
    out = ids.join(named.hint("merge"), ["point", "_salt"], "left")
    return out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("top", "vec_id").alias("component_id"),
    )


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    found = embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


#: ``op7_embedding_dedup`` in DuckDB over the same table, by comparing every pair of a label.
OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
tops AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM tops LEFT JOIN n USING (vec_id)
"""
