"""Exact top-k by inner product: three-phase uniform threshold.

Every vector is cut by components into ``lists`` parts; the parts of all vectors are one score list, whose score of a query
is the inner product of the parts, and a total is the sum over the lists. Equal vectors are one point.

1. Gather: each list gives its best points of each query. Their totals, computed exactly, give the query a cutoff: the
   k-th best of them, which the k-th best of all cannot be below.
2. Collect: the cutoff goes to all lists with the query, and a list gives every point that scores a ``lists``-th of it. A point
   in none of these falls short of the cutoff in total. Points given by all lists have their totals and raise the cutoff.
3. Resolve: of the rest, points that may still reach the cutoff get their totals from the vectors.

Lists are packed into blocks, and blocks of queries meet blocks of points on a grid of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmengine.llm.common import materialize, partitions_for, salted, with_minimum

#: Vectors packed together.
QUERY_BLOCK, POINT_BLOCK = 256, 1_024
#: The cutoff of a query with fewer than k other points.
NONE = -(1 << 63)


def scaled(vectors: DataFrame, factor: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` with v the floors of ``factor`` times each component, as longs; unsound vectors and null keys are left out."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda y: F.when(F.abs(y) < 2.0**63, F.floor(y)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound).select("vec_id", F.transform("x", lambda x: whole(x * factor)).alias("v"))


def inner_product(a: Column, b: Column) -> Column:
    """Exact: a sum beyond 64 bits is an error (with ANSI mode, Spark's default)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def packed(rows: DataFrame, key: str, size: int, lists: int, more: tuple[str, ...] = ()) -> DataFrame:
    """``(ids, dim, list, values, *more)``: up to ``size`` vectors' parts of each list as one matrix of longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len)):
                cuts = np.linspace(0, dim, lists + 1).astype(int)
                for at in range(0, len(part), size):
                    some = part.iloc[at : at + size]
                    matrix = np.stack(some["v"].to_numpy()).astype(np.int64).reshape(len(some), dim)
                    extra = {c: [some[c].to_numpy()] for c in more}
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        yield pd.DataFrame({"ids": [some[key].to_numpy()], "dim": [dim], "list": [k], "values": [np.ascontiguousarray(matrix[:, a:z]).tobytes()], **extra})

    kinds = "".join(f", {c} array<long>" for c in more)
    return rows.select(key, "v", *more).mapInPandas(run, f"ids array<long>, dim int, list int, values binary{kinds}")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows: in doubles while no sum can reach 2^53, else in unbounded integers."""
    reach = [int(np.abs(x.astype(float)).max()) if x.size else 0 for x in (a, b)]
    if reach[0] * reach[1] * max(1, a.shape[1]) < 1 << 53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def met(queries: DataFrame, points: DataFrame, pick: Callable, lists: int) -> DataFrame:
    """``(query, point, list, part)`` that ``pick(scores, points' ids, query rows)`` keeps of each pair of blocks.

    The grid has R rows of points and C columns of queries, R * C near the number of shuffle partitions and R / C near 20,
    the number of points for each query of the stated set, so neither side is copied more than the other.
    """
    tasks = max(1, partitions_for(points) // lists)
    r = max(1, min(tasks, round(math.sqrt(20 * tasks))))
    c = max(1, tasks // r)
    spot = lambda n, seed: F.pmod(F.xxhash64("ids", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = points.withColumn("r", spot(r, 1)).withColumn("c", every(c))
    asked = queries.withColumn("c", spot(c, 2)).withColumn("r", every(r))
    asked = asked.withColumnRenamed("ids", "q_ids").withColumnRenamed("values", "q_values")
    pairs = held.join(asked.hint("merge"), ["dim", "list", "r", "c"]).drop("r", "c")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                shape = (len(row.q_ids), -1) if row.q_values else (len(row.q_ids), 0)
                a = np.frombuffer(row.q_values, np.int64).reshape(shape)
                b = np.frombuffer(row.values, np.int64).reshape(len(row.ids), a.shape[1])
                scores = products(a, b)
                q, p = pick(scores, np.asarray(row.ids), row)
                yield pd.DataFrame({"query": np.asarray(row.q_ids)[q], "point": np.asarray(row.ids)[p], "list": row.list, "part": scores[q, p]})

    return pairs.mapInPandas(run, "query long, point long, list int, part long")


def best_of(k: int) -> Callable:
    """The k best points of each query of a block, ties by id."""

    def pick(scores: np.ndarray, ids: np.ndarray, row) -> tuple[np.ndarray, np.ndarray]:
        floor = np.full(len(scores), np.iinfo(np.int64).min)
        if len(ids) > k:
            floor = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        q, p = np.nonzero(scores >= floor[:, None])
        order = np.lexsort((ids[p], -scores[q, p], q))
        q, p = q[order], p[order]
        few = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[few], p[few]

    return pick


def reaching(lists: int) -> Callable:
    """All points that score the lists' share of the query's cutoff."""

    def pick(scores: np.ndarray, ids: np.ndarray, row) -> tuple[np.ndarray, np.ndarray]:
        cutoff = np.asarray(row.cutoff)
        least = np.where(cutoff == NONE, NONE, -(-cutoff // lists))  # a part is an integer: the share, rounded up
        return np.nonzero(scores >= least[:, None])

    return pick


def beside(rows: DataFrame, side: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with the few rows that ``side`` has of their key; a hot key's rows, spread by ``by``, meet them in pieces."""
    spread = salted(rows, by)
    wanted = side.join(spread.select(key, "_salt").distinct().hint("merge"), key)
    return spread.join(wanted.hint("merge"), [key, "_salt"]).drop("_salt")


def first(rows: DataFrame, by: list[str], order: list, k: int, name: str = "nth") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def top_points(queries: DataFrame, points: DataFrame, k: int, lists: int = 2) -> DataFrame:
    """``(query, point, score)``: for each of ``queries(query, v)`` all points of ``points(point, v)`` that may be among its k best but itself.

    Every point that scores at least the k-th best other point is there, with its exact score.
    """
    held = materialize(packed(points, "point", POINT_BLOCK, lists))
    asked = packed(queries, "query", QUERY_BLOCK, lists)
    best = [F.col("part").desc(), "point"]
    gathered = first(met(materialize(asked), held, best_of(k + 1), lists), ["query", "list"], best, k + 1).select("query", "point").distinct()

    def resolved(pairs: DataFrame) -> DataFrame:
        both = beside(materialize(pairs), points.withColumnRenamed("v", "pv"), "point", "query").join(queries.withColumnRenamed("v", "qv").hint("merge"), "query")
        return both.select("query", "point", inner_product(F.col("qv"), F.col("pv")).alias("score"))

    known = materialize(resolved(gathered))
    order = [F.col("score").desc(), "point"]
    kth = lambda rows: first(rows.where("query <> point"), ["query"], order, k).where(F.col("nth") == k).select("query", F.col("score").alias("cutoff"))
    limited = materialize(queries.join(kth(known).hint("merge"), "query", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(NONE))))
    again = materialize(packed(limited, "query", QUERY_BLOCK, lists, ("cutoff",)))
    entries = met(again, held, reaching(lists), lists)
    sums = materialize(entries.groupBy("query", "point").agg(F.sum("part").alias("sum"), F.count("*").cast("int").alias("n")))
    full = sums.where(F.col("n") == lists).select("query", "point", F.col("sum").alias("score"))
    sure = known.unionByName(full).distinct()
    raised = materialize(limited.select("query", "cutoff").join(kth(sure).withColumnRenamed("cutoff", "higher").hint("merge"), "query", "left").withColumn("higher", F.coalesce("higher", "cutoff")))
    open_ = sums.where(F.col("n") < lists).join(raised.hint("merge"), "query")
    # a part that a list did not give is below the share: by at least one, times the lists that are missing
    most = F.col("sum") * lists + (lists - F.col("n")) * F.col("cutoff")
    open_ = open_.where(F.when(F.col("cutoff") == NONE, True).otherwise(most >= F.col("higher") * lists)).select("query", "point")
    open_ = open_.join(known.select("query", "point").hint("merge"), ["query", "point"], "left_anti")
    out = sure.unionByName(resolved(open_)).join(raised.select("query", "higher").hint("merge"), "query")
    return materialize(out.where(F.col("score") >= F.col("higher")).drop("higher"))


def exact_top(rows: DataFrame, k: int = 20, every: int = 20, lists: int = 2) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of each row whose id is divisible by ``every``, ties to the smaller id.

    ``rows(vec_id, v)`` hold vectors of longs (``scaled``); only those of equal length are compared. A row repeated with
    id and vector counts once; an id with several vectors is a candidate, and asks, with each. No rows give none.
    """
    numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()))  # written, so numbers stay on recovery
    named = materialize(with_minimum(numbered, "v", "row", "row", "point"))
    points = materialize(named.where("row = point").select("point", "v"))
    ids = materialize(named.select("point", "vec_id").distinct())
    asking = ids.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    queries = materialize(points.join(asking.select("point").distinct().hint("merge"), "point").withColumnRenamed("point", "query"))
    found = top_points(queries, points, k, lists)
    copies = first(ids, ["point"], ["vec_id"], k + 1).select("point", "vec_id")  # one more: a query may be among them
    hits = beside(found, materialize(copies), "point", "query").select("query", "point", "vec_id", "score")
    hits = first(hits, ["query"], [F.col("score").desc(), "vec_id", "point"], k + 1)
    hits = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score", "point"))).alias("hits"))  # k + 1 of a query
    out = beside(asking, materialize(hits.withColumnRenamed("query", "point")), "point", "query_id")
    others = F.filter("hits", lambda h: (h["vec_id"] != F.col("query_id")) | (h["point"] != F.col("point")))
    out = out.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "h"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))


def op11_exact_topk(spark, sf_dir: str) -> DataFrame:
    return exact_top(scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 64))


#: ``op11_exact_topk`` in DuckDB over the same table.
OP11_SQL = """
WITH e AS (SELECT vec_id, [floor(64 * x) for x in embedding::DOUBLE[]] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding::DOUBLE[] if x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
