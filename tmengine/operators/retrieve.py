"""Retrieval: sparse and dense top-N, rank fusion, weighted top-k, diagnostics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmengine.functions.text import status_rank, status_weight, stripped
from tmengine.operators.textindex import blocked, inverse_frequencies
from tmengine.tables import BROADCAST_ROWS, written

#: Vectors packed together: each block of queries is compared with each block of the index.
QUERY_BLOCK, INDEX_BLOCK = 1_024, 4_096


def top(scores: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The ``n`` best rows of each query by score, then pair_id, with ``nth`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "pair_id")
    return scores.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def sparse_scores(queries: DataFrame, index: DataFrame, n_index: DataFrame) -> DataFrame:
    """``(query_id, pair_id, score)``: sum over common tokens of query tf * idf * index tf.

    ``queries(query_id, token, tf)`` and ``index(pair_id, token, tf)`` are postings. Postings of tokens that no
    query has never meet the join; a very common token is split by the skew join, and sums are pre-aggregated.
    """
    asked = queries.select("query_id", "token", F.col("tf").alias("q_tf")).join(inverse_frequencies(index, n_index).hint("merge"), "token")
    hits = asked.select("query_id", "token", (F.col("q_tf") * F.col("idf")).alias("w")).join(index.hint("merge"), "token")
    return hits.groupBy("query_id", "pair_id").agg(F.round(F.sum(F.col("w") * F.col("tf")), 6).alias("score"))


#: Up to so many postings of asked tokens are met without bounds.
DIRECT_ROWS = 50_000_000
#: Slack of bounds against the scores' rounding.
_SLACK = 2e-6


def _threshold(asked: DataFrame, rows: DataFrame, maxima: DataFrame, n: int) -> DataFrame:
    """``(query_id, floor)``: a score that ``n`` texts of the query reach, from two cheap looks; no row where there is none.

    Looks: the texts of the query's rarest tokens, by these tokens alone, and all texts of its blocks with the highest bounds,
    as many blocks as hold some more than n texts.
    """
    before = lambda *order: Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    few = asked.withColumn("before", F.coalesce(F.sum("df").over(before("df", "token")), F.lit(0))).where((F.col("before") < 2 * n) & (F.col("df") <= 64 * n))
    by_token = few.select("query_id", "token", "w").join(rows.select("pair_id", "token", "tf").hint("merge"), "token")
    bounds = asked.select("query_id", "token", "w").join(maxima.hint("merge"), "token")
    bounds = bounds.groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("most")).alias("bound"), F.max("size").alias("size"))
    best = bounds.withColumn("before", F.coalesce(F.sum("size").over(before(F.col("bound").desc(), "block")), F.lit(0))).where(F.col("before") < 3 * n)
    by_block = written(best.select("query_id", "block")).hint("merge").join(asked.select("query_id", "token", "w").hint("merge"), "query_id")
    by_block = by_block.join(rows.hint("merge"), ["block", "token"])
    looks = [x.groupBy("query_id", "pair_id").agg(F.sum(F.col("w") * F.col("tf")).alias("score")) for x in (by_token, by_block)]
    reached = [top(x, n).where(F.col("nth") == n).select("query_id", "score") for x in looks]
    return reached[0].unionByName(reached[1]).groupBy("query_id").agg(F.max("score").alias("floor"))


#: Products of a posting and a query, and sums of a text and a query, that a task makes at once.
_MEET, _SUMS = 1 << 20, 1 << 21


def _asked_only(index: DataFrame, terms: list[str]) -> DataFrame:
    """``(pair_id, tokens, tfs)`` of counted texts: only tokens among ``terms``, as their places there; texts without any are left out."""
    kind = index.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in batches:
            held = batch.column("counts")
            owner = np.repeat(np.arange(len(held)), pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
            token, tf = held.flatten().flatten()
            place = pc.fill_null(pc.index_in(token, value_set=known), -1).to_numpy(zero_copy_only=False)
            here = np.flatnonzero(place >= 0)
            sizes = np.bincount(owner[here], minlength=len(held))
            some = np.flatnonzero(sizes)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (place[here].astype(np.int32), tf.to_numpy(zero_copy_only=False)[here])]
            yield pa.RecordBatch.from_arrays([batch.column("pair_id").take(pa.array(some)), *lists], names=["pair_id", "tokens", "tfs"])

    return index.select("pair_id", "counts").mapInArrow(run, f"pair_id {kind}, tokens array<int>, tfs array<bigint>")


def _best_of_task(held: DataFrame, asked: pa.Table, terms: list[str], n: int, kind: str) -> DataFrame:
    """``(query_id, pair_id, score)``: every task's n best texts of each query, with those that rounding may put level with them.

    ``asked(query_id, token, w)`` are the queries' weights. A text's sums are made where it lies; of equal sums the n smallest ids stay.
    """
    place = pc.index_in(asked.column("token").combine_chunks(), value_set=pa.array(terms, pa.string())).to_numpy(zero_copy_only=False)
    coded = asked.column("query_id").combine_chunks().dictionary_encode("encode")
    ids, order = coded.dictionary, np.argsort(place, kind="stable")
    start = np.searchsorted(place[order], np.arange(len(terms) + 1))
    query = coded.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64)
    weight = asked.column("w").to_numpy()[order]
    n_q = len(ids)

    def kept(q: np.ndarray, pair: np.ndarray, score: np.ndarray, floor: np.ndarray) -> np.ndarray:
        order = np.lexsort((pair, -score, q))
        q, score = q[order], score[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        full = nth == n - 1
        floor[q[full]] = score[full]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (score[1:] != score[:-1])
        level = np.arange(len(q)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        return order[(level < n) & (score >= floor[q] - _SLACK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(n_q, -np.inf)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        for batch in batches:
            lists = batch.column("tokens")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            token, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("tokens", "tfs"))
            none = batch.column("pair_id").is_null().to_numpy(zero_copy_only=False)
            pair = pc.fill_null(batch.column("pair_id").cast(pa.int64()), -(2**63)).to_numpy(zero_copy_only=False)  # null comes first
            fan = start[token + 1] - start[token]
            first = np.concatenate([[0], np.cumsum(sizes)])
            work = np.concatenate([[0], np.cumsum(fan)])[first]
            at = 0
            while at < len(sizes):
                upto = min(at + max(1, _SUMS // n_q), int(np.searchsorted(work, work[at] + _MEET, "right")) - 1)
                upto = max(at + 1, upto)
                a, z = first[at], first[upto]
                met = np.repeat(np.arange(a, z), fan[a:z])
                entry = np.repeat(start[token[a:z]], fan[a:z]) + np.arange(len(met)) - np.repeat(np.cumsum(fan[a:z]) - fan[a:z], fan[a:z])
                cell = np.repeat(np.arange(upto - at), work[at + 1 : upto + 1] - work[at:upto]) * n_q + query[entry]
                sums = np.bincount(cell, weight[entry] * tf[met], (upto - at) * n_q)
                hit = np.zeros(len(sums), bool)
                hit[cell] = True
                hit &= (sums.reshape(-1, n_q) >= floor - _SLACK).ravel()
                where = np.flatnonzero(hit)
                row = at + where // n_q
                best = tuple(np.concatenate(x) for x in zip(best, (where % n_q, pair[row], sums[where], none[row])))
                stay = kept(*best[:3], floor)
                best = tuple(x[stay] for x in best)
                at = upto
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(best[0])), pa.array(best[1], mask=best[3]), pa.array(best[2])], names=["query_id", "pair_id", "score"])

    return held.mapInArrow(run, f"query_id {kind}, pair_id bigint, score double")


def _counted_hits(said: DataFrame, terms: list[str], index: DataFrame, n_index: DataFrame, n: int, kept: DataFrame | None) -> DataFrame:
    """``sparse_hits`` of counted texts for queries whose (query_id, token) rows may be broadcast: texts stay in their tasks."""
    spark = said.sparkSession
    held = written(_asked_only(index, terms))
    if kept is None:
        df = held.select(F.explode("tokens").alias("place")).groupBy("place").agg(F.count("*").alias("df")).toPandas()  # a row an asked token
        kept = spark.createDataFrame([(terms[p], int(v)) for p, v in zip(df["place"], df["df"])], "token string, df long")
    asked = said.join(inverse_frequencies(held, n_index, kept).hint("merge"), "token").select("query_id", "token", (F.col("q_tf") * F.col("idf")).alias("w")).toArrow()
    kind, id_kind = said.schema["query_id"].dataType.simpleString(), index.schema["pair_id"].dataType.simpleString()
    if not asked.num_rows:
        return top(spark.createDataFrame([], f"query_id {kind}, pair_id {id_kind}, score double"), n)
    found = _best_of_task(held, asked, terms, n, kind)
    return top(found.select("query_id", F.col("pair_id").cast(id_kind).alias("pair_id"), F.round("score", 6).alias("score")), n)


def sparse_hits(queries: DataFrame, index: DataFrame, n_index: DataFrame, n: int, kept: DataFrame | None = None, counts: dict | None = None, direct: int = DIRECT_ROWS) -> DataFrame:
    """The ``n`` best of ``sparse_scores`` of each query, with ``nth``, found without meeting most postings.

    A query and a block of texts have a bound, the sum of weight times largest count of the common tokens. Blocks whose bound
    is below a score that n texts reach are left out. In a block that stays, tokens whose bounds together fall short of that
    score can lift no text over it alone: postings are read for the other tokens, and for these only where a text found by
    the others may still reach the score. Where all postings of the asked tokens are no more than ``direct``, bounds would cost
    more than they save, and all are met. ``index`` are postings with n (``textindex.postings``), ``kept`` kept
    frequencies; ``counts`` takes the rows met if given (tests).

    ``index`` may also be counted texts (``textindex.counted``) with whole numbers as pair_id. Where the queries' tokens may be
    broadcast, a text's scores are then made in the task that holds it, and only each task's best meet a shuffle.
    """
    said = written(queries.select("query_id", "token", F.col("tf").alias("q_tf")))
    wanted = written(said.select("token").distinct())
    if "counts" in index.columns:
        if said.count() <= BROADCAST_ROWS:
            return _counted_hits(said, sorted(r["token"] for r in wanted.collect()), index, n_index, n, kept)
        index = index.select("pair_id", "n", F.inline("counts"))
    few = wanted.count() <= BROADCAST_ROWS
    posted = written(index.join(F.broadcast(wanted) if few else wanted.hint("merge"), "token", "left_semi"))
    asked = said.join(inverse_frequencies(posted, n_index, kept).hint("merge"), "token")
    asked = written(asked.select("query_id", "token", "df", (F.col("q_tf") * F.col("idf")).alias("w")))
    size = asked.agg(F.count("*").alias("rows"), F.coalesce(F.sum("df"), F.lit(0)).alias("met")).first()
    if size["met"] <= direct:
        weights = asked.select("query_id", "token", "w")
        if size["rows"] <= BROADCAST_ROWS:  # a text's postings stay in one task up to its scores
            hits = posted.select("pair_id", "token", "tf").repartition("pair_id").join(F.broadcast(weights), "token")
        else:
            hits = posted.join(weights.hint("merge"), "token")
        return top(hits.groupBy("query_id", "pair_id").agg(F.round(F.sum(F.col("w") * F.col("tf")), 6).alias("score")), n)
    rows = written(blocked(posted))
    maxima = written(rows.groupBy("block", "token").agg(F.max("tf").alias("most"), F.max("size").alias("size")))
    floors = written(_threshold(asked, rows, maxima, n))
    slim = asked.select("query_id", "token", "w").join(floors.hint("merge"), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - _SLACK)
    bounds = slim.join(maxima.hint("merge"), "token").withColumn("u", F.col("w") * F.col("most"))
    block = Window.partitionBy("query_id", "block")
    upto = block.orderBy("u", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = bounds.withColumn("bound", F.sum("u").over(block)).withColumn("upto", F.sum("u").over(upto)).where(F.col("bound") >= F.col("floor"))
    bounds = bounds.withColumn("needed", F.col("upto") >= F.col("floor"))
    bounds = written(bounds.withColumn("rest", F.sum(F.when(~F.col("needed"), F.col("u")).otherwise(0.0)).over(block)).select("query_id", "block", "token", "w", "floor", "needed", "rest"))
    found = bounds.where("needed").join(rows.hint("merge"), ["block", "token"])
    first = found.groupBy("query_id", "pair_id").agg(F.sum(F.col("w") * F.col("tf")).alias("part"), F.first("block").alias("block"), F.first("floor").alias("floor"), F.first("rest").alias("rest"))
    first = written(first.where(F.col("part") + F.col("rest") >= F.col("floor")).select("query_id", "pair_id", "block", "part"))
    wanted = first.select("query_id", "pair_id", "block").join(bounds.where("not needed").select("query_id", "block", "token", "w").hint("merge"), ["query_id", "block"])
    more = wanted.select("query_id", "pair_id", "token", "w").join(rows.select("pair_id", "token", "tf").hint("merge"), ["pair_id", "token"])
    parts = first.select("query_id", "pair_id", "part").unionByName(more.select("query_id", "pair_id", (F.col("w") * F.col("tf")).alias("part")))
    if counts is not None:
        counts |= {"found": found.count(), "looked_up": more.count(), "bounds": bounds.count()}
    return top(parts.groupBy("query_id", "pair_id").agg(F.round(F.sum("part"), 6).alias("score")), n)


def packed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``(ids, dim, values)``: unit vectors of equal length, up to ``size`` together as one matrix of doubles, written out.

    Null, empty, zero and non-finite vectors are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["vector"].map(_sound)]
            for dim, part in batch.groupby(batch["vector"].map(len)):
                for at in range(0, len(part), size):
                    some = part.iloc[at : at + size]
                    yield pd.DataFrame({"ids": [some[key].to_numpy()], "dim": [dim], "values": [_unit(np.stack(some["vector"].to_numpy())).tobytes()]})

    slim = rows.select(key, F.col("vector").cast("array<double>").alias("vector"))
    return written(slim.mapInPandas(run, "ids array<long>, dim int, values binary"))


def dense_scores(queries: DataFrame, index: DataFrame, n: int, least: float = -1.0) -> DataFrame:
    """The ``n`` best ``(query_id, pair_id, score)`` of each query by cosine of at least ``least``, ties by pair_id.

    ``queries(query_id, vector)``, the stated set, and ``index(pair_id, vector)`` are packed into blocks; each block
    of queries meets each block of the index in some task, which keeps n rows a query, and those are merged.
    Only vectors of equal length are compared. Null, empty, zero and non-finite vectors have no hits.
    """
    asked = packed(queries, "query_id", QUERY_BLOCK).select(F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("values").alias("q_values"))
    held = packed(index, "pair_id", INDEX_BLOCK)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_ids, dim, q_values, ids, values in zip(batch["q_ids"], batch["dim"], batch["q_values"], batch["ids"], batch["values"]):
                matrix, rows = (np.frombuffer(v).reshape(-1, dim) for v in (q_values, values))
                for at in range(0, len(matrix), 512):
                    cosines = np.round(matrix[at : at + 512] @ rows.T, 6)
                    floor = np.full(len(cosines), least)
                    if len(rows) > n:
                        floor = np.maximum(floor, np.partition(cosines, len(rows) - n, axis=1)[:, len(rows) - n])
                    q, i = np.nonzero(cosines >= floor[:, None])
                    order = np.lexsort((ids[i], -cosines[q, i], q))
                    q, i = q[order], i[order]
                    nth = np.arange(len(q)) - np.searchsorted(q, q)
                    q, i = q[nth < n], i[nth < n]
                    yield pd.DataFrame({"query_id": q_ids[at + q], "pair_id": ids[i], "score": cosines[q, i]})

    met = held.join(asked.hint("shuffle_replicate_nl"), F.col("dim") == F.col("q_dim"))  # blocks of the stated queries against all rows
    met = met.select("q_ids", "dim", "q_values", "ids", "values")
    return top(met.mapInPandas(best, "query_id long, pair_id long, score double"), n)


def _sound(v) -> bool:
    return v is not None and len(v) > 0 and all(x is not None for x in v) and bool(np.isfinite(np.asarray(v, float)).all()) and bool(np.any(v))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(float)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fused(channels: list[DataFrame], k: int = 60, fetch: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ranked channels ``(query_id, pair_id, nth)``: the sum of 1 / (k + nth)."""
    rows = channels[0].select("query_id", "pair_id", "nth")
    for c in channels[1:]:
        rows = rows.unionByName(c.select("query_id", "pair_id", "nth"))
    out = rows.groupBy("query_id", "pair_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("nth"))), 9).alias("score"))
    return top(out, fetch) if fetch else out


def weighted_top(hits: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each query: one a (source, target), best status first, ordered by score times status weight."""
    found, held = written(hits.select("query_id", "pair_id", "score")), index.select("pair_id", "source", "target", "status")
    rows = held.join(F.broadcast(found), "pair_id") if found.count() <= BROADCAST_ROWS else found.join(held.hint("merge"), "pair_id")
    rows = rows.withColumn("rank", status_rank(F.col("status")))
    one = F.min_by(F.struct("pair_id", "score", "status"), F.struct("rank", (-F.col("score")).alias("s"), "pair_id"))
    rows = rows.groupBy("query_id", stripped(F.col("source")).alias("source"), stripped(F.col("target")).alias("target")).agg(one.alias("h"))
    rows = rows.select("query_id", "source", "target", "h.*").withColumn("adjusted", F.round(F.col("score") * status_weight(F.col("status")), 9))
    order = Window.partitionBy("query_id").orderBy(F.col("adjusted").desc(), F.col("score").desc(), "pair_id")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("adjusted")


def hybrid_search(dense: DataFrame, sparse: DataFrame, index: DataFrame, k: int = 3, rrf_k: int = 60) -> DataFrame:
    """Fuse the channels' prefetched hits, fetch max(3k, k + 10) a query, drop repeats and take the weighted top k."""
    return weighted_top(fused([dense, sparse], rrf_k, max(3 * k, k + 10)), index, k)


def recall_diagnostics(queries: DataFrame, dense: DataFrame, sparse: DataFrame, prefetch: int = 20) -> DataFrame:
    """Per query the best cosine (null without one) and the number of sparse hits up to the prefetch."""
    best = dense.groupBy("query_id").agg(F.max("score").alias("dense_top1"))
    n = sparse.groupBy("query_id").agg(F.least(F.count("*"), F.lit(prefetch)).alias("sparse_hits"))
    out = queries.select("query_id").join(best.hint("merge"), "query_id", "left").join(n.hint("merge"), "query_id", "left")
    return out.select("query_id", "dense_top1", F.coalesce("sparse_hits", F.lit(0)).alias("sparse_hits"))


def weak_recall(diagnosed: DataFrame, least: float) -> DataFrame:
    """Adds ``weak``: no term, no sparse hit, and the best cosine (0 if none) below the threshold."""
    weak = (F.col("term_count") == 0) & (F.col("sparse_hits") == 0) & (F.coalesce("dense_top1", F.lit(0.0)) < least)
    return diagnosed.withColumn("weak", weak)


def unit_references(members: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """References of each unit: its members' hits, the best score of each (source, target), up to 2k."""
    rows = members.select("unit_id", "query_id").join(hits.hint("merge"), "query_id")
    rows = rows.groupBy("unit_id", "source", "target").agg(F.max_by("status", F.struct("score", (-F.col("pair_id")).alias("p"))).alias("status"), F.max("score").alias("score"))
    order = Window.partitionBy("unit_id").orderBy(F.col("score").desc(), "source", "target")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2 * k)
