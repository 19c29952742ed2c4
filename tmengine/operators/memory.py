"""Translation memory: best candidates, exact matches, incremental plans and their application."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmengine.functions.text import memory_text, pair_id, status_rank, stripped
from tmengine.tables import written

PAIR = ["source", "target"]


def best_by_pair(tm: DataFrame) -> DataFrame:
    """One row a (source, target): the best status, the earliest row_id among equals, with the number of rows seen.

    Further columns (context, file) are those of that row.
    """
    ranked = tm.withColumn("rank", status_rank(F.col("status")))
    more = [c for c in tm.columns if c not in (*PAIR, "row_id", "status", "rank", "n_rows")]
    best = F.min_by(F.struct("row_id", "status", "rank", *more), F.struct("rank", "row_id"))
    return ranked.groupBy(*PAIR).agg(best.alias("b"), F.count("*").alias("n_rows")).select(*PAIR, "b.*", "n_rows")


def exact_matches(segments: DataFrame, tm: DataFrame, k: int = 1) -> DataFrame:
    """Each segment with its ``k`` best exact matches by trimmed source (nulls where there is none).

    The memory is reduced to k targets a source before the join, so a frequent source costs k rows.
    """
    hits = tm.select(stripped(F.col("source")).alias("key"), stripped(F.col("target")).alias("target"), "status")
    hits = hits.where("key <> ''").withColumn("rank", status_rank(F.col("status")))
    hits = hits.groupBy("key", "target").agg(F.min_by("status", "rank").alias("status"), F.min("rank").alias("rank"))
    order = Window.partitionBy("key").orderBy("rank", "target")
    hits = hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    found = segments.withColumn("key", stripped(F.col("source"))).join(hits, "key", "left").drop("key")
    return found.withColumn("is_exact", F.col("target").isNotNull()).withColumn("score", F.when(F.col("is_exact"), F.lit(1.0)))


def import_plan(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Best incoming pairs with ``action``: embed (unknown pair), skip (as good is there) or clone (better than all there).

    clone carries reuse_id, the best existing point of the pair, and obsolete_ids, all of them. Stored pairs
    are compared by their cleaned texts; those with a blank side are no one's pair.
    """
    cleaned = existing.select("pair_id", *[memory_text(F.coalesce(c, F.lit(""))).alias(c) for c in PAIR], "status").where("source <> '' and target <> ''")
    there = cleaned.withColumn("old_rank", status_rank(F.col("status"))).groupBy(*PAIR)
    there = there.agg(
        F.min("old_rank").alias("old_rank"), F.min_by("pair_id", F.struct("old_rank", "pair_id")).alias("reuse_id"),
        F.sort_array(F.collect_list("pair_id")).alias("obsolete_ids"),
    )
    plan = best_by_pair(incoming).join(there.hint("merge"), PAIR, "left")
    action = F.when(F.col("old_rank").isNull(), "embed").when(F.col("old_rank") <= F.col("rank"), "skip").otherwise("clone")
    plan = plan.withColumn("action", action)
    clone = F.col("action") == "clone"
    return plan.withColumn("reuse_id", F.when(clone, F.col("reuse_id"))).withColumn("obsolete_ids", F.when(clone, F.col("obsolete_ids"))).drop("old_rank")


def plan_summary(plan: DataFrame) -> DataFrame:
    """Counts of an import: candidates, pairs, duplicates, and what the plan does with the pairs."""
    return plan.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("candidates"), F.count("*").alias("unique_pairs"),
        F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("action") == "skip").alias("skipped"),
        F.count_if(F.col("action") == "embed").alias("new"), F.countDistinct(F.when(F.col("action") == "embed", F.col("source"))).alias("new_sources"),
        F.count_if(F.col("action") == "clone").alias("upgraded"),
    )


def reused_vectors(plan: DataFrame, index: DataFrame) -> DataFrame:
    """The stored vectors of upgraded pairs; ``missing`` marks those whose vector is gone."""
    wanted = plan.where("action = 'clone'").select(*PAIR, "status", "reuse_id")
    found = wanted.join(index.select(F.col("pair_id").alias("reuse_id"), "dense").hint("merge"), "reuse_id", "left")
    return found.withColumn("missing", F.col("dense").isNull())


def plan_vectors(plan: DataFrame, index: DataFrame, embed) -> DataFrame:
    """``(source, target, dense)`` of upgraded and new pairs: the stored vector, or one made once a distinct source.

    ``embed`` maps DataFrame(source) to DataFrame(source, dense); it also gives upgraded pairs their vector if
    the stored one is gone.
    """
    reused = written(reused_vectors(plan, index).select(*PAIR, "dense", "missing"))
    wanted = plan.where("action = 'embed'").select(*PAIR).unionByName(reused.where("missing").select(*PAIR))
    return reused.where("not missing").select(*PAIR, "dense").unionByName(vectors_for_sources(wanted, embed).select(*PAIR, "dense"))


def _arriving(plan: DataFrame, columns: list[str], collection: str | None) -> DataFrame:
    """Upgraded and new points with the index's other ``columns``: the plan's values, else those of the point that is replaced.

    A new point comes into ``collection``; an upgraded one stays in its own. ``_old`` is the replaced point, if any.
    """
    known = {"priority_rank": "rank", **({"source_tm": "source_file"} if "source_file" in plan.columns else {})}
    out = []
    for c in columns:
        own = c if c in plan.columns and c not in ("dense", "collection") else known.get(c)
        value = F.col(own) if own else F.col(f"_old.{c}")
        out.append((F.coalesce(value, F.lit(collection)) if c == "collection" else value).alias(c))
    return plan.select(*PAIR, "status", *out)


def apply_plan(plan: DataFrame, existing: DataFrame, namespace: uuid.UUID, vectors: DataFrame | None = None, collection: str | None = None, strict: bool = False) -> DataFrame:
    """The index after the plan: upgraded pairs' old points go, upgraded and new ones come under their stable ids.

    Points that stay keep all their columns. An upgraded point keeps the stored vector of the point it replaces and
    all columns that the plan does not have, its collection among them; new points come into ``collection``.
    ``vectors(source, target, dense)`` fills vectors that are not stored. With ``strict`` an upgraded pair whose
    stored vector is gone is an error; else it has the one of ``vectors``, or none.
    """
    gone = plan.where("action = 'clone'").select(F.explode("obsolete_ids").alias("pair_id"))
    kept = existing.join(gone.hint("merge"), "pair_id", "left_anti")
    more = [c for c in existing.columns if c not in ("pair_id", *PAIR, "status")]
    old = existing.select(F.col("pair_id").alias("reuse_id"), F.struct(F.lit(True).alias("_there"), *more).alias("_old"))
    upgraded = _arriving(plan.where("action = 'clone'").join(old.hint("merge"), "reuse_id", "left"), more, collection)
    fresh = _arriving(plan.where("action = 'embed'").withColumn("_old", F.lit(None).cast(old.schema["_old"].dataType)), more, collection)
    if strict and "dense" in more:
        lost = F.raise_error(F.concat(F.lit("no stored vector for the upgraded pair of "), "source")).cast(dict(existing.dtypes)["dense"])
        upgraded = upgraded.withColumn("dense", F.when(F.col("dense").isNull(), lost).otherwise(F.col("dense")))
    fresh = upgraded.unionByName(fresh)
    if vectors is not None:
        made = vectors.select(*PAIR, F.col("dense").alias("_made"))
        fresh = fresh.join(made.hint("merge"), PAIR, "left")
        fresh = fresh.withColumn("dense", F.coalesce("dense", "_made") if "dense" in more else F.col("_made")).drop("_made")
    return upsert(kept, fresh.withColumn("pair_id", pair_id(F.col("source"), F.col("target"), F.col("status"), namespace)))


def file_counts(candidates: DataFrame) -> DataFrame:
    """Candidates of each source file, and those of unknown status."""
    return candidates.groupBy("source_file").agg(F.count("*").alias("candidates"), F.count_if(F.col("status").isNull()).alias("unknown_status"))


def load_counts(parsed: DataFrame, indexed: DataFrame) -> DataFrame:
    """What a load read, how many points it made, and how many rows it did without (blank sides and repeats)."""
    made = indexed.agg(F.count("*").alias("indexed"))
    return parsed.agg(F.count("*").alias("parsed")).crossJoin(F.broadcast(made)).withColumn("dropped", F.col("parsed") - F.col("indexed"))  # one row each


def upsert(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Index rows with ``entries`` put in: rows without source or target are left out, the entry wins over the stored row."""
    rows = index.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rows = rows.where((F.trim(F.coalesce("source", F.lit(""))) != "") & (F.trim(F.coalesce("target", F.lit(""))) != ""))
    columns = [c for c in rows.columns if c not in ("pair_id", "_new")]
    return rows.groupBy("pair_id").agg(F.max_by(F.struct(*columns), "_new").alias("r")).select("pair_id", "r.*")


def vectors_for_sources(candidates: DataFrame, embed) -> DataFrame:
    """Embed every distinct source once with ``embed(DataFrame(source)) -> DataFrame(source, dense)``, joined back to all."""
    return candidates.join(written(embed(candidates.select("source").distinct())).hint("merge"), "source")
