"""Composite jobs: translation of segments and dialogs, memory import, export."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmengine.functions.text import rule_class, stripped
from tmengine.operators import cells, cluster, enrich, glossary, infer, memory, render, retrieve, textindex, units
from tmengine.operators.glossary import PATTERN_TERMS
from tmengine.plans import index
from tmengine.sources import files, sinks
from tmengine.tables import written

#: Neutral titles of a message's sections, in their order; a caller may give its own.
TITLES = {"style": "## Style", "rules": "## Rules", "terms": "## Terms", "references": "## References", "web": "## Web", "source": "## Source", "output": "## Output"}


@dataclass
class Setting:
    """What a translation may use besides the memory and the glossary; all of it may be left out.

    ``header`` opens every message. ``collection`` scopes the memory. ``embed`` (DataFrame(source) to DataFrame(source, dense))
    adds the dense channel over the memory's ``dense``, from a cosine of ``dense_least``. ``style`` are rows
    (content_type, rules), null type for the general part. ``rules`` are texts by class of content type. ``contract`` is what
    the answer must look like. ``cache`` and ``fetch`` look up units of weak recall, below a best cosine of ``weak_least``, if
    ``web`` is asked for. Results are saved under ``results`` and ``task_id``.
    """

    header: str = ""
    collection: str | None = None
    embed: Callable[[DataFrame], DataFrame] | None = None
    dense_least: float = 0.2
    style: DataFrame | None = None
    rules: dict[str, str] = field(default_factory=dict)
    contract: str = ""
    web: bool = False
    cache: DataFrame | None = None
    fetch: Callable[[str], str | None] | None = None
    weak_least: float = 0.5
    results: str | None = None
    task_id: str = "task"
    workers: int = 1
    titles: dict[str, str] = field(default_factory=dict)


def references(segments: DataFrame, tm: DataFrame, k: int = 3, prefetch: int = 20, setting: Setting | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits ``(query_id, source, target, status, score, nth)`` of segments (row_id, source) in a memory, and each query's diagnostics.

    Sparse by common tokens, and dense by cosine if the setting embeds and the memory has vectors; both are fused.
    """
    setting = setting or Setting()
    if setting.collection is not None and "collection" in tm.columns:
        tm = tm.where(F.col("collection") == setting.collection)
    held = tm.select(F.col("row_id").alias("pair_id"), F.col("source").alias("text"), "source", "target", "status")
    asked = segments.select(F.col("row_id").alias("query_id"), F.col("source").alias("text"))
    sparse = written(retrieve.sparse_hits(textindex.postings(asked, "query_id"), textindex.postings(held, "pair_id"), held.agg(F.count("*").alias("n")), prefetch))
    channels, dense = [sparse], None
    if setting.embed is not None and "dense" in tm.columns:
        vectors = memory.vectors_for_sources(segments.select(F.col("row_id").alias("query_id"), "source"), setting.embed).select("query_id", F.col("dense").alias("vector"))
        near = written(cells.dense_hits(vectors, tm.select(F.col("row_id").alias("pair_id"), F.col("dense").alias("vector")), prefetch))
        dense = near
        channels.insert(0, near.where(F.col("score") >= setting.dense_least))
    hits = retrieve.weighted_top(retrieve.fused(channels, fetch=max(3 * k, k + 10)), held, k)
    none = segments.sparkSession.createDataFrame([], "query_id long, pair_id long, score double")
    return hits, retrieve.recall_diagnostics(asked, none if dense is None else dense, sparse, prefetch)


def group_units(segments: DataFrame, t: float = 0.4, min_coverage: float = 0.5, size: int = 10, chunk: int = 50) -> DataFrame:
    """Members ``(row_id, unit_id, kind, pos)``: template groups in slices, all other rows in chunks of ``chunk``."""
    texts = segments.select("row_id", F.col("source").alias("text"))
    groups = cluster.template_groups(texts, t, min_coverage, size).where("is_grouped")
    unit = F.concat(F.lit("group-"), F.col("component").cast("string"), F.lit("-"), F.col("slice_no").cast("string"))
    grouped = written(groups.select("row_id", unit.alias("unit_id")))
    first = grouped.groupBy("unit_id").agg(F.sort_array(F.collect_list("row_id")).alias("rows"))  # a slice has at most ``size`` rows
    members = first.select("unit_id", F.lit("group").alias("kind"), F.posexplode("rows").alias("pos", "row_id")).select("row_id", "unit_id", "kind", "pos")
    rest = units.single_units(segments.join(grouped, "row_id", "left_anti").select("row_id"), chunk)
    return members.unionByName(rest.select("row_id", "unit_id", F.lit("single").alias("kind"), "pos"))


def _web(members: DataFrame, seen: DataFrame, diagnosed: DataFrame, setting: Setting) -> DataFrame | None:
    """``(unit_id, web)``: web references of the units with no term, no sparse hit and no near vector; None if not asked for."""
    if not setting.web or setting.fetch is None:
        return None
    per = members.join(diagnosed.withColumnRenamed("query_id", "row_id").hint("merge"), "row_id").join(seen.hint("merge"), "row_id")
    per = per.groupBy("unit_id").agg(F.sum(F.size("terms")).alias("term_count"), F.sum("sparse_hits").alias("sparse_hits"), F.max("dense_top1").alias("dense_top1"))
    asked = units.representatives(members.withColumn("template", F.lit("")))
    cache = setting.cache if setting.cache is not None else members.sparkSession.createDataFrame([], enrich.CACHE)
    found, _ = enrich_weak_units(per.join(asked.hint("merge"), "unit_id"), cache, setting.fetch, setting.weak_least)
    refs = F.struct("pos", "title", "snippet", "url", "site_name", "image_url", F.lit(None).cast("string").alias("image_analysis"))
    return written(found.groupBy("unit_id").agg(F.array_sort(F.collect_list(refs)).alias("web")))


def messages(members: DataFrame, seen: DataFrame, terms: DataFrame, refs: DataFrame, k: int, setting: Setting, web: DataFrame | None = None) -> DataFrame:
    """``(unit_id, expected, message)`` of members (unit_id, pos, row_id, source, speaker, content_type).

    Sections in order, each only if it has something: header, style, rules of the content type, terms, references, web
    references, numbered sources, contract. ``seen(row_id, terms)`` are the matched glossary sources.
    """
    found = members.select("unit_id", "pos", "row_id").join(seen.hint("merge"), "row_id")
    listed = found.select("unit_id", "pos", F.posexplode("terms").alias("idx", "source"))
    listed = listed.groupBy("unit_id", "source").agg(F.min(F.struct("pos", "idx")).alias("seen"))
    listed = listed.join(terms.select("source", "target", "category").hint("merge"), "source")
    named = F.array_sort(F.collect_list(F.struct("seen", "source", "target", "category")))
    per_unit = listed.groupBy("unit_id").agg(named.alias("terms"))
    merged = retrieve.unit_references(members.select("unit_id", F.col("row_id").alias("query_id")), refs, k)
    hits = merged.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("nth", "source", "target", "score", "status"))).alias("refs"))
    turns = F.array_sort(F.collect_list(F.struct("pos", "source", "speaker")))
    kind = F.min_by("content_type", F.when(F.col("content_type").isNotNull(), F.col("pos")))
    out = members.groupBy("unit_id").agg(turns.alias("turns"), F.count("*").cast("int").alias("expected"), kind.alias("content_type"))
    out = out.join(per_unit.hint("merge"), "unit_id", "left").join(hits.hint("merge"), "unit_id", "left")
    pages = web if web is not None else members.sparkSession.createDataFrame([], "unit_id string, web array<" + "struct<title:string,snippet:string,url:string,site_name:string,image_url:string,image_analysis:string>>")
    out = out.join(pages.hint("merge"), "unit_id", "left")
    style = F.lit(None).cast("string")
    if setting.style is not None:
        general = setting.style.where("content_type is null").agg(F.max("rules").alias("general"))
        typed = setting.style.where("content_type is not null").select("content_type", F.col("rules").alias("typed"))
        out = out.join(typed.hint("merge"), "content_type", "left").crossJoin(F.broadcast(general))  # one row
        style = F.concat_ws("\n\n", "general", "typed")
    rules = F.lit(None).cast("string")
    for name, text in setting.rules.items():
        rules = F.when(rule_class(F.col("content_type")) == name, F.lit(text)).otherwise(rules)
    title = TITLES | setting.titles
    body = render.message([
        (None, F.lit(setting.header)), (title["style"], style), (title["rules"], rules), (title["terms"], render.term_lines(F.col("terms"))),
        (title["references"], render.reference_lines(F.col("refs"))), (title["web"], render.web_blocks(F.col("web"))),
        (title["source"], render.dialog_lines(F.col("turns"))), (title["output"], F.lit(setting.contract)),
    ])
    return out.select("unit_id", "expected", body.alias("message"))


def translate(
    segments: DataFrame, tm: DataFrame, terms: DataFrame, model: Callable[[str], str], dialogs: bool = False, k: int = 3, pattern_terms: int = PATTERN_TERMS,
    setting: Setting | None = None,
) -> DataFrame:
    """``(row_id, source, translation, reason, error, tm_exact)`` of every segment.

    Distinct segments only (all rows of dialogs), exact memory hits without a model call, the rest in units, with the
    references, terms, style, rules and web references of the ``setting``. Group and single units whose answer does not parse
    are asked again member by member; a dialog that fails is an error as a whole. Blank sources come back with an error, and a
    dialog with one is translated row by row. Dialogs without any id are an error.
    """
    setting = setting or Setting()
    rows = segments.withColumn("unique_id", F.col("row_id"))
    rows = rows if "content_type" in rows.columns else rows.withColumn("content_type", F.lit(None).cast("string"))
    empty = stripped(F.coalesce("source", F.lit(""))) == ""
    if dialogs:
        rows = rows.withColumn("dialog_id", F.when(stripped(F.col("dialog_id")) != "", stripped(F.col("dialog_id"))))
        rows = written(rows)
        if rows.where("dialog_id is not null").isEmpty():
            raise ValueError("no row has a dialog id")
        broken = rows.where(empty).select("dialog_id").where("dialog_id is not null").distinct().withColumn("_broken", F.lit(True))
        rows = rows.join(broken.hint("merge"), "dialog_id", "left").withColumn("dialog_id", F.when(F.col("_broken").isNull(), F.col("dialog_id"))).drop("_broken")
    else:
        rows = units.fan_out(rows.drop("unique_id"), units.distinct_segments(rows)).drop("n_copies")
    rows = written(rows)
    asked = rows.where(F.col("row_id") == F.col("unique_id")).where(~empty)
    scope = tm.where(F.col("collection") == setting.collection) if setting.collection is not None and "collection" in tm.columns else tm
    exact = written(memory.exact_matches(asked, scope))
    direct = exact.where("is_exact").select("row_id", F.col("target").alias("translation"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("tm_exact"))
    open_ = written(exact.where("not is_exact").select(*asked.columns))
    if dialogs:
        placed = units.dialog_members(open_)
        in_dialog = placed.where("kind = 'dialog'").select("row_id", F.concat(F.lit("dialog-"), "dialog_id").alias("unit_id"), "pos", "kind")
        chunks = units.single_units(placed.where("kind = 'single'").select("row_id"), 50)
        members = in_dialog.unionByName(chunks.select("row_id", "unit_id", "pos", F.lit("single").alias("kind")))
    else:
        members = group_units(open_)
    speaker = F.col("speaker") if "speaker" in open_.columns else F.lit(None).cast("string")
    members = written(written(members).join(open_.select("row_id", "source", "content_type", speaker.alias("speaker")).hint("merge"), "row_id"))
    hits, diagnosed = references(open_, scope, k, setting=setting)
    refs, diagnosed = written(hits), written(diagnosed)
    seen = written(glossary.matches(open_.select("row_id", F.col("source").alias("text")), terms, pattern_terms=pattern_terms).select("row_id", "terms"))

    def said(some: DataFrame) -> DataFrame:
        sent = written(messages(some, seen, terms, refs, k, setting, _web(some, seen, diagnosed, setting)))
        return written(infer.answers(sent, model, workers=setting.workers).join(sent.select("unit_id", "expected").hint("merge"), "unit_id"))

    whole, apart = members.where("kind = 'dialog'"), members.where("kind <> 'dialog'")
    first = written(_parsed(said(apart), "numbered"))
    again = written(infer.failed_members(apart, first))
    second = _parsed(said(again), "single")
    given = apart.select("unit_id", "pos", "row_id").unionByName(again.select("unit_id", "pos", "row_id"))
    answered = first.unionByName(second).join(given.hint("merge"), ["unit_id", "pos"]).select("row_id", "translation", "reason", "error")
    best = F.max_by(F.struct("translation", "reason", "error"), F.struct(F.col("error").isNull(), "translation"))
    answered = answered.groupBy("row_id").agg(best.alias("a")).select("row_id", "a.*")
    if dialogs:
        answered = answered.unionByName(infer.dialog_results(whole, said(whole)).drop("status"))
    done = written(direct.unionByName(answered.withColumn("tm_exact", F.lit(False))))
    if setting.results:
        unit = members.select("row_id", "unit_id", "pos")
        saved = done.join(unit.hint("merge"), "row_id", "left").select(
            F.lit(setting.task_id).alias("task_id"), F.coalesce("unit_id", F.concat(F.lit("tm-"), "row_id")).alias("unit_id"), F.coalesce("pos", F.lit(0)).alias("pos"), "row_id",
            F.col("translation").alias("result"), "error", F.current_timestamp().alias("saved_at"),
        )
        sinks.append_results(saved, setting.results)
    out = rows.select("row_id", "source", "unique_id").join(done.withColumnRenamed("row_id", "unique_id").hint("merge"), "unique_id", "left")
    return out.select("row_id", "source", "translation", "reason", F.when(empty, "empty source").otherwise(F.col("error")).alias("error"), F.coalesce("tm_exact", F.lit(False)).alias("tm_exact"))


def saved_progress(spark: SparkSession, setting: Setting) -> DataFrame:
    """Progress of a task from its saved results: units all of whose rows have one without an error are done."""
    rows = files.read_job_results(spark, setting.results, setting.task_id)
    per = rows.groupBy("unit_id").agg(F.count("*").alias("n_members"), F.count("error").alias("failed"))
    return units.progress(per.select("unit_id", "n_members"), per.where("failed = 0"))


def _parsed(said: DataFrame, form: str) -> DataFrame:
    """Parsed answers ``(unit_id, pos, translation, reason, error)``; for single units also the failed ones."""
    none = F.lit(None).cast("string")
    if form == "single":
        out = infer.parse_single(said).join(said.select("unit_id", "error").hint("merge"), "unit_id")
        return out.select("unit_id", F.lit(0).alias("pos"), F.when(F.col("error").isNull(), F.regexp_replace("translation", r"^\s*1[.)]\s*", "")).alias("translation"), "reason", "error")
    return infer.parse_numbered(said.where("error is null")).select("unit_id", (F.col("pos") - 1).alias("pos"), "translation", "reason", none.alias("error"))


def import_folder(
    spark: SparkSession, folder: str, root: str, namespace: uuid.UUID, default_status: str | None = None, commit: bool = True, limit: int | None = None, collection: str | None = None, embed=None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Import all memory exports of a folder into the index at ``root``: ``(summary, counts of each file, files that failed)``.

    A file that cannot be decoded is put aside and the rest goes on. Candidates of unknown status stay out and are counted.
    Without ``commit`` only the plan is made.
    """
    candidates, failed = files.isolated_exports(spark, folder, default_status, limit)
    candidates = written(candidates.withColumn("row_id", F.monotonically_increasing_id()))
    counts = memory.file_counts(candidates)
    good = candidates.where("status is not null")
    held = index.points(spark, root)
    plan = written(memory.import_plan(good, spark.createDataFrame([], "pair_id string, source string, target string, status string") if held is None else held))
    summary = written(memory.plan_summary(plan))
    if commit:
        index.load(spark, root, good, namespace, collection, embed)
    return summary, counts, failed


def import_memory(candidates: DataFrame, index: DataFrame, namespace: uuid.UUID, commit: bool = True, embed=None, collection: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The summary of an import, and the new index if it is to be made; without ``commit`` nothing but the plan is computed.

    Upgraded pairs keep their stored vectors and their collection, new ones come into ``collection``. With ``embed``
    (DataFrame(source) to DataFrame(source, dense)) each other new source is embedded once.
    """
    plan = written(memory.import_plan(candidates, index))
    if not commit:
        return memory.plan_summary(plan), None
    return memory.plan_summary(plan), memory.apply_plan(plan, index, namespace, memory.plan_vectors(plan, index, embed) if embed else None, collection)


def enrich_weak_units(
    diagnosed: DataFrame, cache: DataFrame, fetch: Callable[[str], str | None] | None, least: float = 0.5, prefix=None, asked: bool = True
) -> tuple[DataFrame, DataFrame]:
    """References of weakly recalled units ``(unit_id, query, term_count, sparse_hits, dense_top1)`` and the filled cache.

    ``query`` is a unit's one representative (``units.representatives``). Nothing is looked up if it was not
    ``asked`` for or there is no ``fetch``.
    """
    if not asked or fetch is None:
        diagnosed = diagnosed.where("false")
        fetch = fetch or (lambda query: None)
    weak = retrieve.weak_recall(diagnosed, least).where("weak").select("unit_id", "query")
    split = written(enrich.cache_split(weak, cache, prefix))
    filled = written(enrich.cache_with(cache, enrich.enriched(split.where("not hit").select("key", "query"), fetch)))
    parsed = enrich.parsed_responses(filled.select("key", F.col("results").alias("body")))
    return split.select("unit_id", "key").join(written(parsed).hint("merge"), "key"), filled
