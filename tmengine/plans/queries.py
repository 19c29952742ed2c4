"""Every registered query of the engine with its DuckDB equivalent."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmengine.functions import text as fn
from tmengine.operators import cells, cluster, enrich, glossary, infer, memory, projects, render, retrieve, textindex, units
from tmengine.plans import inputs as src
from tmengine.plans import storage
from tmengine.sources import files, sinks

QUERIES: dict[str, Callable] = dict(storage.QUERIES)
ORACLES: dict[str, str] = dict(storage.ORACLES)

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RANK = "CASE status WHEN 'Designer Reviewed' THEN 1 WHEN 'CQA_Done' THEN 2 WHEN 'Done_LQA edited' THEN 3 WHEN 'Done' THEN 4 ELSE 99 END"
WEIGHT = "CASE status WHEN 'Designer Reviewed' THEN 1.0::DOUBLE WHEN 'CQA_Done' THEN 0.97 WHEN 'Done_LQA edited' THEN 0.94 WHEN 'Done' THEN 0.9 ELSE 0.85 END"
TM = f"tm AS (SELECT *, {RANK} AS rank FROM (SELECT p_partkey::BIGINT AS row_id, p_name AS source, p_brand || ' ' || p_type AS target, {src.STATUS_SQL} AS status FROM part))"


def query(sql: str | None = None):
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# --- translation memory -------------------------------------------------------------------------------------------


@query(f"""WITH {TM} SELECT source, target, first(row_id ORDER BY rank, row_id) AS row_id, first(status ORDER BY rank, row_id) AS status,
min(rank) AS rank, count(*) AS n_rows FROM tm GROUP BY source, target""")
def tm_best(spark, d):
    return memory.best_by_pair(src.memory(spark, d))


EXACT = f"""WITH {TM}, b AS (SELECT source, target, min(rank) AS rank, first(status ORDER BY rank) AS status FROM tm GROUP BY source, target),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, target) AS nth FROM b),
s AS (SELECT p_partkey::BIGINT AS row_id, CASE WHEN p_size % 5 = 0 THEN p_name || ' x' ELSE p_name END AS source FROM part)
SELECT s.row_id, s.source, n.target, n.status, n.rank, n.nth, n.target IS NOT NULL AS is_exact, CASE WHEN n.target IS NOT NULL THEN 1.0::DOUBLE END AS score
FROM s LEFT JOIN n ON s.source = n.source AND nth <= """


def _asked(spark, d):
    name = F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name"))
    return src.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("row_id"), name.alias("source"))


@query(EXACT + "1")
def tm_exact(spark, d):
    return memory.exact_matches(_asked(spark, d), src.memory(spark, d))


@query(EXACT + "3")
def tm_exact_top3(spark, d):
    return memory.exact_matches(_asked(spark, d), src.memory(spark, d), 3)


PLAN = f"""WITH {TM}, inc AS (SELECT source, target, first(row_id ORDER BY rank, row_id) AS row_id, first(status ORDER BY rank, row_id) AS status, min(rank) AS rank,
count(*) AS n_rows FROM tm WHERE row_id % 3 <> 0 GROUP BY source, target),
old AS (SELECT *, 'point-' || lpad(row_id::VARCHAR, 12, '0') AS pair_id FROM tm WHERE row_id % 3 = 0),
ex AS (SELECT source, target, min(rank) AS old_rank, first(pair_id ORDER BY rank, pair_id) AS reuse_id, string_agg(pair_id, ',' ORDER BY pair_id) AS ids FROM old GROUP BY source, target),
plan AS (SELECT inc.*, CASE WHEN old_rank IS NULL THEN 'embed' WHEN old_rank <= rank THEN 'skip' ELSE 'clone' END AS action, ex.reuse_id, ex.ids
FROM inc LEFT JOIN ex USING (source, target))"""


def _plan(spark, d):
    stored, incoming = src.stored_and_incoming(spark, d)
    return memory.import_plan(incoming, stored), stored


@query(PLAN + """ SELECT source, target, row_id, status, rank, n_rows, action, CASE WHEN action = 'clone' THEN reuse_id END AS reuse_id,
CASE WHEN action = 'clone' THEN ids END AS obsolete_ids FROM plan""")
def tm_plan(spark, d):
    return _plan(spark, d)[0].withColumn("obsolete_ids", F.array_join("obsolete_ids", ","))


@query(PLAN + """ SELECT sum(n_rows)::BIGINT AS candidates, count(*) AS unique_pairs, sum(n_rows - 1)::BIGINT AS duplicates, count(*) FILTER (action = 'skip') AS skipped,
count(*) FILTER (action = 'embed') AS new, count(DISTINCT source) FILTER (action = 'embed') AS new_sources, count(*) FILTER (action = 'clone') AS upgraded FROM plan""")
def tm_plan_summary(spark, d):
    return memory.plan_summary(_plan(spark, d)[0])


UUID5 = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr(h, 17, 1))::INT % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""
NS = "from_hex('" + NAMESPACE.hex + "')"


#: The stored points in three collections, with their vectors where embeddings has one of their number.
STORED = ", sv AS (SELECT old.*, 'c' || row_id % 3 || row_id % 2 AS collection, e.embedding::DOUBLE[] AS dense FROM old LEFT JOIN embeddings e ON e.vec_id = old.row_id)"
#: Points that go, and those that come with the collection and vector of the one they replace.
APPLIED = PLAN + STORED + f""", gone AS (SELECT DISTINCT old.pair_id FROM old JOIN plan USING (source, target) WHERE action = 'clone'),
fresh AS (SELECT plan.*, sha1({NS} || encode(source || chr(31) || target || chr(31) || coalesce(status, ''))) AS h, sv.dense, coalesce(sv.collection, 'main') AS collection FROM plan
LEFT JOIN (SELECT pair_id, dense, collection FROM sv) sv ON action = 'clone' AND sv.pair_id = plan.reuse_id WHERE action <> 'skip')
SELECT pair_id, source, target, status, row_id, collection, round(list_sum(dense), 4) AS total FROM sv WHERE pair_id NOT IN (SELECT pair_id FROM gone)
UNION ALL SELECT {UUID5}, source, target, status, row_id, collection, """


def _plan_with_vectors(spark, d):
    plan, stored = _plan(spark, d)
    held = src.table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("row_id"), F.col("embedding").cast("array<double>").alias("dense"))
    stored = stored.withColumn("collection", F.concat(F.lit("c"), F.col("row_id") % 3, F.col("row_id") % 2))
    return plan, stored.join(held.hint("merge"), "row_id", "left")


def _applied(made):
    return made.select("pair_id", "source", "target", "status", "row_id", "collection", F.round(F.aggregate("dense", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(APPLIED + "round(list_sum(dense), 4) FROM fresh")
def tm_apply_plan(spark, d):
    """Without a model: upgraded points keep vector and collection, new ones have no vector yet."""
    plan, stored = _plan_with_vectors(spark, d)
    return _applied(memory.apply_plan(plan, stored, NAMESPACE, collection="main"))


@query(APPLIED + "CASE WHEN dense IS NOT NULL THEN round(list_sum(dense), 4) ELSE length(source) + 0.5::DOUBLE END FROM fresh")
def tm_import_vectors(spark, d):
    plan, stored = _plan_with_vectors(spark, d)
    embed = lambda sources: sources.select("source", F.array(F.length("source").cast("double"), F.lit(0.5)).alias("dense"))
    return _applied(memory.apply_plan(plan, stored, NAMESPACE, memory.plan_vectors(plan, stored, embed), "main"))


@query("SELECT p_type AS source_file, count(*) AS candidates, count(*) FILTER (p_partkey % 6 = 5) AS unknown_status FROM part GROUP BY p_type")
def import_file_counts(spark, d):
    kind = src.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("row_id"), F.col("p_type").alias("source_file"))
    return memory.file_counts(src.memory(spark, d).join(kind.hint("merge"), "row_id"))


@query(f"""WITH {TM}, made AS (SELECT DISTINCT source, target FROM tm WHERE row_id % 7 <> 0) SELECT count(*) AS parsed, (SELECT count(*) FROM made) AS indexed, count(*) - (SELECT count(*) FROM made) AS dropped FROM tm""")
def load_counts(spark, d):
    parsed = src.memory(spark, d).withColumn("source", F.when(F.col("row_id") % 7 == 0, F.lit(" ")).otherwise(F.col("source")))
    indexed = memory.best_by_pair(parsed.where(F.trim("source") != ""))
    return memory.load_counts(parsed, indexed)


@query(f"""WITH {TM}, x AS (SELECT *, sha1({NS} || encode(source || chr(31) || target || chr(31) || coalesce(status, ''))) AS h FROM tm) SELECT row_id, {UUID5} AS pair_id FROM x""")
def pair_ids(spark, d):
    return src.memory(spark, d).select("row_id", fn.pair_id(F.col("source"), F.col("target"), F.col("status"), NAMESPACE).alias("pair_id"))


@query(PLAN + """ SELECT source, target, status, reuse_id, round(list_sum(e.embedding::DOUBLE[]), 4) AS total, e.vec_id IS NULL AS missing
FROM plan LEFT JOIN embeddings e ON e.vec_id = substr(reuse_id, 7)::BIGINT WHERE action = 'clone'""")
def vector_reuse(spark, d):
    plan, _ = _plan(spark, d)
    stored = src.table(spark, d, "embeddings").select(F.concat(F.lit("point-"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("pair_id"), F.col("embedding").alias("dense"))
    total = F.round(F.aggregate("dense", F.lit(0.0), lambda s, x: s + x), 4)
    return memory.reused_vectors(plan, stored).select("source", "target", "status", "reuse_id", total.alias("total"), "missing")


@query("""SELECT c_custkey::BIGINT AS row_id, CASE c_custkey % 8 WHEN 0 THEN 'Designer Reviewed' WHEN 1 THEN 'CQA_Done' WHEN 2 THEN 'Done_LQA edited' WHEN 3 THEN 'Done' WHEN 4 THEN 'Done'
WHEN 5 THEN 'Designer Reviewed' WHEN 6 THEN c_mktsegment END AS status FROM customer""")
def file_status(spark, d):
    word = F.expr("CASE c_custkey % 8 WHEN 0 THEN 'Designer' WHEN 1 THEN 'my_CQA' WHEN 2 THEN 'x-lqa-latest' WHEN 3 THEN 'GT' WHEN 4 THEN 'ST' WHEN 5 THEN 'cqa designer' ELSE 'memo' END")
    file = F.concat("c_name", F.lit("/"), word, F.lit(".sdltm"))
    default = F.when(F.col("c_custkey") % 8 == 6, F.col("c_mktsegment"))
    return src.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("row_id"), fn.status_from_file(file, default).alias("status"))


@query(f"""WITH {TM} SELECT row_id, coalesce(source, '') AS source, coalesce(status, '') AS status, {RANK} AS rank, {WEIGHT} AS weight FROM tm""")
def clean_cells(spark, d):
    rows = src.memory(spark, d)
    padded = F.concat(F.lit(" \t"), "source", F.lit("\n "))
    return rows.select("row_id", fn.clean_cell(padded).alias("source"), fn.clean_cell(F.coalesce("status", F.lit(" NaN "))).alias("status"), fn.status_rank(F.col("status")).alias("rank"), fn.status_weight(F.col("status")).alias("weight"))


@query("SELECT doc_id::BIGINT AS doc_id, md5(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) AS cleaned FROM documents")
def memory_text(spark, d):
    spaced = F.concat(F.lit(" "), "text", F.lit("\t "))
    return src.table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(fn.memory_text(spaced).cast("binary")).alias("cleaned"))


@query("SELECT p_partkey::BIGINT AS row_id, p_name || ' & <' || p_type || '>' AS text FROM part")
def segment_text(spark, d):
    part = src.table(spark, d, "part")
    escaped = F.concat("p_name", F.lit(" &amp; &lt;"), "p_type", F.lit("&gt;"))
    first = F.expr("length(p_name)")
    xml = F.concat(
        F.lit('<Segment xmlns="urn:x"><Elements><Text><Value>'), F.substring(escaped, F.lit(1), first), F.lit("</Value></Text><Tag><TagID>9</TagID><Anchor>1</Anchor></Tag><Text>"),
        F.substring(escaped, first + 1, F.length(escaped)), F.lit("</Text></Elements></Segment>"),
    )
    return files.checked_segments(part.select(F.col("p_partkey").cast("long").alias("row_id"), xml.alias("xml"))).select("row_id", "text")


# --- glossary -----------------------------------------------------------------------------------------------------


@query(f"WITH {src.GLOSSARY_SQL} SELECT * FROM terms")
def glossary_load(spark, d):
    return glossary.load(src.glossary_entries(spark, d))


@query(f"""WITH {src.GLOSSARY_SQL}, p AS (SELECT *, (SELECT count(*) FROM terms) AS total FROM terms ORDER BY length(source) DESC, row_id LIMIT 10 OFFSET 5) SELECT * FROM p""")
def glossary_page(spark, d):
    return glossary.page(glossary.load(src.glossary_entries(spark, d)), 10, 5)


@query("""WITH o AS (SELECT DISTINCT p_name || ' ' || p_size AS source FROM part WHERE p_brand < 'Brand#2'), n AS (SELECT DISTINCT p_name || ' ' || p_size AS source FROM part WHERE p_brand >= 'Brand#2')
SELECT source, CASE WHEN source IN (SELECT source FROM o) THEN 'updated' ELSE 'added' END AS change FROM n""")
def glossary_diff(spark, d):
    part = src.table(spark, d, "part").withColumn("source", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")))
    return glossary.difference(part.where("p_brand < 'Brand#2'"), part.where("p_brand >= 'Brand#2'"))


@query(f"""WITH {src.GLOSSARY_SQL} SELECT row_id, s.source, t.target AS term_target FROM (SELECT p_partkey::BIGINT AS row_id, CASE WHEN p_size % 5 = 0 THEN p_name || ' x' ELSE p_name END AS source FROM part) s
LEFT JOIN (SELECT source, target FROM terms) t USING (source)""")
def glossary_lookup(spark, d):
    return glossary.lookup(_asked(spark, d), glossary.load(src.glossary_entries(spark, d)))


@query(f"WITH {src.GLOSSARY_SQL} SELECT category, count(*) AS n_terms, string_agg(source, '|' ORDER BY source) AS sources FROM terms WHERE category IS NOT NULL GROUP BY category")
def glossary_by_category(spark, d):
    return glossary.by_category(glossary.load(src.glossary_entries(spark, d)))


MATCHED = f"""WITH {src.GLOSSARY_SQL}, pat AS (SELECT string_agg(source, '|' ORDER BY length(source) DESC, source) AS p FROM terms),
t AS (SELECT ps_row AS row_id, unit, pos, txt FROM (SELECT p_partkey::BIGINT AS ps_row, p_size AS unit, p_partkey::BIGINT AS pos, p_name || ' with ' || p_name || ' and ' || lower(p_type) || ' ' || p_name || 's' AS txt FROM part)),
m AS (SELECT row_id, unit, pos, unnest(regexp_extract_all(txt, (SELECT p FROM pat))) AS term, generate_subscripts(regexp_extract_all(txt, (SELECT p FROM pat)), 1) AS i FROM t)"""


def _matched(spark, d):
    name = F.concat("p_name", F.lit(" with "), "p_name", F.lit(" and "), F.lower("p_type"), F.lit(" "), "p_name", F.lit("s"))
    texts = src.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("row_id"), F.col("p_size").alias("unit"), name.alias("text"))
    return glossary.matches(texts, glossary.load(src.glossary_entries(spark, d)))


@query(MATCHED + " SELECT row_id, string_agg(term, '|' ORDER BY f) AS terms FROM (SELECT row_id, term, min(i) AS f FROM m GROUP BY row_id, term) GROUP BY row_id")
def term_match(spark, d):
    return _matched(spark, d).select("row_id", F.array_join("terms", "|").alias("terms"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT doc_id, line, min(i) AS i FROM l WHERE line <> '' GROUP BY doc_id, line)
SELECT d.doc_id::BIGINT AS doc_id, count(f.line) AS n_terms, md5(coalesce(string_agg(f.line, chr(10) ORDER BY f.i), '')) AS found FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def line_glossary(spark, d):
    """Every distinct line of every document as a glossary, matched against all documents: each holds its own lines."""
    docs = src.table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("source")).where("source <> ''")
    found = glossary.joined_matches(docs, lines)
    return found.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", "\n").cast("binary")).alias("found"))


@query(MATCHED + """ SELECT unit::VARCHAR AS unit_id, string_agg(term, '|' ORDER BY pos, i) AS terms FROM
(SELECT unit, term, min(pos) AS pos, arg_min(i, pos * 1000 + i) AS i FROM m GROUP BY unit, term) GROUP BY unit""")
def unit_terms(spark, d):
    members = _matched(spark, d).select(F.col("unit").cast("string").alias("unit_id"), F.col("row_id").alias("pos"), "terms")
    return glossary.unit_terms(members).withColumn("terms", F.array_join("terms", "|"))


# --- work units ---------------------------------------------------------------------------------------------------


@query(f"""WITH {src.SEGMENTS_SQL}, u AS (SELECT source, content_type, min(row_id) AS unique_id, count(*) AS n_copies FROM segments GROUP BY ALL)
SELECT s.row_id, s.source, s.content_type, u.unique_id, u.n_copies FROM segments s JOIN u ON s.source = u.source AND s.content_type IS NOT DISTINCT FROM u.content_type""")
def dedup_fanout(spark, d):
    segments = src.segments(spark, d)
    return units.fan_out(segments, units.distinct_segments(segments))


@query(f"""WITH {src.SEGMENTS_SQL}, u AS (SELECT count(*) AS n FROM (SELECT DISTINCT source, content_type FROM segments))
SELECT (SELECT count(*) FROM segments) AS total, n AS unique, (SELECT count(*) FROM segments) - n AS saved, round(((SELECT count(*) FROM segments) - n) * 100.0::DOUBLE / (SELECT count(*) FROM segments), 2) AS saved_pct FROM u""")
def dedup_saving(spark, d):
    return units.dedup_saving(src.segments(spark, d))


@query(f"""WITH {src.DIALOGS_SQL} SELECT row_id, dialog_id, kind, speaker, CASE WHEN kind = 'single' THEN 0 ELSE row_number() OVER (PARTITION BY dialog_id ORDER BY time NULLS FIRST, row_id) - 1 END AS pos FROM members""")
def dialog_units(spark, d):
    return units.dialog_members(src.dialogs(spark, d)).select("row_id", "dialog_id", "kind", "speaker", "pos")


SINGLES = f"WITH {src.DIALOGS_SQL}, n AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place FROM members WHERE kind = 'single')"


@query(SINGLES + " SELECT row_id, 'single-' || (place // 5) AS unit_id, place % 5 AS pos FROM n")
def single_units(spark, d):
    rest = units.dialog_members(src.dialogs(spark, d)).where("kind = 'single'").select("row_id")
    return units.single_units(rest, 5)


@query(f"""WITH {src.SEGMENTS_SQL} SELECT source AS unit_id, first(content_type ORDER BY row_id) FILTER (content_type IS NOT NULL) AS content_type, count(*) AS n_members FROM segments GROUP BY source""")
def unit_types(spark, d):
    return units.unit_types(src.segments(spark, d).select(F.col("source").alias("unit_id"), F.col("row_id").alias("pos"), "content_type"))


UNITS = "WITH u AS (SELECT conv_id::VARCHAR AS unit_id, count(*) AS n_members FROM conversations GROUP BY 1), done AS (SELECT DISTINCT conv_id::VARCHAR AS unit_id FROM conversations WHERE role = 'system')"


def _units(spark, d):
    c = src.table(spark, d, "conversations")
    name = F.col("conv_id").cast("string").alias("unit_id")
    return c.groupBy(name).agg(F.count("*").alias("n_members")), c.where("role = 'system'").select(name)


@query(UNITS + " SELECT * FROM u WHERE unit_id NOT IN (SELECT unit_id FROM done)")
def resume_pending(spark, d):
    return units.pending(*_units(spark, d))


@query(UNITS + """, s AS (SELECT u.*, done.unit_id IS NOT NULL AS ok FROM u LEFT JOIN done USING (unit_id))
SELECT sum(n_members)::BIGINT AS total, coalesce(sum(n_members) FILTER (ok), 0)::BIGINT AS completed, count(*) AS units, count(*) FILTER (ok) AS units_done,
round(coalesce(sum(n_members) FILTER (ok), 0) * 100.0::DOUBLE / sum(n_members), 2) AS progress_pct, CASE WHEN bool_and(ok) THEN 'completed' ELSE 'running' END AS status FROM s""")
def job_progress(spark, d):
    return units.progress(*_units(spark, d))


@query("""WITH e AS (SELECT o_orderkey::BIGINT * 10 AS start, o_orderkey::BIGINT * 10 + 10 AS stop, o_orderpriority LIKE '5%' AS ko FROM orders),
t AS (SELECT min(start) FILTER (ko) AS a, max(stop) AS b, count(*) FILTER (NOT ko) * 10 AS rows_done FROM e) SELECT coalesce(a, b) AS safe_offset, rows_done FROM t""")
def contiguous_offset(spark, d):
    o = src.table(spark, d, "orders").select((F.col("o_orderkey").cast("long") * 10).alias("start"), (F.col("o_orderkey").cast("long") * 10 + 10).alias("stop"), "o_orderpriority")
    return units.contiguous_offset(o.select("start", "stop"), o.where("o_orderpriority not like '5%'"))


@query("""SELECT c_name AS key, c_mktsegment AS stored, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '*' END AS asked FROM customer WHERE c_custkey % 5 <> 0 AND (c_custkey % 3 = 0 OR c_custkey % 3 = 1)""")
def context_diff(spark, d):
    c = src.table(spark, d, "customer")
    stored = c.select(F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("value"))
    asked = c.where("c_custkey % 3 <> 1").select(F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 3 == 0, F.concat("c_mktsegment", F.lit("*"))).otherwise(F.col("c_mktsegment")).alias("value"))
    return units.context_difference(stored, asked)


@query("SELECT o_orderkey::BIGINT AS row_id FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 100")
def debug_part(spark, d):
    return units.part_of(src.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("row_id")), "row_id", 500, 100)


@query("""SELECT conv_id::VARCHAR AS unit_id, CASE WHEN conv_id % 3 = 0 THEN 't' || conv_id ELSE first(text ORDER BY turn) END AS query FROM conversations GROUP BY conv_id""")
def unit_representatives(spark, d):
    c = src.table(spark, d, "conversations")
    template = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("t"), F.col("conv_id"))).otherwise(F.lit(""))
    return units.representatives(c.select(F.col("conv_id").cast("string").alias("unit_id"), F.col("turn").alias("pos"), F.col("text").alias("source"), template.alias("template")))


@query(f"""WITH {src.OUTPUTS_SQL} SELECT c.conv_id::BIGINT * 1000 + c.turn AS row_id, CASE WHEN c.conv_id % 7 = 3 THEN '[ERROR: DIALOG_PARSE_FAIL] ' || coalesce(c.text, '')
WHEN c.conv_id % 7 = 5 THEN '[ERROR: DIALOG_LLM_FAIL] ' || coalesce(c.text, '') ELSE o.translation END AS translation, CASE WHEN c.conv_id % 7 NOT IN (3, 5) THEN o.reason END AS reason,
CASE WHEN c.conv_id % 7 IN (3, 5) THEN 'error' ELSE 'success' END AS status, CASE c.conv_id % 7 WHEN 3 THEN 'the answer does not have the expected lines' WHEN 5 THEN 'Timeout: ' || c.conv_id END AS error
FROM conversations c JOIN counted o ON o.unit_id = c.conv_id::VARCHAR AND o.turn = c.turn""")
def dialog_results(spark, d):
    said = src.unit_outputs(spark, d)
    kind = F.col("unit_id").cast("long") % 7
    lost = F.when(kind == 5, F.concat(F.lit("Timeout: "), "unit_id"))
    said = said.withColumn("error", lost).withColumn("raw", F.when(kind == 3, F.concat(F.lit("1. one line too many\n"), "raw")).when(kind != 5, F.col("raw")))
    c = src.table(spark, d, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = c.select(F.col("conv_id").cast("string").alias("unit_id"), place.alias("pos"), (F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("source"))
    return infer.dialog_results(rows, said)


#: Saved results of every order's lines: some saved twice, some with a failed attempt before or after.
RESULTS = "WITH r AS (SELECT 't' AS task_id, l_orderkey::VARCHAR AS unit_id, l_linenumber::INT AS pos, 'r' || try AS raw, CASE WHEN (l_orderkey + try) % 3 = 0 THEN 'failed' END AS error, try AS saved_at FROM lineitem, (SELECT unnest([1, 2, 3]) AS try) WHERE try <= 1 + l_orderkey % 3)"


@query(RESULTS + """ SELECT task_id, unit_id, pos, raw, error, saved_at FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, pos ORDER BY error IS NULL DESC, saved_at DESC) AS nth FROM r) WHERE nth = 1""")
def result_readback(spark, d):
    tries = F.explode(F.sequence(F.lit(1), (F.col("l_orderkey") % 3 + 1).cast("int")))
    rows = src.table(spark, d, "lineitem").select(F.lit("t").alias("task_id"), F.col("l_orderkey").cast("string").alias("unit_id"), F.col("l_linenumber").cast("int").alias("pos"), "l_orderkey", tries.alias("saved_at"))
    failed = F.when((F.col("l_orderkey") + F.col("saved_at")) % 3 == 0, "failed")
    return files.latest_results(rows.select("task_id", "unit_id", "pos", F.concat(F.lit("r"), "saved_at").alias("raw"), failed.alias("error"), "saved_at"))


@query("SELECT event_type AS outcome, count(*) AS n_files FROM events GROUP BY event_type")
def run_totals(spark, d):
    return units.outcome_totals(src.table(spark, d, "events").withColumnRenamed("event_type", "outcome"))


@query(f"""WITH {TM}, s AS ({EXACT.replace("WITH " + TM + ",", "WITH")}1) SELECT row_id, coalesce(target, upper(source)) AS translation, is_exact AS adopted FROM s""")
def direct_merge(spark, d):
    asked = memory.exact_matches(_asked(spark, d), src.memory(spark, d))
    direct = asked.where("is_exact").select("row_id", F.col("target").alias("translation"), F.lit(True).alias("adopted"))
    return units.merge_direct(direct, asked.select("row_id", F.upper("source").alias("translation"), F.lit(False).alias("adopted")))


# --- retrieval ----------------------------------------------------------------------------------------------------

POSTED = """WITH RECURSIVE ix AS (SELECT doc_id::BIGINT AS pair_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS token FROM documents) GROUP BY ALL),
qs AS (SELECT item_id::BIGINT AS query_id, token, count(*) AS q_tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS token FROM benchmark) GROUP BY ALL),
idf AS (SELECT token, count(*) AS df, ln(1.0::DOUBLE + ((SELECT count(*) FROM documents)::DOUBLE - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM ix GROUP BY token),
sp AS (SELECT query_id, pair_id, round(sum(q_tf * idf * tf), 6) AS score FROM qs JOIN idf USING (token) JOIN ix USING (token) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pair_id) AS nth FROM sp) WHERE nth <= 20),
bq AS (SELECT item_id::BIGINT AS query_id, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = item_id) AS v FROM benchmark),
co AS (SELECT query_id, vec_id::BIGINT AS pair_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score FROM bq JOIN embeddings ON v IS NOT NULL),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pair_id) AS nth FROM co WHERE score >= 0.2) WHERE nth <= 20)"""
HYBRID = POSTED + f""", ff AS (SELECT query_id, pair_id, round(sum(1.0::DOUBLE / (60 + nth)), 9) AS score FROM (SELECT query_id, pair_id, nth FROM sparse UNION ALL SELECT query_id, pair_id, nth FROM dense) GROUP BY ALL),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pair_id) AS nth FROM ff) WHERE nth <= 13),
ixr AS (SELECT doc_id::BIGINT AS pair_id, md5(text) AS source, lang || '-' || source AS target,
  CASE doc_id % 6 WHEN 0 THEN 'Designer Reviewed' WHEN 1 THEN 'CQA_Done' WHEN 2 THEN 'Done_LQA edited' WHEN 3 THEN 'Done' WHEN 4 THEN 'Draft' END AS status FROM documents),
hj AS (SELECT query_id, pair_id, score, source, target, status, {RANK} AS rank, {WEIGHT} AS w FROM fu JOIN ixr USING (pair_id)),
h1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, target ORDER BY rank, score DESC, pair_id) AS one FROM hj) WHERE one = 1),
hits AS (SELECT query_id, source, target, pair_id, score, status, nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score * w, 9) DESC, score DESC, pair_id) AS nth FROM h1) WHERE nth <= 3)"""


def _texts(spark, d):
    return src.documents_index(spark, d), src.benchmark_queries(spark, d)


def _sparse(spark, d):
    index, asked = _texts(spark, d)
    n = index.agg(F.count("*").alias("n"))
    return retrieve.sparse_hits(textindex.postings(asked, "query_id"), textindex.counted(index, "pair_id"), n, 20)


def _dense(spark, d, least: float = 0.2):
    _, index = src.vectors(spark, d)
    asked = src.benchmark_queries(spark, d).join(index.withColumnRenamed("pair_id", "query_id"), "query_id").select("query_id", "vector")
    return retrieve.dense_scores(asked, index, 20, least)


@query("SELECT doc_id::BIGINT AS pair_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS token FROM documents) GROUP BY ALL")
def tf(spark, d):
    return textindex.counted(_texts(spark, d)[0], "pair_id").select("pair_id", F.inline("counts"))


@query("""WITH w AS (SELECT p_partkey::BIGINT AS row_id, substr('甲乙丙丁戊己庚辛壬癸', (p_size % 10 + 1)::INT, 1) AS a, substr('子丑寅卯辰巳午未申酉', (p_partkey % 10 + 1)::INT, 1) AS b, p_size % 2 = 0 AS word FROM part)
SELECT row_id, CASE WHEN word THEN a || b || '|x' || row_id || '|' || a || b ELSE a || '|' || b || '|x' || row_id || '|' || a || '|' || b END AS tokens FROM w""")
def segment_words(spark, d):
    """Two Han characters, a code and the characters again; pairs that begin with every second character are words of the dictionary."""
    pick = lambda letters, n: F.element_at(F.array(*[F.lit(c) for c in letters]), (n % 10 + 1).cast("int"))
    part = src.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("row_id"), "p_size", pick("甲乙丙丁戊己庚辛壬癸", F.col("p_size")).alias("a"), pick("子丑寅卯辰巳午未申酉", F.col("p_partkey")).alias("b"))
    words = part.where("p_size % 2 = 0").groupBy(F.concat("a", "b").alias("word")).agg(F.count("*").alias("freq"))
    texts = part.select("row_id", F.concat("a", "b", F.lit(" X"), "row_id", F.lit("，"), "a", "b").alias("text"))
    return textindex.segmented(texts, words).select("row_id", F.array_join("tokens", "|").alias("tokens"))


@query(POSTED + " SELECT token, df, round(idf, 6) AS idf, ('0x' || left(md5(token), 8))::BIGINT AS hash FROM idf")
def idf(spark, d):
    index = _texts(spark, d)[0]
    out = textindex.inverse_frequencies(textindex.counted(index, "pair_id").select(F.inline("counts")), index.agg(F.count("*").alias("n")))
    return out.select("token", "df", F.round("idf", 6).alias("idf"), fn.token_hash(F.col("token")).alias("hash"))


@query(POSTED + " SELECT query_id, pair_id, score, nth FROM sparse")
def sparse_topk(spark, d):
    return _sparse(spark, d)


NEAREST = """WITH co AS (SELECT q.vec_id::BIGINT AS query_id, e.vec_id::BIGINT AS pair_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pair_id) AS nth FROM co WHERE score >= {}) WHERE nth <= 20"""


@query(NEAREST.format(0.5))
def dense_topk(spark, d):
    return retrieve.dense_scores(*src.vectors(spark, d), 20, 0.5)


@query(NEAREST.format(-1.0))
def dense_cells(spark, d):
    """The nearest of all vectors, by cells with exact bounds."""
    return cells.dense_hits(*src.vectors(spark, d), 20)


@query(POSTED + " SELECT item_id::BIGINT AS query_id, (SELECT max(score) FROM co WHERE co.query_id = item_id) AS dense_top1, (SELECT count(*) FROM sparse WHERE sparse.query_id = item_id) AS sparse_hits FROM benchmark")
def recall_diag(spark, d):
    return retrieve.recall_diagnostics(src.benchmark_queries(spark, d), _dense(spark, d, -1.0), _sparse(spark, d))


@query(HYBRID + " SELECT query_id, pair_id, score FROM ff")
def rrf(spark, d):
    return retrieve.fused([_dense(spark, d), _sparse(spark, d)])


@query(HYBRID + " SELECT * FROM hits")
def hybrid_search(spark, d):
    return retrieve.hybrid_search(_dense(spark, d), _sparse(spark, d), _texts(spark, d)[0])


@query(HYBRID + """, mu AS (SELECT query_id // 4 AS unit_id, source, target, first(status ORDER BY score DESC, pair_id) AS status, max(score) AS score FROM hits GROUP BY ALL)
SELECT unit_id, source, target, status, score, nth FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, source, target) AS nth FROM mu) WHERE nth <= 4""")
def unit_refs(spark, d):
    members = src.benchmark_queries(spark, d).select(F.expr("query_id div 4").alias("unit_id"), "query_id")
    return retrieve.unit_references(members, retrieve.hybrid_search(_dense(spark, d), _sparse(spark, d), _texts(spark, d)[0]), 2)


@query("""WITH s AS (SELECT c_custkey::BIGINT AS query_id, c_custkey % 2 AS term_count, c_nationkey % 3 AS sparse_hits, CASE WHEN c_nationkey % 5 > 0 THEN abs(c_acctbal) / 10000 END AS dense_top1 FROM customer)
SELECT *, term_count = 0 AND sparse_hits = 0 AND coalesce(dense_top1, 0) < 0.5 AS weak FROM s""")
def weak_recall(spark, d):
    top1 = F.when(F.col("c_nationkey") % 5 > 0, F.abs("c_acctbal") / 10000)
    rows = src.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("query_id"), (F.col("c_custkey") % 2).alias("term_count"), (F.col("c_nationkey") % 3).alias("sparse_hits"), top1.alias("dense_top1"))
    return retrieve.weak_recall(rows, 0.5)


# --- templates ----------------------------------------------------------------------------------------------------

NAMES = """WITH RECURSIVE t AS (SELECT DISTINCT p_brand || ' ' || p_type || ' ' || p_name AS text FROM part),
l AS (SELECT a.text AS x, b.text AS y, least(length(a.text), length(b.text)) AS s, greatest(length(a.text), length(b.text)) AS g FROM t a JOIN t b ON a.text < b.text WHERE least(length(a.text), length(b.text)) >= 0.8 * greatest(length(a.text), length(b.text))),
c AS (SELECT *, len(list_filter(range(1, s + 1), lambda i: left(x, i) = left(y, i))) AS p, len(list_filter(range(1, s + 1), lambda i: right(x, i) = right(y, i))) AS q FROM l),
k AS (SELECT x, y, (p + least(q, s - p)) / g::DOUBLE AS sim FROM c WHERE (p + least(q, s - p)) / g::DOUBLE >= 0.8 - 1e-9),
rep AS (SELECT p_brand || ' ' || p_type || ' ' || p_name AS text, min(p_partkey)::BIGINT AS id FROM part GROUP BY 1),
pairs AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, sim FROM k JOIN rep a ON k.x = a.text JOIN rep b ON k.y = b.text)"""


def _frames(spark, d):
    name = F.concat_ws(" ", "p_brand", "p_type", "p_name")
    return src.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("row_id"), name.alias("text"))


@query(NAMES + " SELECT a, b, round(sim, 6) AS similarity FROM pairs")
def affix_pairs(spark, d):
    distinct = _frames(spark, d).groupBy("text").agg(F.min("row_id").alias("row_id"))
    return cluster.affix_pairs(distinct, 0.8)


#: Components at the default threshold, by labels that pass along all linked pairs a fixed number of times.
CLOSED = """WITH RECURSIVE rep AS MATERIALIZED (SELECT p_brand || ' ' || p_type || ' ' || p_name AS text, min(p_partkey)::BIGINT AS id FROM part GROUP BY 1),
affix AS MATERIALIZED (SELECT id, length(text) AS n, i, left(text, i) AS k, 0 AS side FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM rep)
  UNION ALL SELECT id, length(text), i, right(text, i), 1 FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM rep)),
both_ AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM affix a JOIN affix b ON a.k = b.k AND a.i = b.i AND a.side = b.side AND a.id <> b.id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM both_ WHERE least(c, na, nb) / greatest(na, nb)::DOUBLE >= 0.4 - 1e-9),
l0 AS (SELECT id, id AS l FROM rep),
""" + "".join(f"l{i} AS MATERIALIZED (SELECT o.id, least(any_value(o.l), coalesce(min(p.l), any_value(o.l))) AS l FROM l{i - 1} o LEFT JOIN e ON e.a = o.id LEFT JOIN l{i - 1} p ON p.id = e.b GROUP BY o.id),\n" for i in range(1, 11)) + """comp AS (SELECT id, l AS component FROM l10),
placed AS (SELECT p_partkey::BIGINT AS row_id, text, component FROM (SELECT *, p_brand || ' ' || p_type || ' ' || p_name AS text FROM part) JOIN rep USING (text) JOIN comp USING (id)),
shape AS (SELECT component, count(*) AS m, min(text) AS lo, max(text) AS hi, min(reverse(text)) AS rlo, max(reverse(text)) AS rhi, min(length(text)) AS s, max(length(text)) AS g FROM placed GROUP BY component),
cut AS (SELECT *, len(list_filter(range(1, s + 1), lambda i: left(lo, i) = left(hi, i))) AS p, len(list_filter(range(1, s + 1), lambda i: left(rlo, i) = left(rhi, i))) AS q0 FROM shape),
final AS (SELECT component, m, lo, rlo, p, least(q0, s - p) AS q, m > 1 AND (p + least(q0, s - p)) / g::DOUBLE >= 0.5 - 1e-9 AS is_grouped FROM cut)"""


@query(CLOSED + " SELECT row_id, component FROM placed")
def template_components(spark, d):
    return cluster.template_components(_frames(spark, d), 0.4).select("row_id", "component")


@query(CLOSED + """ SELECT row_id, component, is_grouped, CASE WHEN is_grouped THEN ((row_number() OVER (PARTITION BY component ORDER BY row_id) - 1) // 10)::INT END AS slice_no,
CASE WHEN is_grouped AND p + q > 0 THEN left(lo, p) || '…' || reverse(left(rlo, q)) ELSE '' END AS template FROM placed JOIN final USING (component)""")
def template_groups(spark, d):
    return cluster.template_groups(_frames(spark, d), 0.4, 0.5)


@query("""WITH s AS (SELECT length(min(s_name)) AS n, min(s_name) AS lo, max(s_name) AS hi, min(reverse(s_name)) AS rlo, max(reverse(s_name)) AS rhi, min(s_suppkey)::BIGINT AS component FROM supplier),
c AS (SELECT *, len(list_filter(range(1, n + 1), lambda i: left(lo, i) = left(hi, i))) AS p, len(list_filter(range(1, n + 1), lambda i: left(rlo, i) = left(rhi, i))) AS q FROM s)
SELECT s_suppkey::BIGINT AS row_id, component, true AS is_grouped, ((row_number() OVER (ORDER BY s_suppkey) - 1) // 10)::INT AS slice_no, left(lo, p) || '…' || reverse(left(rlo, least(q, n - p))) AS template FROM supplier, c""")
def supplier_templates(spark, d):
    s = src.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("row_id"), F.col("s_name").alias("text"))
    return cluster.template_groups(s, 0.4, 0.5)


@query("""WITH g AS (SELECT s_suppkey::BIGINT AS id, list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3))) AS gs FROM (SELECT s_suppkey, md5(s_name) || md5(s_suppkey::VARCHAR) AS n FROM supplier)),
p AS (SELECT a.id AS query_id, b.id AS row_id, len(list_intersect(a.gs, b.gs)) / len(list_distinct(list_concat(a.gs, b.gs)))::DOUBLE AS s FROM g a JOIN g b ON a.id % 20 = 0 AND a.id <> b.id)
SELECT query_id, row_id, round(s, 6) AS similarity FROM p WHERE s >= 0.02""")
def ngram_jaccard(spark, d):
    name = F.concat(F.md5(F.col("s_name").cast("binary")), F.md5(F.col("s_suppkey").cast("string").cast("binary")))
    rows = src.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("row_id"), name.alias("text"))
    return cluster.similar_by_grams(rows.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id"), rows, 3, 0.02)


@query("""WITH w AS (SELECT DISTINCT doc_id::BIGINT AS id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS token FROM documents),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
c AS (SELECT a.id AS query_id, b.id AS row_id, count(*) AS c FROM w a JOIN w b ON a.token = b.token AND a.id % 20 = 0 AND a.id <> b.id GROUP BY ALL)
SELECT query_id, row_id, round(c / (x.n + y.n - c)::DOUBLE, 6) AS similarity FROM c JOIN n x ON x.id = query_id JOIN n y ON y.id = row_id WHERE c / (x.n + y.n - c)::DOUBLE >= 0.5""")
def similar_documents(spark, d):
    """Documents whose sets of words resemble that of a stated one."""
    items = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[0-9a-z]+"), F.lit(0)))
    rows = src.table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("row_id"), items.alias("items"))
    return cluster.similar_sets(rows.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id"), rows, 0.5)


# --- outputs, rendering, enrichment -------------------------------------------------------------------------------


@query("""SELECT conv_id::BIGINT * 1000 + turn AS row_id, CASE conv_id % 4 WHEN 0 THEN role WHEN 1 THEN 'a' WHEN 2 THEN role || ' said' ELSE '{"other": 1}' END AS translation,
CASE conv_id % 4 WHEN 0 THEN 'r' || turn WHEN 1 THEN 'it "is" so' END AS reason FROM conversations""")
def parse_single(spark, d):
    exact = F.to_json(F.struct(F.col("role").alias("translation"), F.concat(F.lit(" r"), F.col("turn")).alias("reason")))
    raw = F.when(F.col("conv_id") % 4 == 0, exact).when(F.col("conv_id") % 4 == 1, '{"translation": "a", "reason": "it "is" so"\n}').when(F.col("conv_id") % 4 == 2, F.concat(F.lit(" "), "role", F.lit(" said\n"))).otherwise('{"other": 1}')
    rows = src.table(spark, d, "conversations").select((F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("unit_id"), raw.alias("raw"))
    return infer.parse_single(rows).withColumnRenamed("unit_id", "row_id")


@query(f"""WITH {src.OUTPUTS_SQL}, f AS (SELECT unit_id, number, expected, first(translation ORDER BY nth) AS translation, first(reason ORDER BY nth) AS reason FROM counted GROUP BY ALL),
n AS (SELECT *, count(*) OVER w AS n, min(number) OVER w AS lo, max(number) OVER w AS hi FROM f WINDOW w AS (PARTITION BY unit_id))
SELECT unit_id, number::INT AS pos, translation, reason FROM n WHERE n = expected AND lo = 1 AND hi = expected""")
def parse_numbered(spark, d):
    return infer.parse_numbered(src.unit_outputs(spark, d))


@query(f"WITH {src.OUTPUTS_SQL} SELECT unit_id, nth::INT AS pos, translation, reason FROM counted")
def parse_positional(spark, d):
    return infer.parse_positional(src.unit_outputs(spark, d))


@query(f"""WITH {src.DIALOGS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY dialog_id ORDER BY time NULLS FIRST, row_id) AS nth FROM members WHERE kind = 'dialog')
SELECT dialog_id, md5('## Dialog' || chr(10) || chr(10) || string_agg(nth || '. [' || speaker || '] ' || source, chr(10) ORDER BY nth)) AS message FROM o GROUP BY dialog_id""")
def render_dialogs(spark, d):
    rows = units.dialog_members(src.dialogs(spark, d)).where("kind = 'dialog'").groupBy("dialog_id")
    turns = F.array_sort(F.collect_list(F.struct("pos", "source", "speaker")))
    body = render.message([("## Terms", F.lit("")), ("## Dialog", render.dialog_lines(F.col("turns")))])
    return rows.agg(turns.alias("turns")).select("dialog_id", F.md5(body.cast("binary")).alias("message"))


@query(f"""WITH {TM}, b AS (SELECT source, target, min(rank) AS rank, first(status ORDER BY rank) AS status FROM tm GROUP BY source, target),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, target) AS nth FROM b), r AS (SELECT * FROM n WHERE nth <= 3)
SELECT source AS unit_id, '## References' || chr(10) || chr(10) || string_agg(nth || '. [score=' || printf('%.3f', 1.0 / nth) || '] 「' || source || '」 → "' || target || '"', chr(10) ORDER BY nth) ||
chr(10) || chr(10) || '## Source' || chr(10) || chr(10) || '1. ' || source AS message FROM r GROUP BY source""")
def render_units(spark, d):
    best = memory.exact_matches(src.memory(spark, d).select("source").distinct(), src.memory(spark, d), 3)
    refs = F.transform(F.array_sort(F.collect_list(F.struct("nth", "target", "status"))), lambda r: r)
    rows = best.groupBy("source").agg(refs.alias("refs"))
    views = F.transform("refs", lambda r: F.struct(F.col("source").alias("source"), r["target"].alias("target"), (F.lit(1.0) / r["nth"]).alias("score"), r["status"].alias("status")))
    rows = rows.select("source", views.alias("refs"))
    body = render.message([("## References", render.reference_lines(F.col("refs"))), ("## Source", render.numbered_lines(F.array("source")))])
    return rows.select(F.col("source").alias("unit_id"), body.alias("message"))


@query("""SELECT page_id::VARCHAR AS key, i::INT AS pos, trim(url) AS title, left(trim(CASE WHEN page_id % 3 = 0 AND html <> '' THEN html ELSE md5(html) END), 300) AS snippet, trim(url) AS url, 'site' AS site_name,
CASE WHEN i = 0 AND page_id % 4 = 0 THEN url || '/a.png' END AS image_url FROM pages, (SELECT unnest([0, 1, 2]) AS i) WHERE page_id % 10 <> 9""")
def web_parse(spark, d):
    return enrich.parsed_responses(src.search_responses(spark, d))


@query(r"""WITH q AS (SELECT p_partkey::BIGINT AS row_id, md5(lower('game ' || p_name)) AS key FROM part), c AS (SELECT DISTINCT md5(lower('game ' || p_name)) AS key FROM part WHERE p_size < 3)
SELECT row_id, key, key IN (SELECT key FROM c) AS hit FROM q""")
def cache_split(spark, d):
    part = src.table(spark, d, "part")
    asked = part.select(F.col("p_partkey").cast("long").alias("row_id"), F.concat(F.lit("  "), F.upper("p_name"), F.lit(" \n")).alias("query"))
    cache = part.where("p_size < 3").select(fn.cache_key(F.col("p_name"), F.lit("Game")).alias("key"), F.lit("[]").alias("results"))
    return enrich.cache_split(asked, cache, F.lit("Game")).select("row_id", "key", "hit")


@query("""SELECT p_partkey::BIGINT AS row_id, CASE p_size % 5 WHEN 0 THEN '任务' WHEN 1 THEN '外观' WHEN 2 THEN 'UI文本' WHEN 3 THEN '未知' END AS kind,
CASE p_size % 5 WHEN 0 THEN 'functional' WHEN 2 THEN 'functional' ELSE 'other' END AS class FROM part""")
def content_types(spark, d):
    hint = F.expr("CASE p_size % 5 WHEN 0 THEN ' 任务 ' WHEN 1 THEN '外观描述X' WHEN 2 THEN 'some UI文本' WHEN 3 THEN '未知' ELSE p_name END")
    rows = src.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("row_id"), fn.content_type(hint).alias("kind"))
    return rows.withColumn("class", fn.rule_class(F.col("kind")))


@query("""WITH p AS (SELECT c_name AS project_id, CASE c_custkey % 4 WHEN 0 THEN 'zh-en' WHEN 1 THEN 'ZH_CN>fr' WHEN 2 THEN 'ja/KO' ELSE 'zh' END AS lp FROM customer)
SELECT project_id, CASE lp WHEN 'zh-en' THEN 'Chinese' WHEN 'ZH_CN>fr' THEN 'Chinese' WHEN 'ja/KO' THEN 'Japanese' END AS source_name, CASE lp WHEN 'zh-en' THEN 'English' WHEN 'ZH_CN>fr' THEN 'French' WHEN 'ja/KO' THEN 'ko' END AS target_name FROM p""")
def language_pairs(spark, d):
    pair = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'zh-en' WHEN 1 THEN 'ZH_CN>fr' WHEN 2 THEN 'ja/KO' ELSE 'zh' END")
    first, last = fn.language_codes(pair)
    return src.table(spark, d, "customer").select(F.col("c_name").alias("project_id"), fn.language_name(first).alias("source_name"), fn.language_name(last).alias("target_name"))


def _guides(spark, d):
    """A guide for every supplier; each third has no part by types, and the rules differ."""
    by_type = F.concat(F.lit("\n# Rules by type\n## **一、** **任务**\nlines of "), F.md5(F.col("s_name").cast("binary")), F.lit("\n## **二、** **角色 / 人物**\nkeep "), "s_name", F.lit("\n"))
    text = F.concat(F.lit("General rules of "), "s_name", F.when(F.col("s_suppkey") % 3 != 0, by_type).otherwise(""))
    return src.table(spark, d, "supplier").select(F.col("s_name").alias("project_id"), text.alias("text"))


# Fixed value: the heading line of a content type's rules in a guide.
HEADING = r"(?m)^#+\s+\*\*[一二三四五六七八九十]+、\*\*\s+\*\*[^*\n]+\*\*"
RULES = """WITH g AS (SELECT s_suppkey, s_name AS project_id, 'General rules of ' || s_name AS general, '## **一、** **任务**' || chr(10) || 'lines of ' || md5(s_name) AS one,
'## **二、** **角色 / 人物**' || chr(10) || 'keep ' || s_name AS two FROM supplier)"""


@query(RULES + """ SELECT project_id, NULL AS content_type, general AS rules FROM g UNION ALL SELECT project_id, '任务', one FROM g WHERE s_suppkey % 3 <> 0
UNION ALL SELECT project_id, '角色/人物', two FROM g WHERE s_suppkey % 3 <> 0""")
def style_sections(spark, d):
    return render.style_rules(_guides(spark, d), "Rules by type", HEADING)


@query(RULES + """, u AS (SELECT l_orderkey::BIGINT * 10 + l_linenumber AS unit_id, CASE WHEN l_linenumber = 7 THEN 'none' ELSE s_name END AS project_id,
CASE l_linenumber % 4 WHEN 0 THEN '任务' WHEN 1 THEN '剧情' WHEN 2 THEN '角色/人物' END AS content_type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
w AS (SELECT *, general || CASE WHEN s_suppkey % 3 <> 0 THEN chr(10) || '# Rules by type' || chr(10) || one || chr(10) || two || chr(10) ELSE '' END AS guide FROM g)
SELECT unit_id, project_id, content_type, md5(CASE WHEN s_suppkey % 3 <> 0 AND content_type = '任务' THEN general || chr(10) || chr(10) || one
WHEN s_suppkey % 3 <> 0 AND content_type = '角色/人物' THEN general || chr(10) || chr(10) || two ELSE guide END) AS style FROM u LEFT JOIN w USING (project_id)""")
def style_lookup(spark, d):
    guides = _guides(spark, d)
    lines = src.table(spark, d, "lineitem").join(src.table(spark, d, "supplier").select("s_suppkey", "s_name").hint("shuffle_hash"), F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.expr("CASE l_linenumber % 4 WHEN 0 THEN '任务' WHEN 1 THEN '剧情' WHEN 2 THEN '角色/人物' END")
    asked = lines.select(
        (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("unit_id"), F.when(F.col("l_linenumber") == 7, "none").otherwise(F.col("s_name")).alias("project_id"), kind.alias("content_type")
    )
    out = render.style_for_units(asked, render.style_rules(guides, "Rules by type", HEADING), guides)
    return out.select("unit_id", "project_id", "content_type", F.md5(F.col("style").cast("binary")).alias("style"))


@query("""WITH p AS (SELECT s_name AS project_id, 'c' || s_nationkey AS collection FROM supplier), r AS (SELECT o_orderkey::BIGINT AS row_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'Supplier#' || lpad((1 + o_orderkey % 150)::VARCHAR, 9, '0') END AS project_id,
CASE o_orderkey % 4 WHEN 0 THEN 'own' WHEN 1 THEN ' ' END AS asked FROM orders)
SELECT row_id, r.project_id, coalesce(nullif(trim(asked), ''), p.collection, 'main') AS collection, p.project_id IS NOT NULL AS known_project FROM r LEFT JOIN p USING (project_id)""")
def project_scope(spark, d):
    known = src.table(spark, d, "supplier").select(F.col("s_name").alias("project_id"), F.concat(F.lit("c"), "s_nationkey").alias("collection"))
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("o_orderkey") % 150 + 1).cast("string"), 9, "0"))
    asked = src.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("long").alias("row_id"), F.when(F.col("o_orderkey") % 11 != 0, name).alias("project_id"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'own' WHEN 1 THEN ' ' END").alias("collection")
    )
    return projects.scoped(asked, known, "main")


@query("""WITH t AS (SELECT p_brand AS project_id, p_name AS source, min(p_type) AS target FROM part GROUP BY ALL)
SELECT p_partkey::BIGINT AS row_id, r.project_id, r.source, t.target AS term_target FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS project_id, p_name AS source FROM part) r LEFT JOIN t USING (project_id, source)""")
def project_terms(spark, d):
    part = src.table(spark, d, "part")
    terms = part.groupBy(F.col("p_brand").alias("project_id"), F.col("p_name").alias("source")).agg(F.min("p_type").alias("target"))
    asked = part.select(F.col("p_partkey").cast("long").alias("row_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("project_id"), F.col("p_name").alias("source"))
    return projects.scoped_terms(asked, terms)


@query("SELECT doc_id::BIGINT AS project_id, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines, md5(left(text, 500)) AS preview FROM documents")
def style_info(spark, d):
    docs = src.table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("project_id"), "text")
    return render.style_info(docs).withColumn("preview", F.md5(F.col("preview").cast("binary")))


@query("""WITH i AS (SELECT 'c' || (p_partkey % 5) AS collection FROM part) SELECT s_name AS project_id, 'c' || s_nationkey AS collection, (SELECT count(*) FROM i WHERE i.collection = 'c' || s_nationkey) AS points,
(SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_suppkey = s_suppkey) AS terms, CASE WHEN s_suppkey % 2 = 0 THEN length(s_name) + 32 ELSE 0 END AS guide_chars FROM supplier""")
def project_inventory(spark, d):
    points = src.table(spark, d, "part").select(F.concat(F.lit("c"), F.col("p_partkey") % 5).alias("collection"))
    s = src.table(spark, d, "supplier")
    named = s.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("project_id"), F.concat(F.lit("c"), "s_nationkey").alias("collection"))
    terms = src.table(spark, d, "lineitem").join(named.hint("merge"), "l_suppkey").select("project_id", F.col("l_returnflag").alias("source"))
    guides = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("project_id"), F.concat("s_name", F.md5(F.col("s_name").cast("binary"))).alias("text"))
    return projects.inventory(named.select("project_id", "collection"), points, terms, guides)


@query("SELECT event_id::BIGINT AS row_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value::DOUBLE END AS time FROM events")
def lenient_time(spark, d):
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("t="), F.col("value").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return src.table(spark, d, "events").select(F.col("event_id").cast("long").alias("row_id"), fn.lenient_double(said).alias("time"))


@query("SELECT conv_id::BIGINT * 1000 + turn AS row_id, coalesce(text, '') AS source, role AS speaker FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def alias_scan(spark, d):
    c = src.table(spark, d, "conversations").select((F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias(" 原文 "), F.col("role").alias("Speaker"))
    found = files.resolve(c, files.TEXT_ALIASES, ["source"])
    return found.where("source <> ''").select("row_id", "source", "speaker")


@query(f"""WITH {TM}, s AS (SELECT p_partkey::BIGINT AS row_id, p_name AS source FROM part), b AS (SELECT source, target, min(rank) AS rank FROM tm GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, target) AS nth FROM b)
SELECT s.source AS \"{chr(0xFEFF)}source\", n.target AS translation, '' AS reason, 'true' AS tm_exact FROM s JOIN n ON s.source = n.source AND nth = 1""")
def export_csv(spark, d):
    rows = memory.exact_matches(src.segments(spark, d), src.memory(spark, d))
    rows = rows.select("row_id", "source", F.col("target").alias("translation"), F.lit(None).cast("string").alias("reason"), F.col("is_exact").alias("tm_exact"))
    return sinks.export_columns(rows, ["source", "translation", "reason", "tm_exact"])


@query(f"""WITH {TM}, s AS (SELECT p_partkey::BIGINT AS row_id, p_name AS source, p_size FROM part), b AS (SELECT source, target, min(rank) AS rank, first(status ORDER BY rank) AS status FROM tm GROUP BY source, target),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, target) AS nth FROM b)
SELECT s.source AS "{chr(0xFEFF)}source", CASE WHEN p_size % 4 = 3 THEN '' ELSE n.target END AS translation, CASE WHEN p_size % 4 = 1 THEN 'why "' || s.source || '"' ELSE '' END AS translation_reason,
CASE WHEN p_size % 4 = 3 THEN 'error' ELSE 'success' END AS status, CASE WHEN p_size % 3 = 0 THEN '任务' ELSE '' END AS content_type,
CASE WHEN p_size % 2 = 0 THEN '[{{"source":"' || s.source || '","target":"' || n.target || '"}}]' ELSE '' END AS terminology_used, '' AS rag_references, CASE WHEN p_size % 4 = 0 THEN 'true' ELSE 'false' END AS tm_exact_match_used,
CASE WHEN p_size % 4 = 0 THEN s.source ELSE '' END AS tm_exact_match_source, CASE WHEN p_size % 4 = 0 THEN n.target ELSE '' END AS tm_exact_match_target, CASE WHEN p_size % 4 = 0 THEN coalesce(n.status, '') ELSE '' END AS tm_exact_match_status,
CASE WHEN p_size % 4 = 0 THEN '1.0' ELSE '' END AS tm_exact_match_score, '' AS web_references, CASE p_size % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'true' ELSE '' END AS web_search_triggered, '' AS image_analysis,
CASE WHEN p_size % 4 = 3 THEN 'no answer' ELSE '' END AS error_msg FROM s JOIN n ON s.source = n.source AND nth = 1""")
def export_results(spark, d):
    size = src.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("row_id"), "p_size")
    rows = memory.exact_matches(src.segments(spark, d), src.memory(spark, d)).drop("content_type").join(size.hint("merge"), "row_id")
    kind, exact = F.col("p_size") % 4, F.col("p_size") % 4 == 0
    term = F.struct("source", "target")
    return sinks.result_cells(rows.select(
        "source", F.when(kind != 3, F.col("target")).alias("translation"), F.when(kind == 1, F.concat(F.lit('why "'), "source", F.lit('"'))).alias("translation_reason"),
        F.when(kind == 3, "error").otherwise("success").alias("status"), F.when(F.col("p_size") % 3 == 0, "任务").alias("content_type"),
        F.when(F.col("p_size") % 2 == 0, F.array(term)).otherwise(F.array().cast("array<struct<source:string,target:string>>")).alias("terminology_used"), exact.alias("tm_exact_match_used"),
        F.when(exact, F.col("source")).alias("tm_exact_match_source"), F.when(exact, F.col("target")).alias("tm_exact_match_target"), F.when(exact, F.coalesce("status", F.lit(""))).alias("tm_exact_match_status"),
        F.when(exact, F.col("score")).alias("tm_exact_match_score"), F.when(F.col("p_size") % 3 == 0, False).when(F.col("p_size") % 3 == 1, True).alias("web_search_triggered"), F.when(kind == 3, "no answer").alias("error_msg"),
    ))


@query("""WITH w AS (SELECT page_id, url, md5(lower(trim(url))) AS key FROM pages), c AS (SELECT key FROM w WHERE page_id % 4 = 0)
SELECT key, url AS query, 'old' AS results, CASE WHEN page_id % 8 = 0 THEN 0 ELSE 1 END AS version, '2020-01-01 00:00:00' AS cached_at FROM w WHERE page_id % 4 = 0
UNION ALL SELECT key, url, 'new ' || page_id, 1, '2024-05-06 07:08:09' FROM w WHERE page_id % 4 = 1 AND key NOT IN (SELECT key FROM c)""")
def cache_write(spark, d):
    pages = src.table(spark, d, "pages").select("page_id", fn.cache_key(F.col("url")).alias("key"), F.col("url").alias("query"))
    old = F.lit("2020-01-01 00:00:00").cast("timestamp")
    stored = pages.where("page_id % 4 = 0").select("key", "query", F.lit("old").alias("results"), F.when(F.col("page_id") % 8 == 0, 0).otherwise(1).alias("version"), old.alias("cached_at"))
    body = F.when(F.col("page_id") % 4 != 3, F.concat(F.lit("new "), F.col("page_id")))
    fetched = pages.where("page_id % 4 <> 2").select("key", "query", body.alias("body"))
    out = enrich.cache_with(stored, fetched, F.lit("2024-05-06 07:08:09").cast("timestamp"))
    return out.withColumn("cached_at", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss"))
