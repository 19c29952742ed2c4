"""Engine inputs read from the given tables; every row of a table is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS_SQL = (
    "CASE p_partkey % 6 WHEN 0 THEN 'Designer Reviewed' WHEN 1 THEN 'CQA_Done' WHEN 2 THEN 'Done_LQA edited' "
    "WHEN 3 THEN 'Done' WHEN 4 THEN 'Draft' END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a translation memory: (row_id, source, target, status), with many duplicate pairs."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("long").alias("row_id"), F.col("p_name").alias("source"), F.concat_ws(" ", "p_brand", "p_type").alias("target"), F.expr(STATUS_SQL).alias("status")
    )


def stored_and_incoming(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The memory split into an index with point ids (every third row) and incoming rows (all others)."""
    tm = memory(spark, sf_dir)
    stored = tm.where("row_id % 3 = 0").withColumn("pair_id", F.concat(F.lit("point-"), F.lpad(F.col("row_id").cast("string"), 12, "0")))
    return stored, tm.where("row_id % 3 <> 0")


def glossary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and their single words as glossary rows, sources repeating."""
    part = table(spark, sf_dir, "part")
    names = part.select((F.col("p_partkey") * 3).cast("long").alias("row_id"), F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.col("p_type").alias("category"))
    word = F.posexplode(F.split("p_name", " "))
    words = part.select("p_partkey", "p_type", word.alias("i", "source"))
    words = words.select((F.col("p_partkey") * 3 + 1 + F.col("i")).cast("long").alias("row_id"), "source", F.upper("source").alias("target"), F.lit(None).cast("string").alias("category"))
    return names.unionByName(words)


GLOSSARY_SQL = """
entries AS (SELECT p_partkey::BIGINT * 3 AS row_id, p_name AS source, p_brand AS target, p_type AS category FROM part
  UNION ALL SELECT p_partkey::BIGINT * 3 + i, w, upper(w), NULL FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)),
terms AS (SELECT source, min(row_id) AS row_id, arg_min(target, row_id) AS target, first(category ORDER BY row_id) AS category, count(*) AS n_rows FROM entries GROUP BY source)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as segments to translate: names repeat, one third has no content type."""
    kind = "CASE p_size % 3 WHEN 0 THEN '任务' WHEN 1 THEN '剧情' END"
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("row_id"), F.col("p_name").alias("source"), F.expr(kind).alias("content_type"))


SEGMENTS_SQL = "segments AS (SELECT p_partkey::BIGINT AS row_id, p_name AS source, CASE p_size % 3 WHEN 0 THEN '任务' WHEN 1 THEN '剧情' END AS content_type FROM part)"


def dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as dialog rows: some ids blank or of one row, first turns without a time."""
    c = table(spark, sf_dir, "conversations")
    key = "CASE WHEN conv_id % 11 = 0 THEN ' ' WHEN conv_id % 7 = 0 THEN concat(conv_id, '/', turn) ELSE concat('c', conv_id) END"
    return c.select(
        (F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("source"), F.lit(None).cast("string").alias("content_type"),
        F.expr(key).alias("dialog_id"), F.col("role").alias("speaker"), F.expr("CASE WHEN turn > 0 THEN cast(turn as double) END").alias("time"),
    )


DIALOGS_SQL = """
dialogs AS (SELECT conv_id::BIGINT * 1000 + turn AS row_id, text AS source, role AS speaker, CASE WHEN turn > 0 THEN turn::DOUBLE END AS time,
  nullif(trim(CASE WHEN conv_id % 11 = 0 THEN ' ' WHEN conv_id % 7 = 0 THEN conv_id || '/' || turn ELSE 'c' || conv_id END), '') AS dialog_id FROM conversations),
members AS (SELECT *, CASE WHEN dialog_id IS NOT NULL AND count(*) OVER (PARTITION BY dialog_id) > 1 THEN 'dialog' ELSE 'single' END AS kind FROM dialogs)"""


def documents_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as an index: (pair_id, text, source, target, status)."""
    label = "CASE doc_id % 6 WHEN 0 THEN 'Designer Reviewed' WHEN 1 THEN 'CQA_Done' WHEN 2 THEN 'Done_LQA edited' WHEN 3 THEN 'Done' WHEN 4 THEN 'Draft' END"
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("pair_id"), "text", F.md5(F.col("text").cast("binary")).alias("source"), F.concat_ws("-", "lang", "source").alias("target"), F.expr(label).alias("status")
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query: (query_id, text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (ids divisible by 20) and the whole index of embeddings."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("pair_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return e.where("pair_id % 20 = 0").withColumnRenamed("pair_id", "query_id"), e


def unit_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered model output for every conversation: (unit_id, expected, raw), some broken in different ways."""
    c = table(spark, sf_dir, "conversations")
    number = F.when(F.col("conv_id") % 5 == 1, F.col("turn") + 101).when((F.col("conv_id") % 5 == 2) & (F.col("turn") == 1), F.lit(1)).otherwise(F.col("turn") + 1)
    body = F.when(F.col("conv_id") % 5 == 3, F.to_json(F.struct(F.col("role").alias("translation"), F.lit("why").alias("reason")))).otherwise(F.concat("role", F.lit(" "), F.md5(F.col("text").cast("binary"))))
    line = F.concat(number.cast("string"), F.when(F.col("turn") % 2 == 0, ". ").otherwise(") "), body)
    rows = c.groupBy("conv_id").agg(F.count("*").cast("int").alias("expected"), F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("ls"))
    return rows.select(F.col("conv_id").cast("string").alias("unit_id"), "expected", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("raw"))


OUTPUTS_SQL = r"""
lines AS (SELECT conv_id::VARCHAR AS unit_id, turn,
  CASE WHEN conv_id % 5 = 1 THEN turn + 101 WHEN conv_id % 5 = 2 AND turn = 1 THEN 1 ELSE turn + 1 END AS number,
  CASE WHEN conv_id % 5 = 3 THEN role ELSE role || ' ' || md5(text) END AS translation, CASE WHEN conv_id % 5 = 3 THEN 'why' END AS reason FROM conversations),
counted AS (SELECT *, count(*) OVER (PARTITION BY unit_id) AS expected, row_number() OVER (PARTITION BY unit_id ORDER BY turn) AS nth FROM lines)"""


def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search response for every page: the page twice and a picture for some."""
    p = table(spark, sf_dir, "pages")
    one = F.struct(F.col("url").alias("name"), "url", F.when(F.col("page_id") % 3 == 0, F.col("html")).alias("summary"), F.md5(F.col("html").cast("binary")).alias("snippet"), F.lit("site").alias("siteName"))
    pictures = F.when(F.col("page_id") % 4 == 0, F.array(F.struct(F.concat("url", F.lit("/a.png")).alias("contentUrl"), F.lit("t").alias("thumbnailUrl"))))
    body = F.struct(F.struct(F.struct(F.array(one, one, one, one).alias("value")).alias("webPages"), F.struct(pictures.alias("value")).alias("images")).alias("data"))
    return p.select(F.col("page_id").cast("string").alias("key"), F.when(F.col("page_id") % 10 == 9, F.lit("not json")).otherwise(F.to_json(body)).alias("body"))
