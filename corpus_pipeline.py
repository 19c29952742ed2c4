"""Corpus pipeline: quality rules, quality classifier, SimHash near-dedup, PII pseudonyms, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmengine.llm import packing, pii, quality_classifier, quality_rules, simhash
from tmengine.llm.common import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their host's common lines.

    Null, empty and short texts go; repeated rows are judged each; a null source is a host of its own. Long texts
    are read whole. Of further columns of any name nothing is kept; an empty table gives no rows.
    """
    kept = quality_rules.quality_rules(docs).where("kept")
    changed = F.col("removed_words") > 0
    kept = kept.withColumn("n_chars", F.when(changed, F.length("clean_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.withColumn("text", F.col("clean_text")).select(*COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality.

    Scores are joined back by doc_id and text, so repeated ids are judged by their own text. Empty texts are
    scored like any other; null texts go. Repeated rows stay together; an empty table gives no rows.
    """
    keyed = docs.where(F.col("text").isNotNull()).withColumn("_body", F.xxhash64("text"))  # the hash of null is a number
    scores = quality_classifier.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("body", F.xxhash64("text")))
    wanted = scores.where("predicted = 1").select(F.col("doc_id").alias("_id"), F.col("body").alias("_body")).distinct()
    same = keyed["doc_id"].cast("long").eqNullSafe(wanted["_id"]) & (keyed["_body"] == wanted["_body"])
    return keyed.join(wanted.hint("merge"), same, "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id (none comes last) and of those the smallest text hash.

    Null and empty texts are one group. Two texts that share an id stay in their own groups; of equal rows one
    stays. An empty table gives no rows.
    """
    found = simhash.near_duplicates(docs)
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("_id"), F.col("best.body").alias("_best"))
    keyed = docs.withColumn("_body", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = keyed["doc_id"].cast("long").eqNullSafe(best["_id"]) & (keyed["_body"] == best["_best"])
    return keyed.join(best.hint("merge"), same).dropDuplicates(["_body"]).select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms under the session's key; null texts stay null, no row goes."""
    out = pii.pseudonymise(docs, pii.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of all documents; null and empty texts have 0 tokens, repeated rows are rows, no row goes."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("SimHash near-dedup", near_dedup),
    ("PII", private_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/stage-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
