"""Project scope: each project has its own glossary, guide and collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scoped(requests: DataFrame, projects: DataFrame, default: str) -> DataFrame:
    """Requests ``(project_id, collection)`` with the collection to search and whether the project is known.

    A collection that the request names wins over the project's, and that over ``default``. A null or unknown
    project has the default; projects are one row a project_id.
    """
    of = projects.select("project_id", F.col("collection").alias("_own"), F.lit(True).alias("_known"))
    out = requests.join(of.hint("merge"), "project_id", "left")
    named = F.when(F.trim("collection") != "", F.col("collection"))
    return out.withColumn("collection", F.coalesce(named, "_own", F.lit(default))).withColumn("known_project", F.coalesce("_known", F.lit(False))).drop("_own", "_known")


def scoped_terms(requests: DataFrame, terms: DataFrame) -> DataFrame:
    """Requests ``(project_id, source)`` with ``term_target`` of their own project's glossary; other projects' terms are not seen."""
    own = terms.select("project_id", "source", F.col("target").alias("term_target"))
    return requests.join(own.hint("merge"), ["project_id", "source"], "left")


def inventory(projects: DataFrame, points: DataFrame, terms: DataFrame, guides: DataFrame) -> DataFrame:
    """Per project the points of its collection, the terms of its glossary and the characters of its guide, 0 for none."""
    n_points = points.groupBy("collection").agg(F.count("*").alias("points"))
    n_terms = terms.groupBy("project_id").agg(F.countDistinct("source").alias("terms"))
    size = guides.groupBy("project_id").agg(F.max(F.length("text")).alias("guide_chars"))
    out = projects.select("project_id", "collection").join(n_points.hint("merge"), "collection", "left")
    out = out.join(n_terms.hint("merge"), "project_id", "left").join(size.hint("merge"), "project_id", "left")
    return out.select("project_id", "collection", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("points", "terms", "guide_chars")])
