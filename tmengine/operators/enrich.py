"""External references: response parsing, cache keys, hits and misses, enrichment of misses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmengine.functions.text import cache_key
from tmengine.operators.infer import called

RESPONSE = (
    "struct<data:struct<webPages:struct<value:array<struct<name:string,url:string,summary:string,snippet:string,siteName:string>>>,"
    "images:struct<value:array<struct<contentUrl:string,thumbnailUrl:string>>>>>"
)


def parsed_responses(responses: DataFrame, most: int = 3, snippet_chars: int = 300) -> DataFrame:
    """``(key, pos, title, snippet, url, site_name, image_url)``: the first pages; the top picture stands by the first one."""
    rows = responses.select("key", F.from_json("body", RESPONSE).alias("b"))
    picture = F.try_element_at(F.col("b.data.images.value"), F.lit(1))
    top = F.coalesce(F.when(picture["contentUrl"] != "", picture["contentUrl"]), F.when(picture["thumbnailUrl"] != "", picture["thumbnailUrl"]))
    rows = rows.select("key", top.alias("top"), F.posexplode(F.slice("b.data.webPages.value", 1, most)).alias("pos", "p"))
    said = F.trim(F.coalesce(F.when(F.col("p.summary") != "", F.col("p.summary")), "p.snippet", F.lit("")))
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return rows.select(
        "key", "pos", blank(F.col("p.name")).alias("title"), F.substring(said, 1, snippet_chars).alias("snippet"), blank(F.col("p.url")).alias("url"),
        F.when(F.col("p.siteName") != "", F.col("p.siteName")).alias("site_name"), F.when(F.col("pos") == 0, F.col("top")).alias("image_url"),
    )


def cache_split(queries: DataFrame, cache: DataFrame, prefix=None) -> DataFrame:
    """Queries with their ``key`` and ``hit``; a cache entry without results or of another version is a miss."""
    known = cache.where("results is not null")
    known = known.where(F.coalesce("version", F.lit(CACHE_VERSION)) == CACHE_VERSION) if "version" in cache.columns else known
    known = known.groupBy("key").agg(F.first("results").alias("results"))
    keyed = queries.withColumn("key", cache_key(F.col("query"), prefix))
    return keyed.join(known.hint("merge"), "key", "left").withColumn("hit", F.col("results").isNotNull())


def enriched(misses: DataFrame, fetch: Callable[[str], str | None], workers: int = 1, timeout: float | None = None) -> DataFrame:
    """``(key, query, body)``: the distinct misses fetched once each, ``workers`` at a time in a task; a lookup that fails or hangs gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = [body for body, _ in called(batch["query"].tolist(), fetch, workers, timeout, retries=0)]
            yield pd.DataFrame({"key": batch["key"], "query": batch["query"], "body": bodies})

    once = misses.groupBy("key").agg(F.min("query").alias("query"))
    return once.mapInPandas(run, "key string, query string, body string")


#: The layout of a cache entry; entries of another layout are misses.
CACHE_VERSION = 1
CACHE = "key string, query string, results string, version int, cached_at timestamp"


def cache_with(cache: DataFrame, fetched: DataFrame, now=None) -> DataFrame:
    """The cache with fetched results ``(key, query, body)`` whose key it does not hold yet, stamped with version and time."""
    new = fetched.where("body is not null").select("key", "query", F.col("body").alias("results"))
    new = new.join(cache.select("key").hint("merge"), "key", "left_anti")
    stamped = new.withColumn("version", F.lit(CACHE_VERSION)).withColumn("cached_at", F.current_timestamp() if now is None else now)
    return cache.unionByName(stamped, allowMissingColumns=True)
