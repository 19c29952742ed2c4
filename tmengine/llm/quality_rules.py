"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmengine.llm.common import BROADCAST_ROWS, materialize

#: Split pattern between words; the complement of a word character.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def line_key(line: Column) -> Column:
    """64-bit hash of a line without case and with single spaces between its words."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, GAP, " "))))


def keyed_lines(text: Column) -> Column:
    """The lines of a text that hold a word, as structs of the line and its key."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return F.transform(lines, lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))


def frequent_lines(docs: DataFrame, share: float, least: int) -> DataFrame:
    """``(host, keys)``: lines found in more than max(least, share of the host's documents) distinct documents.

    Equal texts on a host count as one document, so a group of copies cannot make its own lines common.
    A text's lines are made distinct inside its row, then counted by (host, line) after a pre-aggregated
    distinct; nothing is gathered per host but the lines above the limit, at most 1/share times a
    document's mean number of lines.
    """
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.xxhash64("text").alias("body"),
        F.array_distinct(F.transform(keyed_lines(F.col("text")), lambda x: x["key"])).alias("keys"),
    )
    lines = rows.select("host", "body", F.explode("keys").alias("key"))
    counts = lines.distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > least)
    totals = rows.groupBy("host", "body").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("docs"))
    over = counts.join(totals.hint("merge"), "host").where(F.col("n") > F.col("docs") * share)
    return over.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it and wherever the plan moves it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def neighbours(values: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f(x, y)`` of each two neighbouring elements."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), f)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, given the array of a text's words.

    Windows are hashed to 64 bits and, if any occurs again, sorted with their positions; equal neighbours mark
    their positions, and the marked windows' union is summed from the gaps between sorted positions.
    """
    none = F.lit(0).cast("long")

    def windows(w: Column) -> Column:
        n = F.size(w) - 2
        first = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(first, F.slice(w, F.lit(3), n), lambda a, b: F.xxhash64(a, b))

    def marked(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = let(placed, lambda o: neighbours(o, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    def covered(m: Column) -> Column:
        gaps = neighbours(m, lambda a, b: F.least(F.lit(3), b - a))
        return F.aggregate(gaps, F.lit(3).cast("long"), lambda s, x: s + x)

    again = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(marked(h), covered))
    return F.when(F.size(words) < 3, none).otherwise(let(windows(words), again))


def counts(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text that is not null."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("again")))
    return let(
        of_words,
        lambda w: F.struct(
            w["n"].alias("n_words"), F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), w["again"].alias("n_repeat_words"),
        ),
    )


def without_lines(text: Column, common: Column) -> Column:
    """struct(_lost, _left): words in the lines whose key is in ``common``, and the text without those lines."""

    def kept(lines: Column) -> Column:
        lost = F.aggregate(F.filter(lines, lambda x: x["cut"]), F.lit(0).cast("long"), lambda s, x: s + F.regexp_count(x["line"], F.lit(WORD)))
        left = F.array_join(F.transform(F.filter(lines, lambda x: ~x["cut"]), lambda x: x["line"]), "\n")
        return F.struct(lost.alias("_lost"), left.alias("_left"))

    return let(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), (F.array_contains(common, line_key(x)) & x.rlike(WORD)).alias("cut"))), kept)


def quality_rules(docs: DataFrame, share: float = 0.08, least: int = 5, min_left: float = 0.5) -> DataFrame:
    """Add the counts, base_failed, removed_words, clean_text and kept to every row of ``docs``.

    base_failed: under 50 words, or over half the words in repeated 3-word windows. A line found in more than
    ``max(least, share * documents)`` distinct documents of its host (column source) is removed from
    clean_text; a document that keeps under ``min_left`` of its words is depleted. kept: neither. Null or
    empty text: no words, so base_failed; null source: the host ''; null doc_id, ties and repeated rows: each
    row judged alone; an empty table gives no rows; other columns pass through unless they carry a result's
    name, in which case the result replaces them.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "clean_text", "kept"]
    plain = docs.drop(*made)
    common = materialize(frequent_lines(plain, share, least))
    rows = plain.withColumn("_text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("_host", F.coalesce(F.col("source").cast("string"), F.lit("")))
    size = common.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first()["n"]
    hosts = common.select(F.col("host").alias("_host"), F.col("keys").alias("_common"))
    if size <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(hosts), "_host", "left")
    else:  # each host's few lines on every salt, so that a large host is spread
        salts = 64
        spread = hosts.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(salts)).cast("int"))
        rows = rows.join(spread.hint("merge"), ["_host", "_salt"], "left").drop("_salt")
    # generated columns: a filter on them is not moved below, where it would compute them once for each mention
    cut = F.when(F.col("_common").isNotNull(), without_lines(F.col("_text"), F.col("_common")))
    rows = rows.select("*", F.inline(F.array(counts(F.col("_text"))))).select("*", F.inline(F.array(cut)))
    rows = rows.withColumn("removed_words", F.coalesce("_lost", F.lit(0)).cast("long"))
    rows = rows.withColumn("clean_text", F.when(F.col("removed_words") > 0, F.col("_left")).otherwise(F.col("text")))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = rows.withColumn("base_failed", failed)
    depleted = (F.col("n_words") - F.col("removed_words")) < F.col("n_words") * min_left
    return rows.withColumn("kept", ~failed & ~depleted).drop("_text", "_host", "_common", "_lost", "_left")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


#: ``op6_quality_rules`` in DuckDB over the same table.
OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
t AS (SELECT r, i, [words[i], words[i + 1], words[i + 2]] AS tri FROM g),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM t) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
l AS (SELECT r, host, text, x AS line, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS k,
      len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
      FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
h AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
f AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT text) AS n FROM l GROUP BY host, k) JOIN h USING (host) WHERE n > 5 AND n > docs * 0.08),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
gone AS (SELECT r, sum(n)::BIGINT AS removed_words FROM l JOIN f USING (host, k) GROUP BY r),
b AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= n_words * 0.5 AS kept, removed_words
FROM b
"""
