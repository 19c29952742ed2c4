"""Token postings, segmentation and collection statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmengine.functions.text import tokens
from tmengine.operators import glossary
from tmengine.tables import BROADCAST_ROWS, written

_PIECES = re.compile("([0-9A-Za-z]+)|([\u4e00-\u9fff]+)")
_WORD, _HAN = re.compile("[0-9a-z]+"), re.compile("[\u4e00-\u9fff]+")
#: Texts of one block of the posting list.
BLOCK = 128


def postings(texts: DataFrame, id_column: str, text: str = "text", cut: Callable[[Column], Column] = tokens) -> DataFrame:
    """``(id, token, tf, n)``: how often each token occurs in each text, and the text's number of tokens.

    ``cut`` makes the tokens of the column ``text``; for texts that have been cut (``segmented``) it is the column itself.
    """
    each = texts.select(id_column, cut(F.col(text)).alias("_tokens"))
    each = each.select(id_column, F.size("_tokens").alias("n"), F.explode("_tokens").alias("token"))
    return each.groupBy(id_column, "token").agg(F.count("*").alias("tf"), F.max("n").alias("n"))


def _token_counts(lowered: pa.Array) -> pa.Array:
    """Each text's number of tokens (``functions.text.tokens``) and how often each occurs."""
    sizes, ends, names, tfs = [], [0], [], []
    for text in lowered.to_pylist():
        found = Counter(_WORD.findall(text) if text else ())
        if text and not text.isascii():
            for run in _HAN.findall(text):
                found.update([run] if len(run) == 1 else map("".join, zip(run, run[1:])))
        names += found.keys()
        tfs += found.values()
        ends.append(len(names))
        sizes.append(found.total())
    pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(tfs, pa.int64())], names=["token", "tf"])
    counts = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pairs)
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), counts], names=["n", "counts"])


def counted(texts: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """``(id, n, counts)``: the postings of a text as one row, ``counts`` being (token, tf); no token meets a shuffle.

    Rows of a repeated id are one text, as in ``postings``: such ids are looked for first, and only their tokens are added up.
    """
    cut = F.arrow_udf(_token_counts, "struct<n:int,counts:array<struct<token:string,tf:bigint>>>")
    each = texts.select(id_column, cut(F.lower(F.col(text))).alias("_made")).select(id_column, "_made.n", "_made.counts")
    again = written(texts.groupBy(F.col(id_column).alias("_again")).agg(F.count("*").alias("rows")).where("rows > 1").select("_again"))
    repeated = again.count()
    if not repeated:
        return each
    again = F.broadcast(again) if repeated <= BROADCAST_ROWS else again.hint("merge")
    same = F.col(id_column).eqNullSafe(F.col("_again"))
    rest = each.join(again, same, "left_semi").select(id_column, "n", F.inline("counts"))
    rest = rest.groupBy(id_column, "token").agg(F.sum("tf").alias("tf"), F.max("n").alias("n"))
    rest = rest.groupBy(id_column).agg(F.max("n").alias("n"), F.collect_list(F.struct("token", "tf")).alias("counts"))
    return each.join(again, same, "left_anti").unionByName(rest)


def likeliest(run: str, words: dict[int, list[tuple[int, float]]], single: float) -> list[str]:
    """The words of the likeliest path through a run of characters; ``words`` are (length, log probability) by place, ties to the longer.

    A character that begins no word stands alone with probability ``single``.
    """
    best: list[tuple[float, int]] = [(0.0, 0)] * (len(run) + 1)
    for i in range(len(run) - 1, -1, -1):
        options = [(p + best[i + n][0], n) for n, p in words.get(i, ()) if i + n <= len(run)]
        if not any(n == 1 for _, n in options):
            options.append((single + best[i + 1][0], 1))
        best[i] = max(options)
    out, i = [], 0
    while i < len(run):
        out.append(run[i : i + best[i][1]])
        i += best[i][1]
    return out


def segmented(texts: DataFrame, dictionary: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``tokens``: runs of ASCII letters and digits in lower case, and Han runs cut into words of a dictionary ``(word, freq)``.

    The places of dictionary words in a text come from joins, so the dictionary may have any size; they are the word graph of its
    runs, and each run takes its likeliest path, a word's probability being its share of all frequencies. Words are taken as
    they stand, the higher frequency of a repeated one counts, those without one above 0 are left out.
    """
    words = dictionary.where("word is not null and word <> '' and freq > 0").groupBy("word").agg(F.max("freq").cast("double").alias("freq"))
    words = written(words)
    total = words.agg(F.sum("freq")).first()[0] or 1.0
    rows = written(texts.withColumn("_text", F.monotonically_increasing_id()))
    full = rows.select("_text", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body")).where("body <> ''")
    named = words.withColumnRenamed("word", "source")
    named = F.broadcast(named) if words.count() <= BROADCAST_ROWS else named.hint("merge")
    found = glossary.places(full, words.select(F.col("word").alias("source"))).join(named, "source")
    graph = found.groupBy("_text").agg(F.collect_list(F.struct("place", "source", "freq")).alias("graph"))

    @F.pandas_udf("array<string>")
    def cut(bodies: pd.Series, graphs: pd.Series) -> pd.Series:
        def one(said: str, edges) -> list[str]:
            at: dict[int, list] = {}
            for e in edges if edges is not None else ():
                if said.startswith(e["source"], e["place"]):
                    at.setdefault(e["place"], []).append((len(e["source"]), math.log(e["freq"] / total)))
            out = []
            for m in _PIECES.finditer(said):
                if m.group(1):
                    out.append(m.group(1).lower())
                else:
                    out += likeliest(m.group(2), {p - m.start(): w for p, w in at.items() if m.start() <= p < m.end()}, math.log(1 / total) if total > 1 else -1.0)
            return out

        return pd.Series([one(b, g) for b, g in zip(bodies, graphs)])

    listed = written(full.join(graph.hint("merge"), "_text", "left").select("_text", cut("body", "graph").alias("tokens")))
    out = rows.join(listed.hint("merge"), "_text", "left").drop("_text")
    return out.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def frequencies(posted: DataFrame) -> DataFrame:
    """``(token, df)``: in how many texts each token occurs."""
    return posted.groupBy("token").agg(F.count("*").alias("df"))


def changed_frequencies(kept: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Kept ``(token, df)`` after the postings of some texts went and those of others came; only these are counted."""
    rows = kept.select("token", "df").unionByName(frequencies(come)).unionByName(frequencies(gone).withColumn("df", -F.col("df")))
    return rows.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")


def inverse_frequencies(posted: DataFrame, n_texts: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """``(token, df, idf)`` with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); ``n_texts`` is one row (n).

    ``kept(token, df)`` are frequencies that loads have kept; without them the postings are counted.
    """
    df = frequencies(posted) if kept is None else kept.select("token", "df")
    n = F.col("n").cast("double")
    idf = F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(n_texts)).select("token", "df", idf.alias("idf"))  # one row against all


def blocked(posted: DataFrame) -> DataFrame:
    """Postings ``(pair_id, token, tf, n)``, n the tokens of the text, with the text's ``block`` and ``size``, the texts of a block.

    A block holds about ``BLOCK`` texts of similar length, a quarter of an octave apart at most, so a token's largest
    count in a block is near what its texts can have. Only the rough number of texts of each length class reaches the driver.
    """
    kind = F.floor(F.log2("n") * 4).cast("int")
    rows = posted.withColumn("class", kind)
    counts = rows.groupBy("class").agg(F.approx_count_distinct("pair_id").alias("texts")).collect()  # four classes an octave
    pieces = [(r["class"], max(1, -(-r["texts"] // BLOCK)), r["texts"]) for r in counts]
    table = F.broadcast(posted.sparkSession.createDataFrame(pieces or [(0, 1, 1)], "class int, pieces long, texts long"))
    block = F.col("class") * F.lit(1 << 40) + F.pmod(F.xxhash64("pair_id"), F.col("pieces"))
    return rows.join(table, "class").select("pair_id", "token", "tf", block.alias("block"), F.ceil(F.col("texts") / F.col("pieces")).alias("size"))
