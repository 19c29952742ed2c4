"""Source divergence audit by in-mapper stripes.

A task folds whole documents into stripes, one for each language and term: the number of documents with the term
and its count in each source. A table of stripes that grows past its bound is spilled as rows and begun anew. Rows are
partitioned and sorted by key, and a task merges neighbouring rows into one stripe; terms in too few documents go.
Merged stripes are then dealt by language into pieces of bounded size, beside each piece the totals of all its language's
sources, and a piece gives at once its share of every pair's divergence and its best terms.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmengine.llm.common import LOWER_AZ, materialize, partitions_for, salted, texts

#: Source counts that a task's stripes may hold before they are spilled, and those of one piece of merged stripes.
SPILL_CELLS, PIECE_CELLS = 1_000_000, 100_000
#: Terms of documents that wait to be added to the stripes.
FOLD_ENTRIES = 1_000_000
_BITS = 31
_LOW = (1 << _BITS) - 1
#: Cells of the dense tables made at once inside a piece.
DENSE_CELLS = 2_000_000
SCALE = 1_000_000_000
#: Text bytes of a document that are split into terms at once.
TEXT_BLOCK = 1 << 22
_STRIPE = "lang string, term binary, df long, sources array<string>, counts array<long>"
_TERMS = bytes(b if 97 <= b <= 122 or b >= 0x80 else 32 for b in LOWER_AZ)


def terms_of(data: bytes) -> Counter:
    """Counts of the runs of letters A-Z, lower-cased, and of bytes outside ASCII."""
    if len(data) <= TEXT_BLOCK:
        return Counter(data.translate(_TERMS).split())
    out, rest = Counter(), b""
    for at in range(0, len(data), TEXT_BLOCK):
        part = rest + data[at : at + TEXT_BLOCK].translate(_TERMS)
        cut = len(part) if at + TEXT_BLOCK >= len(data) else part.rfind(b" ") + 1
        out.update(part[:cut].split())
        rest = part[cut:]
    return out


class Stripes:
    """Stripes of a task: a hash table from term to stripe number a language, beside it each stripe's documents and source counts.

    A document's terms are looked up and put down as they are; every ``FOLD_ENTRIES`` of them are added to the stripes.
    """

    def __init__(self):
        number = itertools.count().__next__
        self.terms = defaultdict(lambda: defaultdict(number))
        self.sources: dict[str, int] = {}
        self.pending, self.waiting = [], 0
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.df = np.zeros(0, np.int64)

    def add(self, lang: str, source: str, found: Counter) -> None:
        stripe = np.fromiter(map(self.terms[lang].__getitem__, found), np.int64, len(found))
        self.pending.append(((stripe << _BITS) | self.sources.setdefault(source, len(self.sources)), np.fromiter(found.values(), np.int64, len(found))))
        self.waiting += len(found)

    def fold(self) -> int:
        """Add what is waiting; returns the number of source counts."""
        if self.pending:
            keys = np.concatenate([k for k, _ in self.pending])
            df = np.bincount(keys >> _BITS)
            df[: len(self.df)] += self.df
            self.df = df
            self.keys, self.sums = added(np.concatenate([self.keys, keys]), np.concatenate([self.sums, *(n for _, n in self.pending)]))
            self.pending, self.waiting = [], 0
        return len(self.keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        if not len(self.keys):
            return
        names = pa.array(list(self.sources), pa.string())
        for lang, held in self.terms.items():
            numbers, terms = np.fromiter(held.values(), np.int64, len(held)), list(held)
            for at in range(0, len(terms), 50_000):  # numbers of a language ascend
                some = numbers[at : at + 50_000]
                first, last = np.searchsorted(self.keys, some << _BITS), np.searchsorted(self.keys, (some + 1) << _BITS)
                size = last - first
                place = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
                yield stripe_batch(pa.array([lang] * len(some), pa.string()), pa.array(terms[at : at + 50_000], pa.binary()), self.df[some], size, names.take(pa.array(self.keys[place] & _LOW)), self.sums[place])


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts[order], starts)


def stripe_batch(lang: pa.Array, term: pa.Array, df: np.ndarray, sizes: np.ndarray, sources: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, pa.array(counts))]
    return pa.RecordBatch.from_arrays([lang, term, pa.array(df, pa.int64()), *lists], names=["lang", "term", "df", "sources", "counts"])


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of a task's documents (lang, source, text). A group without terms leaves a stripe under no term."""
    held = Stripes()
    for batch in batches:
        for lang, source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            found = terms_of(data)
            found[b""] = 0  # the group itself
            held.add(lang, source, found)
            if held.waiting > FOLD_ENTRIES and held.fold() > SPILL_CELLS:
                yield from held.rows()
                held = Stripes()
    yield from held.rows()


def merged(table: pa.Table) -> pa.RecordBatch:
    """One stripe a key from rows with equal keys side by side."""
    table = table.combine_chunks()
    lang, term, sources, counts = (table.column(c).chunk(0) for c in ("lang", "term", "sources", "counts"))
    same = pc.and_(pc.equal(lang.slice(1), lang.slice(0, len(lang) - 1)), pc.equal(term.slice(1), term.slice(0, len(term) - 1)))
    starts = np.flatnonzero(np.concatenate([[True], ~same.to_numpy(zero_copy_only=False)]))
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(lang))))
    names = sources.flatten().dictionary_encode()
    keys = np.repeat(owner, sources.value_lengths().to_numpy(zero_copy_only=False)) << _BITS | names.indices.to_numpy(zero_copy_only=False)
    keys, sums = added(keys, counts.flatten().to_numpy(zero_copy_only=False))
    df = np.add.reduceat(table.column("df").to_numpy(), starts)
    first = pa.array(starts)
    return stripe_batch(lang.take(first), term.take(first), df, np.bincount(keys >> _BITS, minlength=len(starts)), names.dictionary.take(pa.array(keys & _LOW)), sums)


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One stripe a key from rows sorted by key; the last key of a batch, merged so far, may go on in the next."""
    rest: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            done = merged(table if rest is None else pa.concat_tables([rest, table.cast(rest.schema)]))
            yield done.slice(0, done.num_rows - 1)
            rest = pa.Table.from_batches([done.slice(done.num_rows - 1)])
    if rest is not None:
        yield from rest.to_batches()


def stripes(docs: DataFrame, least: int = 10) -> DataFrame:
    """``(lang, term, df, sources, counts)`` of the terms in at least ``least`` documents of their language, written out.

    The row of a language under the empty term names all its sources.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    spilled = rows.mapInArrow(fold, _STRIPE).repartition(partitions_for(rows), "lang", "term").sortWithinPartitions("lang", "term")
    return materialize(spilled.mapInArrow(merge, _STRIPE).where((F.col("df") >= least) | (F.length("term") == 0)))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exact in 64 bits for totals up to 9e15: long division, three digits at a time."""
    whole, rest = np.divmod(counts + 2, totals)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + digit
    return whole + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def piece_shares(terms: list[bytes], sources: list[list[str]], counts: list[list[int]], names: list[str], totals: np.ndarray, kept: int, top: int) -> tuple[np.ndarray, list]:
    """Of one piece of a language's stripes: the sums of each pair of ``names``, and each source's best terms ``(source, term, value)``."""
    place = {s: i for i, s in enumerate(names)}
    over = np.append(totals, totals.sum()) + 2 * kept
    sums, best = np.zeros((len(names), len(names)), np.int64), []
    step = max(1, DENSE_CELLS // (len(names) + 1))
    for at in range(0, len(terms), step):
        some = terms[at : at + step]
        table = np.zeros((len(some), len(names) + 1), np.int64)
        for i, (ss, ns) in enumerate(zip(sources[at : at + step], counts[at : at + step])):
            table[i, [place[s] for s in ss]] = ns
        table[:, -1] = table.sum(1)
        p = shares(table, over[None, :])
        for i in range(len(names) - 1):
            sums[i, i + 1 :] += divergences(p[:, i : i + 1], p[:, i + 1 : -1]).sum(0)
        f = divergences(p[:, :-1], p[:, -1:])
        above = (table[:, :-1] > 0) & (p[:, :-1] > p[:, -1:])
        for i in range(len(names)):
            rows = np.flatnonzero(above[:, i])
            best += [(i, some[k], int(f[k, i])) for k in sorted(rows.tolist(), key=lambda k: (-f[k, i], some[k]))[:top]]
    best.sort(key=lambda x: (x[0], -x[2], x[1]))
    seen, few = Counter(), []
    for row in best:
        seen[row[0]] += 1
        if seen[row[0]] <= top:
            few.append(row)
    return sums, few


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of documents (lang, source, text); see ``op12``'s contract for the figures.

    Part ``pair``: the divergence of a source from each other one of its language. Part ``term``: the ``top`` terms that the
    source uses more than its language. Null columns read as empty. A language of one source has no pairs; one without kept
    terms has pairs of value 0. Repeated documents count again, an empty table gives no rows, other columns play no part.
    Pairs of sources are the result's own size; a term's stripe (its sources) is what a task must hold.
    """
    merged = stripes(docs, least)
    kept, groups = merged.where(F.length("term") > 0), merged.where(F.length("term") == 0)
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).select("lang", "c.sources", "c.counts")
    counted = each.groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("n"))
    held = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.size("sources")).alias("cells"))
    named = groups.select("lang", F.explode("sources").alias("source"))
    totals = named.join(counted.hint("merge"), ["lang", "source"], "left").join(held.hint("merge"), "lang", "left")
    totals = totals.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "kept", "cells")])
    totals = materialize(totals.withColumn("pieces", F.ceil((F.col("cells") + 1) / PIECE_CELLS).cast("int")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(partitions_for(kept) - 1))).alias("_salt")
    many = totals.groupBy("lang").agg(F.max("pieces").alias("pieces")).select("lang", "pieces", salts)
    spread = salted(kept, "term").join(many.hint("merge"), ["lang", "_salt"])  # a frequent language meets its number in pieces
    spread = spread.select("lang", F.pmod(F.xxhash64("term", F.lit(1)), F.col("pieces")).cast("int").alias("piece"), "term", "sources", "counts")
    beside = totals.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("lang", "piece", "source", "n", "kept")

    def audit(stripes: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        sides = sides.sort_values("source", kind="stable")
        names, lang = sides["source"].tolist(), sides["lang"].iloc[0]
        lists = [[x.tolist() for x in stripes[c]] for c in ("sources", "counts")]
        sums, best = piece_shares([bytes(t) for t in stripes["term"]], *lists, names, sides["n"].to_numpy(), int(sides["kept"].iloc[0]), top)
        i, j = np.triu_indices(len(names), 1)
        names = np.array(names, object)
        pairs = pd.DataFrame({"lang": lang, "source": names[i], "part": "pair", "item": names[j], "value": sums[i, j]})
        terms = pd.DataFrame({"lang": lang, "source": [names[r[0]] for r in best], "part": "term", "item": [r[1].decode("utf-8", "replace") for r in best], "value": [r[2] for r in best]})
        return pd.concat([pairs, terms]).astype({"value": "int64"})

    found = spread.groupBy("lang", "piece").cogroup(beside.groupBy("lang", "piece")).applyInPandas(audit, "lang string, source string, part string, item string, value long")
    found = materialize(found)
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    turned = pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked(pairs.unionByName(turned)).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: ``op12_source_divergence`` in DuckDB over the same table.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gt AS (SELECT g.lang, g.source, coalesce(sum(n.n), 0)::HUGEINT AS total FROM g LEFT JOIN n ON n.lang = g.lang AND n.source = g.source GROUP BY ALL),
lt AS (SELECT lang, sum(total)::HUGEINT AS total FROM gt GROUP BY lang),
ln AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY ALL),
p AS (SELECT gt.lang, gt.source, kept.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (gt.total + 2 * v.v) AS p
  FROM gt JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = gt.lang AND n.source = gt.source AND n.term = kept.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (ln.n + 2)) // (lt.total + 2 * v.v) AS q FROM ln JOIN lt USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
