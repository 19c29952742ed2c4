"""Glossaries: loading, lookup, longest-first matching, pages and differences."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tmengine.functions.text import clean_cell
from tmengine.tables import BROADCAST_ROWS, written

#: Up to so many terms one alternation is used, whose cost grows with the terms; above it texts and terms are joined.
PATTERN_TERMS = 5_000
#: Places of a text whose prints are made at once.
BLOCK = 1 << 20
#: Short texts are put together to about so many characters.
CHUNK = 1 << 16
#: Bits of a sieve for each print in it, and at most in all (128 MB).
SIEVE_BITS, SIEVE_MOST = 16, 1 << 30
#: Words of 64 bits in a page of it.
_PAGE = 1 << 13
_ODD = np.uint64(0x9E3779B97F4A7C15)


def load(entries: DataFrame) -> DataFrame:
    """Entries with source and target, the first row of each source, with ``n_rows`` of it and the place longest-first."""
    rows = entries.select("row_id", *[clean_cell(F.col(c)).alias(c) for c in ("source", "target", "category")])
    rows = rows.where("source <> '' and target <> ''").withColumn("category", F.when(F.col("category") != "", F.col("category")))
    first = F.min_by(F.struct("row_id", "target", "category"), "row_id")
    return rows.groupBy("source").agg(first.alias("f"), F.count("*").alias("n_rows")).select("source", "f.*", "n_rows")


def page(terms: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page longest-first with the total."""
    total = terms.agg(F.count("*").alias("total"))
    rows = terms.orderBy(F.length("source").desc(), "row_id").offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total))  # the total is one row


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources of ``new``: added if not in ``old``, else updated."""
    both = new.select("source").distinct().join(old.select("source").distinct().withColumn("was", F.lit(True)), "source", "left")
    return both.select("source", F.when(F.col("was"), "updated").otherwise("added").alias("change"))


def lookup(sources: DataFrame, terms: DataFrame) -> DataFrame:
    return sources.join(terms.select("source", F.col("target").alias("term_target")), "source", "left")


def by_category(terms: DataFrame) -> DataFrame:
    rows = terms.where("category is not null").groupBy("category")
    return rows.agg(F.count("*").alias("n_terms"), F.array_join(F.sort_array(F.collect_list("source")), "|").alias("sources"))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b + _ODD + (a << np.uint64(6)) + (a >> np.uint64(2)))) * _ODD
    return x ^ (x >> np.uint64(29))


def fingerprints(text: str, classes: list[int], block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(class, start, prints)``: prints of the 2^class characters from ``start`` and each place after it, in blocks of places.

    A class's prints are made of those of the class below, of both halves. Places without so many characters have none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    longest = 1 << classes[-1]
    for start in range(0, len(codes), block):
        held = codes[start : start + block + longest - 1].astype(np.uint64)
        held = _mixed(held, held)
        for k in range(classes[-1] + 1):
            if k:
                half = 1 << (k - 1)
                held = _mixed(held[:-half], held[half:]) if len(held) > half else held[:0]
            if k in classes and len(held):
                yield k, start, held[:block]


def whole_print(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The print of n characters from those of their first and last 2^class, which cover them."""
    return _mixed(_mixed(first, last), n.astype(np.uint64))


def part_print(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``whole_print`` for n characters that only begin a term."""
    return whole_print(first, last, -n.astype(np.int64))


def _joined(bodies: list[str], size: int) -> Iterator[tuple[int, str, np.ndarray]]:
    """Texts put together to about ``size`` characters, no text cut: number of the first one, the characters, where each text begins and the last one ends."""
    at = held = 0
    for i, said in enumerate(bodies):
        held += len(said)
        if held >= size or i == len(bodies) - 1:
            yield at, "".join(bodies[at : i + 1]), np.cumsum([0, *map(len, bodies[at : i + 1])])
            at, held = i + 1, 0


def _wholes(said: str, classes: list[int]) -> dict[int, np.ndarray]:
    """All prints of each class."""
    parts: dict[int, list] = {}
    for k, _, prints in fingerprints(said, classes):
        parts.setdefault(k, []).append(prints)
    return {k: np.concatenate(p) for k, p in parts.items()}


def _digest(source: str) -> bytes:
    return hashlib.blake2b(source.encode(), digest_size=16).digest()


def _step(k: int) -> int:
    """Terms of class k are met at the lengths 2^k, 2^k + step, ... before their own."""
    return 1 << ((k + 1) // 2)


def printed_terms(terms: DataFrame) -> DataFrame:
    """``(digest, class, begun, part, whole, again)`` of distinct sources: 128 bits of BLAKE2 that stand for it, the class of its length n
    (2^class <= n), prints of its first 2^class characters, of as many whole steps more as it has, and two of all. The source goes no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column("source").unique().to_pylist()
            for at, said, cuts in _joined(sources, CHUNK):
                n = np.diff(cuts)
                k = np.frexp(n)[1] - 1
                begun, part, whole = np.zeros((3, len(n)), np.uint64)
                for c, prints in _wholes(said, sorted(set(k.tolist()))).items():
                    own = np.flatnonzero(k == c)
                    start, size = cuts[own], n[own]
                    some = size - (size - (1 << c)) % _step(c)
                    begun[own] = prints[start]
                    part[own] = np.where(some > 1 << c, part_print(prints[start], prints[start + some - (1 << c)], some), prints[start])
                    whole[own] = whole_print(prints[start], prints[start + size - (1 << c)], size)
                columns = [pa.array([_digest(x) for x in sources[at : at + len(n)]], pa.binary()), k.astype(np.int32), *(x.view(np.int64) for x in (begun, part, whole, _mixed(whole, whole)))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["digest", "class", "begun", "part", "whole", "again"])

    return terms.select("source").where("source <> ''").mapInArrow(run, "digest binary, class int, begun long, part long, whole long, again long").distinct()


def sieve(rows: DataFrame, column: str) -> Broadcast:
    """A table of bits that says of a print whether it may be in the column: yes for all that are, and for few others.

    A print has five bits in one word of 64. The table takes ``SIEVE_BITS`` to twice as many bits a row up to ``SIEVE_MOST`` in
    all; pages of it are made in tasks and put together on the driver.
    """
    size = min(SIEVE_MOST // 64, max(_PAGE, 1 << (rows.count() * SIEVE_BITS // 64).bit_length()))
    pages = size // _PAGE

    def page(part: pd.DataFrame) -> pd.DataFrame:
        prints, words = part["print"].to_numpy().view(np.uint64), np.zeros(_PAGE, np.uint64)
        np.bitwise_or.at(words, (_word(prints, size) % _PAGE).astype(np.int64), _bits(prints))
        return pd.DataFrame({"page": part["page"].iloc[:1], "bits": [words.tobytes()]})

    number = F.shiftrightunsigned(F.col(column), 65 - pages.bit_length()).cast("int") if pages > 1 else F.lit(0)
    made = written(rows.select(number.alias("page"), F.col(column).alias("print")).groupBy("page").applyInPandas(page, "page int, bits binary"))
    out = np.zeros((pages, _PAGE), np.uint64)
    for r in made.toLocalIterator():
        out[r["page"]] = np.frombuffer(r["bits"], np.uint64)
    return rows.sparkSession.sparkContext.broadcast(out.reshape(-1))


def _word(prints: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` words, a power of two above one, has a print's bits."""
    return prints >> np.uint64(65 - size.bit_length())


def _bits(prints: np.ndarray, n: int = 5) -> np.ndarray:
    out = np.zeros(len(prints), np.uint64)
    for shift in range(0, 6 * n, 6):
        out |= np.uint64(1) << ((prints >> np.uint64(shift)) & np.uint64(63))
    return out


def _passes(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Places of the prints that pass a sieve."""
    words = bits.take(_word(prints, len(bits)).view(np.int64), mode="clip")
    two = _bits(prints, 2)
    some = np.flatnonzero((words & two) == two)
    all_of = _bits(prints[some])
    return some[(words[some] & all_of) == all_of]


def _found(said: str, cuts: np.ndarray, classes: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths at which terms may stand in texts put together, none across an end of a text; all that do are among them.

    Where the sieve has the 2^k characters from a place, it is asked for them and some steps more, and for what passes at each
    length up to the next step: about twice the root of 2^k lengths in place of 2^k.
    """
    end = np.repeat(cuts[1:], np.diff(cuts))
    places_, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def longer(prints: np.ndarray, k: int, at: np.ndarray, n: np.ndarray, more: np.ndarray, named: Callable) -> tuple[np.ndarray, np.ndarray]:
        p, size = np.repeat(at, len(more)), (n[:, None] + more).reshape(-1)
        inside = p + size <= end[p]
        p, size = p[inside], size[inside]
        names = named(prints[p], prints[p + size - (1 << k)], size)
        ok = _passes(bits, names)
        if named is whole_print:
            ok = ok[_passes(bits, _mixed(names[ok], names[ok]))]
        return p[ok], size[ok]

    for k, prints in _wholes(said, classes).items():
        at = _passes(bits, prints)
        at = at[at + (1 << k) <= end[at]]
        n = np.full(len(at), 1 << k)
        p, size = longer(prints, k, at, n, np.arange(_step(k), 1 << k, _step(k)), part_print)
        p, size = longer(prints, k, np.concatenate([at, p]), np.concatenate([n, size]), np.arange(_step(k)), whole_print)
        places_.append(p)
        sizes.append(size)
    return np.concatenate(places_), np.concatenate(sizes)


def _left_to_right(place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest at each place, from left to right, none inside another."""
    order = np.lexsort((-n, place))
    place, n = place[order], n[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    place, n = place[first], n[first]
    after, taken, i = np.searchsorted(place, place + n).tolist(), [], 0
    while i < len(after):
        taken.append(i)
        i = after[i]
    return place[taken], n[taken]


def matches(texts: DataFrame, terms: DataFrame, text: str = "text", pattern_terms: int = PATTERN_TERMS) -> DataFrame:
    """``texts`` with ``terms``: the distinct glossary sources found in the text, longest first at each place, in order.

    Up to ``pattern_terms`` sources make one regular expression. Any number beyond is met by joins: see ``joined_matches``.
    """
    few = terms.select("source").where("source <> ''").distinct().limit(pattern_terms + 1).collect() if pattern_terms else [None]
    if len(few) > pattern_terms:
        return joined_matches(texts, terms, text)
    names = sorted((r["source"] for r in few), key=lambda s: (-len(s), s))
    if not names:
        return texts.withColumn("terms", F.array().cast("array<string>"))
    quoted = "|".join(re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", s) for s in names)
    return texts.withColumn("terms", F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(quoted), F.lit(0))))


def _sieved(terms: DataFrame) -> tuple[DataFrame, list[int], Broadcast | None]:
    """The printed terms, their classes and the sieve of all their prints."""
    known = written(printed_terms(terms))
    classes = sorted(r["class"] for r in known.select("class").distinct().collect())  # at most 31 numbers
    prints = known.select(F.explode(F.array_distinct(F.array("begun", "part", "whole", "again"))).alias("print"))
    return known, classes, sieve(prints, "print") if classes else None


def _side(df: DataFrame, counted: DataFrame) -> DataFrame:
    return F.broadcast(df) if counted.count() <= BROADCAST_ROWS else df.hint("merge")


def places(full: DataFrame, terms: DataFrame) -> DataFrame:
    """``(_text, place, source)``: every place of every text ``(_text, body)`` where a source stands, for a glossary of any size.

    A term of n characters has the class k with 2^k <= n < 2^(k + 1). Prints of a term, of its first 2^k characters, of some steps
    more and two of all, are in one ``sieve``, by which a task finds where terms may stand; only those places leave it, and
    their texts' digests decide.
    """
    known, classes, bits = _sieved(terms)
    if not classes:
        return full.sparkSession.createDataFrame([], "_text long, place long, source string")
    return _placed(full, known, classes, bits)


def _placed(full: DataFrame, known: DataFrame, classes: list[int], bits: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_text").to_numpy()
            for first, said, cuts in _joined(batch.column("body").to_pylist(), CHUNK):
                place, n = _found(said, cuts, classes, bits.value)
                text = np.searchsorted(cuts, place, "right") - 1
                sources = [said[p : p + m] for p, m in zip(place.tolist(), n.tolist())]
                columns = [ids[first + text], place - cuts[text], pa.array(sources, pa.string()), pa.array(map(_digest, sources), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_text", "place", "source", "digest"])

    there = full.mapInArrow(run, "_text long, place long, source string, digest binary")
    return there.join(_side(known.select("digest"), known), "digest", "left_semi").select("_text", "place", "source")


def joined_matches(texts: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """``matches`` for a glossary of any size, none of which reaches the driver.

    A task resolves what its texts may hold by the ``sieve`` (see ``places``) from left to right. Terms are among that, so a text is
    settled if all it took are terms: the digests of all takings, each once, are compared with the terms'. The few texts
    that took something else are resolved again from ``places``. Texts are written once and meet no shuffle but then.
    """
    known, classes, bits = _sieved(terms)
    none = F.array().cast("array<string>")
    if not classes:
        return texts.withColumn("terms", none)
    said_body = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_body")
    kept = texts.columns

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for _, said, cuts in _joined(batch.column("_body").to_pylist(), CHUNK):
                place, n = _left_to_right(*_found(said, cuts, classes, bits.value))
                text = np.searchsorted(cuts, place, "right") - 1
                each: list[dict] = [{} for _ in range(len(cuts) - 1)]
                for i, p, m in zip(text.tolist(), place.tolist(), n.tolist()):
                    each[i].setdefault(said[p : p + m], (p - int(cuts[i]), m))
                held += each
            ends = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
            lists = [[p for x in held for p, _ in x.values()], [m for x in held for _, m in x.values()], [_digest(s) for x in held for s in x]]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in zip(lists, (pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*kept, "_text"]), *lists], names=[*kept, "_text", "_at", "_n", "_digests"])

    fields = [*texts.schema.fields, T.StructField("_text", T.LongType()), *(T.StructField(c, T.ArrayType(t)) for c, t in (("_at", T.IntegerType()), ("_n", T.IntegerType()), ("_digests", T.BinaryType())))]
    settled = written(texts.select("*", F.monotonically_increasing_id().alias("_text"), said_body).mapInArrow(resolved, T.StructType(fields)))
    taken = settled.select("_text", F.explode("_digests").alias("digest"))
    no_terms = written(taken.select("digest").distinct().join(_side(known.select("digest"), known), "digest", "left_anti"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column("_at"), batch.column("_n")
            out = [[said[p : p + m] for p, m in zip(x, y)] for said, x, y in zip(batch.column("_body").to_pylist(), at.to_pylist(), n.to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.list_(pa.string()))], names=[*kept, "terms"])

    schema = T.StructType([*texts.schema.fields, T.StructField("terms", T.ArrayType(T.StringType()))])
    if not no_terms.count():
        return settled.select(*kept, "_at", "_n", said_body).mapInArrow(cut, schema)
    doubtful = written(taken.join(_side(no_terms, no_terms), "digest", "left_semi").select("_text").distinct())
    again = settled.join(_side(doubtful, doubtful), "_text", "left_semi").select("_text", *kept, said_body.alias("body"))
    hits = _placed(again.select("_text", "body"), known, classes, bits).groupBy("_text").agg(F.collect_list(F.struct("place", F.length("source").alias("n"))).alias("hits"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for said, found in zip(batch.column("body").to_pylist(), batch.column("hits")):
                place, n = _left_to_right(*(found.values.field(i).to_numpy().astype(np.int64) for i in range(2)))
                out.append(list(dict.fromkeys(said[p : p + m] for p, m in zip(place.tolist(), n.tolist()))))
            yield pa.RecordBatch.from_arrays([batch.column("_text"), pa.array(out, pa.list_(pa.string()))], names=["_text", "terms"])

    mended = written(again.select("_text", "body").join(hits.hint("merge"), "_text").mapInArrow(listed, "_text long, terms array<string>"))
    fine = settled.join(_side(doubtful, doubtful), "_text", "left_anti").select(*kept, "_at", "_n", said_body).mapInArrow(cut, schema)
    return fine.unionByName(again.join(mended.hint("merge"), "_text", "left").select(*kept, F.coalesce("terms", none).alias("terms")))


def unit_terms(members: DataFrame) -> DataFrame:
    """Distinct terms of each unit in first-seen order over ``(unit_id, pos, terms)``."""
    each = members.select("unit_id", "pos", F.posexplode("terms").alias("idx", "term"))
    first = each.groupBy("unit_id", "term").agg(F.min(F.struct("pos", "idx")).alias("seen"))
    listed = F.array_sort(F.collect_list(F.struct("seen", "term")))
    return first.groupBy("unit_id").agg(F.transform(listed, lambda x: x["term"]).alias("terms"))
