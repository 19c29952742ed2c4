"""Template clusters: texts that share a long common prefix and suffix.

Two texts are linked if (common prefix + common suffix) / longer length reaches the threshold t, the two not overlapping in
the shorter text. Texts in order, and reversed texts in order, tell where a text parts from others: the running minima of
the common prefixes of neighbours. A pair parts at one such depth d from the front and one, e, from the back. So texts
that agree in the first d and the last e characters meet under one key, and there linked texts are runs of overlapping
length intervals: components need neither pairs nor a text beside another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmengine.functions.text import affix_similarity, common_prefix, ngrams, stripped
from tmengine.operators.graph import components, salted
from tmengine.operators.units import numbered
from tmengine.tables import BROADCAST_ROWS, written

_EPS = 1e-9
#: Sets packed together, and most items of theirs: each block of queries is compared with each block of rows.
QUERY_SETS, ROW_SETS, BLOCK_ITEMS = 4_096, 4_096, 1 << 22
#: Below this similarity nearly all of a set is its prefix, and what two sets share is counted at once.
PREFIX_LEAST = 0.25
#: Stated sets whose sizes differ by less than this factor are looked up together.
_RATIO = 1.2
#: Rows and shared items looked at together, and words of 64 bits in a set's sketch at most.
_SLICE, _POSTS, _WORDS = 512, 1 << 19, 64
_REST = (1 << 24) - 1


def _ceil(x: Column) -> Column:
    return F.ceil(x - _EPS).cast("int")


def _keyed(rows: DataFrame, sizes: Column) -> DataFrame:
    """One row for each wanted affix size and side: the hash of the affix, its size and the side."""
    sides = F.array(F.struct(F.lit("p").alias("side"), F.col("text").alias("s")), F.struct(F.lit("s").alias("side"), F.reverse("text").alias("s")))
    each = rows.withColumn("q", F.explode(sizes)).withColumn("end", F.explode(sides))
    return each.select("*", F.xxhash64(F.substring(F.col("end.s"), F.lit(1), F.col("q"))).alias("key"), F.col("end.side").alias("side")).drop("end")


def _common(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _beyond(edges: list) -> dict[int, list[int]]:
    """For parts ``(part, first, last, near, reach)`` in order: the depths at which a part's first text parts from all before it.

    ``near`` are those of the last text within its part, ``reach`` what it has in common with the part's first.
    """
    out, before, last = {}, [], None
    for part, first, end, near, reach in edges:
        if last is not None:
            shared = _common(last, first)
            before = sorted({m for m in before if m < shared} | {shared} - {0})
        out[part] = before
        before, last = sorted({min(reach, m) for m in before} | set(near)), end
    return out


def branch_depths(rows: DataFrame) -> DataFrame:
    """``(row_id, depths)`` of distinct texts ``(row_id, s)``: the lengths of prefixes that end where another text goes on differently.

    Texts are range-partitioned and swept in both orders; a stack of running minima is all that a task keeps. Of each
    partition the first and last text and their depths pass through the driver.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = written(rows.select("row_id", "s").repartitionByRange(parts, "s").withColumn("part", F.spark_partition_id()))

    def swept(name: str, order: Column) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, last, stack, reach = None, "", [], 0
            for batch in batches:
                near, far = [], []
                for p, s in zip(batch["part"], batch["s"]):
                    if p != part:
                        part, stack, reach = p, [], len(s)
                    else:
                        shared = _common(last, s)
                        while stack and stack[-1] >= shared:
                            stack.pop()
                        if shared:
                            stack.append(shared)
                        reach = min(reach, shared)
                    last = s
                    near.append(list(stack))
                    far.append(reach)
                yield batch[["row_id", "part"]].assign(near=near, reach=far)

        sorted_ = laid.repartition(parts, "part").sortWithinPartitions("part", order)
        out = sorted_.mapInPandas(run, "row_id long, part int, near array<int>, reach int")
        return written(out.select("row_id", "part", F.col("near").alias(f"near_{name}"), F.col("reach").alias(f"reach_{name}")))

    ends = laid.groupBy("part").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.min_by("row_id", "s").alias("lo_id"), F.max_by("row_id", "s").alias("hi_id"))
    ends = sorted(ends.collect(), key=lambda r: r["lo"].encode("utf-8", "surrogatepass"))  # a row a partition
    up, down = swept("up", F.col("s").asc()), swept("down", F.col("s").desc())
    of = lambda df, ids, name: {r["row_id"]: (r[f"near_{name}"], r[f"reach_{name}"]) for r in df.where(F.col("row_id").isin(ids)).collect()}
    last, first = of(up, [r["hi_id"] for r in ends], "up"), of(down, [r["lo_id"] for r in ends], "down")
    left = _beyond([(r["part"], r["lo"], r["hi"], *last[r["hi_id"]]) for r in ends])
    right = _beyond([(r["part"], r["hi"], r["lo"], *first[r["lo_id"]]) for r in reversed(ends)])
    beyond = spark.createDataFrame([(p, left[p], right[p]) for p in left] or [(0, [], [])], "part int, left array<int>, right array<int>")
    both = up.join(down.drop("part").hint("merge"), "row_id").join(F.broadcast(beyond), "part")
    capped = lambda c, reach: F.transform(c, lambda m: F.least(F.col(reach), m))
    depths = F.concat("near_up", "near_down", capped("left", "reach_up"), capped("right", "reach_down"))
    return both.select("row_id", F.filter(F.array_distinct(depths), lambda x: x > 0).alias("depths"))


def affix_edges(rows: DataFrame, t: float) -> DataFrame:
    """Edges ``(a, b)`` that connect the linked ones of distinct texts ``(row_id, text, n)``, without a row for each pair.

    A text comes under each pair of its depths (d, e) whose sum, or its length if that is less, reaches t times its length.
    A pair of texts under a key is linked if and only if the intervals from the needed to the reached length overlap.
    Texts of a key have the same lesser depths, so they also share the wider keys with the depth before d or e. Where such a
    key's sum is enough for the neediest text of all, it links all that this key does, and the text does not come under this one.
    These depend on the lengths only, so rows of a length are a star and the few lengths of a key are swept.
    """
    front = branch_depths(rows.select("row_id", F.col("text").alias("s"))).withColumnRenamed("depths", "front")
    back = branch_depths(rows.select("row_id", F.reverse("text").alias("s"))).withColumnRenamed("depths", "back")
    full = rows.join(front.hint("merge"), "row_id").join(back.hint("merge"), "row_id").withColumn("need", F.greatest(F.lit(1), _ceil(F.col("n") * t)))
    most = int(rows.agg(F.max(F.greatest(F.lit(1), _ceil(F.col("n") * t)))).first()[0] or 0)  # no text needs more
    zero, none = F.array(F.lit(0)), F.lit(-1 << 30)
    full = full.withColumns({side: F.sort_array(F.concat(side, zero)) for side in ("front", "back")})
    full = full.select("*", F.posexplode("front").alias("i", "d")).withColumn("d_before", F.coalesce(F.get("front", F.col("i") - 1), none))

    def kept(e: Column, j: Column) -> Column:
        wider = F.greatest(F.col("d_before") + e, F.col("d") + F.coalesce(F.get("back", j - 1), none))
        return (F.least(F.col("d") + e, F.col("n")) >= F.col("need")) & (wider < most)

    full = full.withColumn("e", F.explode(F.filter("back", kept)))
    ahead, behind = F.substring("text", F.lit(1), F.col("d")), F.substring("text", F.col("n") - F.col("e") + 1, F.col("e"))
    name = F.struct(F.xxhash64("d", "e", ahead, behind), F.xxhash64(behind, F.lit(1), ahead, "e", "d"))
    keyed = written(full.select("row_id", name.alias("name"), F.least(F.col("d") + F.col("e"), F.col("n")).alias("reach"), "need"))
    kinds = written(keyed.groupBy("name", "reach").agg(F.min("row_id").alias("top"), F.min("need").alias("need"), F.count("*").alias("m")))
    several = kinds.groupBy("name").agg(F.sum("m").alias("m")).where("m > 1").select("name")
    spread = salted(keyed.withColumn("key", F.struct("name", "reach")), "row_id")
    least = kinds.where("m > 1").select(F.struct("name", "reach").alias("key"), "top")
    asked = least.join(spread.select("key", "_salt").distinct().hint("merge"), "key")
    stars = spread.join(asked.hint("merge"), ["key", "_salt"]).select(F.col("row_id").alias("a"), F.col("top").alias("b"))
    along = Window.partitionBy("name").orderBy("need", "reach")
    runs = kinds.join(several.hint("merge"), "name").withColumn("before", F.max("reach").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum(F.when(F.col("need") > F.col("before"), 1).otherwise(0)).over(along))
    runs = runs.withColumn("first", F.min("top").over(Window.partitionBy("name", "run")))
    return stars.union(runs.select(F.col("top").alias("a"), F.col("first").alias("b"))).where("a <> b").distinct()


def affix_links(rows: DataFrame, t: float) -> DataFrame:
    """Linked pairs ``(a, b, similarity)``: of those that share a prefix or suffix of half the needed length, verified as they meet.

    The longer text offers its one key, the shorter one key for each partner length it admits.
    """
    longer = _keyed(rows, F.array(F.greatest(F.lit(1), _ceil(F.col("n") * t / 2))))
    lengths = rows.select("n").distinct().agg(F.sort_array(F.collect_list("n")).alias("ns"))
    partners = F.filter("ns", lambda m: (m >= F.col("n")) & (m * t <= F.col("n") + _EPS))
    sizes = F.array_distinct(F.transform(partners, lambda m: F.greatest(F.lit(1), _ceil(m * t / 2))))
    shorter = _keyed(rows.crossJoin(F.broadcast(lengths)), F.filter(sizes, lambda q: q <= F.col("n"))).drop("ns")  # one row: the distinct lengths
    x, y = longer.alias("x"), shorter.alias("y")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.q") == F.col("y.q")) & (F.col("x.side") == F.col("y.side"))
    fit = (F.col("x.row_id") != F.col("y.row_id")) & (F.col("x.n") >= F.col("y.n")) & (F.col("y.n") >= F.col("x.n") * t - _EPS)
    met = x.join(y.hint("merge"), on & fit).withColumn("similarity", affix_similarity(F.col("x.text"), F.col("y.text"))).where(F.col("similarity") >= t - _EPS)
    return met.select(F.least("x.row_id", "y.row_id").alias("a"), F.greatest("x.row_id", "y.row_id").alias("b"), "similarity").dropDuplicates(["a", "b"])


def trimmed(texts: DataFrame) -> DataFrame:
    """``(row_id, text, n)`` of the texts that are not blank; blank ones link with nothing."""
    rows = texts.select("row_id", stripped(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.withColumn("n", F.length("text")).where("n > 0")


def affix_pairs(texts: DataFrame, t: float = 0.4) -> DataFrame:
    """All linked pairs ``(a, b, similarity)`` with a < b: a pair a row, so for texts with few links; else use components."""
    return affix_links(trimmed(texts), t).withColumn("similarity", F.round("similarity", 6))


def _set_blocks(rows: DataFrame, key: str, places: DataFrame, size: int, few: bool, least_parts: int = 1) -> DataFrame:
    """Sets ``(key, items)`` of similar size, up to ``size`` and ``BLOCK_ITEMS`` items together, in ``least_parts`` blocks at least, as ``(least, most, ids, sizes, ends, items)``, written out.

    Items are places in the order of rarity, sorted; those without a place only count in a set's size. Sets of such only are left out.
    """
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("n", F.size("items"))
    rows = written(rows)
    each = rows.select("_row", key, "n", F.explode("items").alias("item")).join(F.broadcast(places) if few else places.hint("shuffle_hash"), "item")
    listed = each.groupBy("_row").agg(F.first(key).alias("id"), F.first("n").alias("n"), F.sort_array(F.collect_list("place")).alias("places"))
    parts = max(least_parts, -(-rows.count() // size))
    laid = listed.select("id", "n", "places").repartitionByRange(parts, "n", "id").sortWithinPartitions("n", "id")
    most = BLOCK_ITEMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.cumsum(batch.column("places").value_lengths().to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                own = min(size, max(1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")) - at))
                ids, n, held = batch.slice(at, own).columns
                at += own
                ends = np.cumsum(held.value_lengths().to_numpy())
                columns = [[n[0].as_py()], [n[-1].as_py()], [ids.to_numpy()], [n.to_numpy()], [ends], [held.flatten().to_numpy()]]
                names = ["least", "most", "ids", "sizes", "ends", "items"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK_TYPES)], names=names)

    return written(laid.mapInArrow(run, "least int, most int, ids array<long>, sizes array<int>, ends array<long>, items array<int>"))


_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]


class _Asked:
    """A block of stated sets, by item: which sets have it."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray, items: np.ndarray) -> None:
        self.ids, self.sizes, self.begin, self.ends = ids, sizes, np.concatenate([[0], ends[:-1]]), ends
        self.names, self.items = np.unique(items, return_inverse=True)
        order = np.argsort(self.items, kind="stable")
        self.owner = np.repeat(np.arange(len(ids)), ends - self.begin)[order]
        self.cuts = np.searchsorted(self.items[order], np.arange(len(self.names) + 1))
        self.mark = np.zeros(len(self.names), bool)

    def like(self, n: int, items: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The stated sets that may be so similar to a set of n items, and what they have in common with it.

        A set that is shares at least ``least`` times n items; all but half as many of the most common items are counted, and where
        too few are met for the rest to suffice, a set is left out; the rest is counted on what is left.
        """
        lo = np.searchsorted(self.sizes, n * least - _EPS)
        hi = np.searchsorted(self.sizes, n / least + _EPS, "right")
        at = np.minimum(np.searchsorted(self.names, items), len(self.names) - 1)
        at = at[self.names[at] == items]
        tail = min(len(at), int(np.ceil(n * least - _EPS)) // 2)
        head, rest = at[: len(at) - tail], at[len(at) - tail :]
        met = [self.owner[a:z] for a, z in zip(self.cuts[head].tolist(), self.cuts[head + 1].tolist())]
        if lo >= hi or not met:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        common = np.bincount(np.concatenate(met), minlength=len(self.ids))[lo:hi]
        needed = np.maximum(1, np.ceil((n + self.sizes[lo:hi]) * (least / (1 + least)) - _EPS))  # items that sets of these sizes must share
        which = np.flatnonzero(common + tail >= needed)
        common, which = common[which], which + lo
        if tail and len(which):
            self.mark[rest] = True
            count = self.ends[which] - self.begin[which]
            start = np.cumsum(count) - count
            held = self.mark[self.items[np.repeat(self.begin[which] - start, count) + np.arange(int(count.sum()))]]
            common = common + np.add.reduceat(held, start, dtype=np.int64)
            self.mark[rest] = False
        return which, common


def _spread(count: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _sketches(owner: np.ndarray, items: np.ndarray, sets: int, words: int) -> np.ndarray:
    """``words`` words of bits for each set; an item turns one over, so two sets' sketches differ in at most as many bits as the sets in items."""
    mixed = items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(words * sets, np.uint64)
    word = ((mixed >> np.uint64(40)) % np.uint64(words)).astype(np.int64)
    np.bitwise_xor.at(out, word * sets + owner, np.uint64(1) << (mixed >> np.uint64(58)))
    return out.reshape(words, sets)


class _Near:
    """A block of stated sets, by the items of their prefixes, for rows that may be similar to at least ``least``.

    Sets of n and m items must share t = (n + m) * least / (1 + least) of them. All items are in one order, so of the first
    item that both have, each set has t at least from there on: only the rarest n - t + 1 of one and m - t + 1 of the other
    are looked up. What shares one of these must not differ in more bits of the sketches than n + m - 2 t; the rest is compared.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray, items: np.ndarray, least: float) -> None:
        self.ids, self.sizes, self.items, self.least = ids, sizes.astype(np.int64), items, least
        self.ends, self.begin = ends, np.concatenate([[0], ends[:-1]])
        owner = np.repeat(np.arange(len(ids)), ends - self.begin)
        rest = np.repeat(ends, ends - self.begin) - np.arange(len(items))  # items from here on
        level = np.floor(np.log(self.sizes) / np.log(_RATIO)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(level, prepend=-1, append=-1))
        self.levels = [(int(level[a]), a, z) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        self.drawn = {k: _sketches(owner[self.begin[a] : ends[z - 1]] - a, items[self.begin[a] : ends[z - 1]], z - a, self.words(z)) for k, a, z in self.levels}
        head = rest >= np.ceil(self.sizes[owner] * least - _EPS)
        owner, rest = owner[head], rest[head]
        keys = (level[owner] << 55) | (items[head].astype(np.int64) << 24) | (_REST - np.minimum(rest, _REST))
        order = np.argsort(keys)
        self.keys, self.owner, self.rest = keys[order], owner[order], rest[order]

    def words(self, z: int) -> int:
        """For a sketch of about four bits an item of the largest set before z."""
        return min(_WORDS, 1 << int(self.sizes[z - 1] * 4 // 64).bit_length())

    def shared(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.maximum(1, np.ceil((n + m) * (self.least / (1 + self.least)) - _EPS)).astype(np.int64)

    def pairs(self, sizes: np.ndarray, ends: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows, in order of size, and stated sets, by their numbers, that may be similar; all that are, each pair once."""
        sizes, begin = sizes.astype(np.int64), np.concatenate([[0], ends[:-1]])
        held = ends - begin
        owner, drawn, found = np.repeat(np.arange(len(sizes)), held), {}, [np.zeros(0, np.int64)]
        for k, a, z in self.levels:
            low, high, words = self.sizes[a], self.sizes[z - 1], self.words(z)
            first, last = np.searchsorted(sizes, low * self.least - _EPS), np.searchsorted(sizes, high / self.least + _EPS, "right")
            if first >= last:
                continue
            t = self.shared(sizes[first:last], np.maximum(low, np.ceil(sizes[first:last] * self.least - _EPS)))
            count = np.maximum(0, held[first:last] - t + 1)
            row, nth = np.repeat(np.arange(first, last), count), _spread(count)
            named = (k << 55) | (items[begin[row] + nth].astype(np.int64) << 24)
            start = np.searchsorted(self.keys, named)
            many = np.searchsorted(self.keys, named + (_REST - np.minimum(np.repeat(t, count), _REST)), "right") - start
            some = np.flatnonzero(many)
            row, nth, start, many = row[some], nth[some], start[some], many[some]
            if words not in drawn:
                drawn[words] = _sketches(owner, items, len(sizes), words)
            total, at = np.cumsum(many), 0
            while at < len(many):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _POSTS, "right")))
                found.append(self._sorted_out(row[at:end], nth[at:end], start[at:end], many[at:end], sizes, held, drawn[words], self.drawn[k], a))
                at = end
        pair = np.unique(np.concatenate(found))
        return pair // len(self.ids), pair % len(self.ids)

    def _sorted_out(self, row, nth, start, many, sizes, held, ours, theirs, a) -> np.ndarray:  # noqa: ANN001
        post, row, nth = np.repeat(start, many) + _spread(many), np.repeat(row, many), np.repeat(nth, many)
        query = self.owner[post]
        n, m = sizes[row], self.sizes[query]
        t = self.shared(n, m)
        ok = np.flatnonzero((held[row] - nth >= t) & (self.rest[post] >= t) & (m >= n * self.least - _EPS) & (m * self.least <= n + _EPS))
        row, query = row[ok], query[ok]
        left = held[row] + m[ok] - 2 * t[ok]
        for w in range(len(ours)):
            left = left - np.bitwise_count(ours[w][row] ^ theirs[w][query - a])
            if w % 4 == 3 or w == len(ours) - 1:
                ok = np.flatnonzero(left >= 0)
                row, query, left = row[ok], query[ok], left[ok]
        return np.unique(row * len(self.ids) + query)

    def common(self, which: np.ndarray, items: np.ndarray) -> np.ndarray:
        """How many of a row's items, sorted, each of the stated sets has."""
        count = self.ends[which] - self.begin[which]
        theirs = self.items[np.repeat(self.begin[which], count) + _spread(count)]
        at = np.minimum(np.searchsorted(items, theirs), len(items) - 1)
        return np.add.reduceat(items[at] == theirs, np.cumsum(count) - count, dtype=np.int64)


def similar_sets(queries: DataFrame, rows: DataFrame, least: float, counts: dict | None = None) -> DataFrame:
    """``(query_id, row_id, similarity)`` of stated queries and rows (id, items) whose sets have a Jaccard similarity of at least ``least`` > 0.

    Items are numbered by how many queries have them, the rarest first; both sides are packed into blocks of sets of similar
    size, and each block of queries meets the blocks of rows whose sizes allow it, in some task. There only sets that share
    one of the rarest items of both and whose sketches do not differ too much are compared (``_Near``); below
    ``PREFIX_LEAST`` a row counts the queries that share its rarer items, and those that the others could still lift are
    compared. A row of a query's own id is left out; items are taken as distinct, null and empty sets are similar to nothing.
    Items met are a number of rows times one of queries, but memory is that of two blocks. ``counts`` takes the candidates (tests).
    """
    clean = lambda df, key: df.select(key, F.array_compact(F.array_distinct("items")).alias("items"))
    asked = clean(queries, "query_id")
    frequency = asked.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("df"))
    places = written(numbered(frequency, "df", "item").select("item", F.col("place").cast("int").alias("place")))
    few = places.count() <= BROADCAST_ROWS
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = {"query_id": _set_blocks(asked, "query_id", places, QUERY_SETS, few), "row_id": _set_blocks(clean(rows, "row_id"), "row_id", places, ROW_SETS, few, 2 * parts)}
    every, by_prefix = counts is not None, least >= PREFIX_LEAST

    def near(held: _Near, part: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        begin = 0
        for at in range(0, len(part["ids"]), _SLICE):
            ends = part["ends"][at : at + _SLICE]
            items, ends = part["items"][begin : ends[-1]], ends - begin
            begin += len(items)
            row, query = held.pairs(part["sizes"][at : at + _SLICE], ends, items)
            cuts = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                i = int(row[a])
                yield at + i, query[a:z], held.common(query[a:z], items[ends[i - 1] if i else 0 : ends[i]])

    def counted(held: _Asked, part: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        begin = 0
        for i, (n, end) in enumerate(zip(part["sizes"].tolist(), part["ends"].tolist())):
            yield i, *held.like(n, part["items"][begin:end], least)
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                part = {c: batch.column(c)[i].values.to_numpy() for c in batch.schema.names}
                if held is None or len(name) != len(part["q_ids"]) or (name != part["q_ids"]).any():
                    stated = [part[f"q_{c}"] for c in ("ids", "sizes", "ends", "items")]
                    name, held = part["q_ids"], _Near(*stated, least) if by_prefix else _Asked(*stated)
                found = []
                for nth, which, common in near(held, part) if by_prefix else counted(held, part):
                    row_id, n = part["ids"][nth], part["sizes"][nth]
                    similarity = common / (n + held.sizes[which] - common)
                    keep = (every | (similarity >= least)) & (held.ids[which] != row_id)
                    if keep.any():
                        found.append((held.ids[which[keep]], np.full(int(keep.sum()), row_id, np.int64), similarity[keep]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query_id", "row_id", "similarity"])

    names = ["ids", "sizes", "ends", "items"]
    said = blocks["query_id"].select(F.col("least").alias("q_least"), F.col("most").alias("q_most"), *[F.col(c).alias(f"q_{c}") for c in names])
    allowed = (F.col("q_most") >= F.col("least") * least - _EPS) & (F.col("q_least") * least <= F.col("most") + _EPS)
    met = blocks["row_id"].repartition(parts).join(said.hint("shuffle_replicate_nl"), allowed).select(*[f"q_{c}" for c in names], *names)
    pairs = met.mapInArrow(run, "query_id long, row_id long, similarity double")
    if counts is not None:
        pairs = written(pairs)
        counts["candidates"] = pairs.count()
    return pairs.where(F.col("similarity") >= least).withColumn("similarity", F.round("similarity", 6))


def similar_by_grams(queries: DataFrame, rows: DataFrame, n: int, least: float, counts: dict | None = None) -> DataFrame:
    """``similar_sets`` of the distinct character n-grams of texts ``(query_id, text)`` and ``(row_id, text)``."""
    grams = ngrams(F.coalesce("text", F.lit("")), n).alias("items")
    return similar_sets(queries.select("query_id", grams), rows.select("row_id", grams), least, counts)


def template_components(texts: DataFrame, t: float = 0.4) -> DataFrame:
    """``(row_id, text, n, component)``: equal texts are one vertex, the rest are linked by ``affix_edges``."""
    rows = written(trimmed(texts))
    distinct = written(rows.groupBy("text", "n").agg(F.min("row_id").alias("row_id")))
    linked = components(affix_edges(distinct, t))
    placed = distinct.join(linked.withColumnRenamed("id", "row_id").hint("merge"), "row_id", "left")
    return rows.join(placed.select("text", F.coalesce("component", "row_id").alias("component")).hint("merge"), "text")


def template_groups(texts: DataFrame, t: float = 0.4, min_coverage: float = 0.5, size: int = 10) -> DataFrame:
    """``(row_id, component, is_grouped, slice_no, template)`` for every text that is not blank.

    A component whose common prefix and suffix cover less than ``min_coverage`` of its longest text is not a
    group. Least and greatest text (and reversed text) give the common affixes, so they are plain aggregates. Slices
    come from places along (component, row_id) over range partitions, and a large component's rows meet its shape
    in pieces, so no task has all of it.
    """
    rows = salted(numbered(template_components(texts, t), "component", "row_id"), "row_id")
    shape = rows.groupBy("component").agg(
        F.count("*").alias("m"), F.min("text").alias("lo"), F.max("text").alias("hi"), F.min(F.reverse("text")).alias("rlo"),
        F.max(F.reverse("text")).alias("rhi"), F.min("n").alias("shortest"), F.max("n").alias("longest"),
        F.min("place").alias("start"), F.collect_set("_salt").alias("salts"),
    )
    ahead = common_prefix(F.col("lo"), F.col("hi"))
    shape = shape.withColumn("ahead", ahead)
    shape = shape.withColumn("behind", F.least(common_prefix(F.col("rlo"), F.col("rhi")), F.col("shortest") - F.col("ahead")))
    covered = (F.col("ahead") + F.col("behind")) / F.col("longest")
    shape = shape.withColumn("is_grouped", (F.col("m") > 1) & (covered >= min_coverage - _EPS))
    text = F.concat(F.substring("lo", F.lit(1), F.col("ahead")), F.lit("…"), F.reverse(F.substring("rlo", F.lit(1), F.col("behind"))))
    shape = shape.select("component", "is_grouped", "start", F.explode("salts").alias("_salt"), F.when(F.col("is_grouped") & (F.col("ahead") + F.col("behind") > 0), text).otherwise("").alias("template"))
    out = rows.join(shape.hint("merge"), ["component", "_salt"]).withColumn("slice_no", F.floor((F.col("place") - F.col("start")) / size).cast("int"))
    return out.select("row_id", "component", "is_grouped", F.when(F.col("is_grouped"), F.col("slice_no")).alias("slice_no"), "template")
