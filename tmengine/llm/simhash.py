"""SimHash near-dedup by anchor-point covering.

A fingerprint's 64 bits are read as two halves of 32. If two fingerprints differ in at most d bits, one of the
halves differs in at most d // 2. In that half the anchors are the words of a covering code: the perfect binary
Golay code on 23 bits (radius 3), the perfect Hamming code on 7 bits (radius 1) and all patterns of the last 2
(radius 0). Every half lies within the radius of its home anchor, and within radius plus d // 2 of the home anchor
of any half that near. So each fingerprint goes once to its home anchor and, as a replica, to every anchor within
radius plus threshold; at an anchor, replicas are compared with the fingerprints at home there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmengine.llm.common import BROADCAST_ROWS, LOWER_AZ, components, discard, materialize, partitions_for, salted, texts, with_minimum
from tmengine.tables import forget_shuffles

#: Generator polynomials of the binary Golay code (x^11 + x^9 + x^7 + x^6 + x^5 + x + 1) and of the Hamming code (x^3 + x + 1).
GOLAY, HAMMING = 0b101011100011, 0b1011

#: Replicas of one anchor are spread over so many tasks, each with a copy of the anchor's home fingerprints.
SALTS = 8

#: Columns of the bits that sort out far pairs in the stage's form.
VERDICT = ["fp", "fp2", "fp3", "fp4"]

#: Sketches of the stage's form and the shingle minima in each; at Jaccard 0.8 a pair shares no sketch once in about 2,800.
BANDS, ROWS = 20, 5

#: Rounds that decide neighbours in a bucket before all pairs that are left.
TURNS = 2

#: Buckets of up to so many rows give their pairs; rows of larger ones are compared in blocks of about BLOCK sets inside tasks.
PAIRED, BLOCK = 64, 256

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


# --- fingerprints -------------------------------------------------------------------------------------------------


def word_spans(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of ``data`` joined by single spaces, with each word's start and end in that string."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    before = np.concatenate([[True], space[:-1]]) if len(raw) else space
    keep = ~(space & before)  # the first of each run of spaces separates; leading ones go
    joined = np.where(space, np.uint8(32), raw)[keep]
    if len(joined) and joined[-1] == 32:
        joined = joined[:-1]
    gaps = np.flatnonzero(joined == 32)
    if not len(joined):
        return b"", gaps, gaps
    return joined.tobytes(), np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])


def shingle_hashes(data: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words (the whole text if it has fewer; nothing if it has none)."""
    joined, starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(starts) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    spans = zip(starts[: len(starts) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(joined[a:z], seed) for a, z in spans], np.uint64)


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each array: a bit is 1 if it is set in over half the hashes; no hashes: 0."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    at, block = 0, 1 << 17
    while at < len(hashes):
        upto, held = at, 0
        while upto < len(hashes) and (upto == at or held + sizes[upto] <= block):
            held += sizes[upto]
            upto += 1
        counts = np.zeros((upto - at, 64), np.int64)
        if upto - at == 1:  # a long text, in blocks
            for k in range(0, held, block):
                part = hashes[at][k : k + block]
                counts[0] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            full = np.flatnonzero(sizes[at:upto])
            if len(full):
                bits = np.unpackbits(np.concatenate(hashes[at:upto]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                first = np.concatenate([[0], np.cumsum(sizes[at:upto][full])[:-1]])
                counts[full] = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        out[at:upto] = ((2 * counts > sizes[at:upto, None]) * weights).sum(1, dtype=np.uint64)
        at = upto
    return out


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of every row: the SimHash of its ``width``-word shingles, repeats counted, as a signed long.

    Only the letters A-Z are lower-cased. Null text: no words, fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingle_hashes(t.translate(LOWER_AZ), width) for t in texts(part.column("text"))]
                columns = [part.column("doc_id"), pa.array(majority_bits(found).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def mixed(h: np.ndarray) -> np.ndarray:
    """Independent bits from 64-bit hashes (a multiply-xorshift bijection)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_FLIPS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_FACTORS = mixed(_FLIPS) | np.uint64(1)


# --- anchors ------------------------------------------------------------------------------------------------------


def remainders(n: int, generator: int) -> np.ndarray:
    """The syndrome of every n-bit pattern: its remainder modulo the generator polynomial."""
    degree = generator.bit_length() - 1
    out = np.arange(1 << n, dtype=np.int64)
    for bit in range(n - 1, degree - 1, -1):
        out = np.where((out >> bit) & 1, out ^ (generator << (bit - degree)), out)
    return out


def errors_by_syndrome(n: int, generator: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each syndrome, the error patterns of at most ``most`` bits that have it, and their weights."""
    patterns = np.flatnonzero(np.bitwise_count(np.arange(1 << n, dtype=np.uint32)) <= most)
    left = remainders(n, generator)[patterns]
    order = np.argsort(left, kind="stable")
    patterns, left = patterns[order], left[order]
    cuts = np.searchsorted(left, np.arange((1 << (generator.bit_length() - 1)) + 1))
    return [(patterns[a:z], np.bitwise_count(patterns[a:z].astype(np.uint32)).astype(int)) for a, z in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=4)
def covering(threshold: int) -> dict[str, np.ndarray]:
    """Tables that list the anchors of a half within radius plus ``threshold``.

    Rows of ``flips`` between ``first[s]`` and ``first[s + 1]`` turn a half with joint syndrome s into its
    anchors; ``beyond`` is how far each lies past the radii. The row with nothing beyond is the home anchor.
    """
    golay, hamming = errors_by_syndrome(23, GOLAY, 3 + threshold), errors_by_syndrome(7, HAMMING, 1 + threshold)
    rest = np.arange(4)
    flips, beyond, first = [], [], [0]
    for g, gw in golay:
        g_over = np.maximum(gw - 3, 0)
        for h, hw in hamming:
            over = g_over[:, None, None] + np.maximum(hw - 1, 0)[None, :, None] + np.bitwise_count(rest.astype(np.uint32))[None, None, :]
            flip = g[:, None, None] | (h[None, :, None] << 23) | (rest[None, None, :] << 30)
            near = over <= threshold
            flips.append(flip[near])
            beyond.append(over[near].astype(np.int8))
            first.append(first[-1] + int(near.sum()))
    out = {"flips": np.concatenate(flips).astype(np.int64), "beyond": np.concatenate(beyond), "first": np.array(first, np.int64)}
    return out | {"golay": remainders(23, GOLAY).astype(np.int32), "hamming": remainders(7, HAMMING).astype(np.int32)}


def anchors(halves: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 32-bit patterns: (index of the pattern, anchor, is it the home anchor) of every anchor in reach."""
    table = covering(threshold)
    x = halves.astype(np.int64)
    s = table["golay"][x & 0x7FFFFF].astype(np.int64) * 8 + table["hamming"][(x >> 23) & 0x7F]
    a, n = table["first"][s], table["first"][s + 1] - table["first"][s]
    who = np.repeat(np.arange(len(x)), n)
    rows = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    return who, x[who] ^ table["flips"][rows], table["beyond"][rows] == 0


def replicas(fps: DataFrame, column: str, payload: list[str], distance: int, salts: int = SALTS) -> DataFrame:
    """``(anchor, home, *payload)``: every row at its home anchors and at all anchors in reach, for both halves.

    The anchor key holds the half, the code word and the salt: a replica has one salt, a home row all of them.
    """
    threshold = distance // 2
    fields = {f.name: f.dataType.simpleString() for f in fps.schema.fields}
    schema = "anchor long, home boolean, " + ", ".join(f"{c} {fields[c]}" for c in payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fp = part.column(column).to_numpy(zero_copy_only=False).view(np.uint64)
                salt = (mixed(fp) % np.uint64(salts)).astype(np.int64)
                for half in (0, 1):
                    who, anchor, home = anchors((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF), threshold)
                    key = ((anchor << 1) | half) * salts
                    at_home = np.repeat(np.flatnonzero(home), salts)
                    who_all = np.concatenate([who, who[at_home]])
                    keys = np.concatenate([key + salt[who], key[at_home] + np.tile(np.arange(salts), int(home.sum()))])
                    flags = np.concatenate([np.zeros(len(who), bool), np.ones(len(at_home), bool)])
                    columns = [part.column(c).take(pa.array(who_all)) for c in payload]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(flags), *columns], names=["anchor", "home", *payload])

    return fps.mapInArrow(run, schema)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of 64-bit patterns held as longs."""
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


class _Links:
    """Joins the ends of links and says which links were needed to connect them."""

    def __init__(self) -> None:
        self.top: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = self.top
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.top[max(a, b)] = min(a, b)
        return a != b


def compare(placed: DataFrame, near, key: str, payload: list[str]) -> DataFrame:
    """Links ``(a, b)`` of the keys of rows that meet at an anchor and are near, without the links that close a cycle there.

    Rows come sorted by anchor, home rows first, so an anchor's home rows are held and its replicas stream past
    in blocks; what leaves an anchor is a forest, at most one link a row, whatever the size of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        anchor_now, links = None, _Links()
        for batch in batches:
            anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
            home = batch.column("home").to_numpy(zero_copy_only=False)
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in payload}
            n = len(anchor)
            if not n:
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1, [n]])
            n_home = np.add.reduceat(home, cuts[:-1], dtype=np.int64)
            carried = anchor_now is not None and anchor[0] == anchor_now
            out: list[tuple[int, int]] = []
            # all anchors but those that began in an earlier batch, at once
            own = np.flatnonzero((n_home > 0) & (np.diff(cuts) > n_home) & ~(carried & (np.arange(len(n_home)) == 0)))
            for a, b, g in pairs_within(cuts[own], n_home[own], cuts[own + 1], own):
                ok = near({c: v[a] for c, v in cols.items()}, {c: v[b] for c, v in cols.items()})
                a, b, g = cols[key][a[ok]], cols[key][b[ok]], g[ok]
                out += forest(a, b, g)
            if carried:
                new_home = home[: cuts[1]]
                for c in payload:
                    held[c] = np.concatenate([held[c], cols[c][: cuts[1]][new_home]])
                rest = {c: cols[c][: cuts[1]][~new_home] for c in payload}
                for a, b, _ in pairs_within(np.array([0]), np.array([len(held[key])]), np.array([len(held[key]) + len(rest[key])]), np.array([0])):
                    b = b - len(held[key])
                    ok = near({c: held[c][a] for c in payload}, {c: rest[c][b] for c in payload})
                    out += [(x, y) for x, y in zip(held[key][a[ok]].tolist(), rest[key][b[ok]].tolist()) if x != y and links.join(x, y)]
            if not carried or len(cuts) > 2:
                last = slice(cuts[-2], n)
                anchor_now, links = anchor[-1], _Links()
                held = {c: cols[c][last][home[last]] for c in payload}
            if out:
                ends = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    spread = placed.repartition(partitions_for(placed), "anchor").sortWithinPartitions("anchor", F.col("home").desc())
    return spread.mapInArrow(run, "a long, b long").distinct()


def pairs_within(start: np.ndarray, n_home: np.ndarray, stop: np.ndarray, group: np.ndarray, block: int = 1 << 20) -> Iterator[tuple]:
    """Indices (home row, replica row, group) of all pairs of each group, in blocks of bounded size."""
    work = n_home * (stop - start - n_home)
    at = 0
    while at < len(start):
        total, upto = 0, at
        while upto < len(start) and (upto == at or total + work[upto] <= block):
            total += int(work[upto])
            upto += 1
        if upto - at == 1 and total > block:
            s, h, z = int(start[at]), int(n_home[at]), int(stop[at])
            step = max(1, block // h)
            for k in range(s + h, z, step):
                b = np.arange(k, min(z, k + step))
                for j in range(s, s + h, block):
                    a = np.arange(j, min(s + h, j + block))
                    yield np.repeat(a, len(b)), np.tile(b, len(a)), np.full(len(a) * len(b), group[at])
        else:
            h, r = n_home[at:upto], stop[at:upto] - start[at:upto] - n_home[at:upto]
            which = np.repeat(np.arange(at, upto), work[at:upto])
            nth = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(work[at:upto])[:-1]]), work[at:upto])
            width = np.repeat(r, work[at:upto])
            yield start[which] + nth // width, start[which] + n_home[which] + nth % width, group[which]
        at = upto


def forest(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """The links that connect each group's ends, leaving out those that close a cycle."""
    out, links, now = [], _Links(), None
    for x, y, g in zip(a.tolist(), b.tolist(), group.tolist()):
        if x == y:
            continue
        if g != now:
            links, now = _Links(), g
        if links.join(x, y):
            out.append((x, y))
    return out


# --- sketches for the stage's form --------------------------------------------------------------------------------


def sketch(shingles: np.ndarray, block: int = 1 << 12) -> np.ndarray:
    """One key for each of ``BANDS`` sketches of a set of shingle hashes: a hash of its ``ROWS`` minima under mixings of their own."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), block):
        np.minimum(least, ((shingles[at : at + block, None] ^ _FLIPS) * _FACTORS).min(0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = mixed(out ^ row) * np.uint64(0xD6E8FEB86659FD93)
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``(body, n, fp, fp2, fp3, fp4, bands)`` of every row: distinct shingles, 256 SimHash bits of them, sketch keys."""
    schema = "body long, n int, " + ", ".join(f"{c} long" for c in VERDICT) + ", bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingle_hashes(t.translate(LOWER_AZ), width) for t in texts(part.column("text"))]
                sets = [np.unique(h) for h in found]
                bits, left = [majority_bits(sets)], sets
                for _ in VERDICT[1:]:
                    left = [mixed(h) for h in left]
                    bits.append(majority_bits(left))
                keys = pa.array(np.concatenate([sketch(x) for x in sets]).view(np.int64))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), keys)
                sizes = pa.array(np.array([len(x) for x in sets], np.int32))
                columns = [part.column("body"), sizes, *(pa.array(b.view(np.int64)) for b in bits), bands]
                yield pa.RecordBatch.from_arrays(columns, names=["body", "n", *VERDICT, "bands"])

    return docs.select("body", "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(body, shingles)`` of every row: the sorted distinct shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [np.unique(shingle_hashes(t.translate(LOWER_AZ), width)).tobytes() for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("body"), pa.array(sets, pa.binary())], names=["body", "shingles"])

    return docs.select("body", "text").mapInArrow(run, "body long, shingles binary")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b, ...)`` whose shingle sets have a Jaccard similarity of 0.8 or more; two empty sets are alike."""
    columns = pairs.columns
    schema = ", ".join(f"{c} long" for c in columns)
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("body").alias(side), F.col("shingles").alias(f"of_{side}")).hint("merge"), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("of_a"), batch.column("of_b"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 5 * both >= 4 * (len(x) + len(y) - both)
            yield batch.select(columns).filter(pa.array(ok))

    return pairs.select(*columns, "of_a", "of_b").mapInArrow(run, schema)


def next_in_bucket(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs of rows that follow each other in a bucket, in one of two orders by the bucket's key.

    Rows are range-partitioned by bucket and order, so a large bucket is spread; the pair over each cut between
    partitions is left out. No body gets more than two pairs a bucket.
    """
    columns = ["key", "body", "component", "n", *VERDICT]
    laid = placed.select(*columns, F.xxhash64("body", F.lit(turn), F.pmod("key", F.lit(2))).alias("turn"))
    laid = laid.repartitionByRange(partitions_for(placed), "key", "turn").sortWithinPartitions("key", "turn", "body")
    names = [f"{side}_{c}" for side in "xy" for c in columns[1:]]
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = ", ".join(f"{n} {kinds[n[2:]]}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(columns)
            if last is not None:
                rows = pa.concat_tables([last, rows])
            rows = rows.combine_chunks()
            last = rows.slice(max(0, rows.num_rows - 1))
            key, part = (rows.column(c).to_numpy() for c in ("key", "component"))
            at = np.flatnonzero((key[1:] == key[:-1]) & (part[1:] != part[:-1]))
            if len(at):
                x, y = (rows.take(pa.array(k)).select(columns[1:]) for k in (at, at + 1))
                yield from pa.Table.from_arrays([*x.columns, *y.columns], names=names).combine_chunks().to_batches()

    return laid.mapInArrow(run, schema)


def all_in_bucket(placed: DataFrame) -> DataFrame:
    """All pairs of a bucket's rows whose components differ: what is outside its most common component against all of it."""
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("rows"))
    top = sizes.groupBy("key").agg(F.max(F.struct("rows", "component"))["component"].alias("top"))
    marked = placed.join(top.hint("merge"), "key")
    columns = ["body", "component", "n", *VERDICT]
    x = marked.where("component <> top").select("key", *[F.col(c).alias(f"x_{c}") for c in columns])
    y = marked.select("key", (F.col("component") == F.col("top")).alias("_in_top"), *[F.col(c).alias(f"y_{c}") for c in columns])
    pairs = x.hint("merge").join(y, "key").where((F.col("x_component") != F.col("y_component")) & (F.col("_in_top") | (F.col("x_body") < F.col("y_body"))))
    return pairs.drop("key", "_in_top")


def common_shingles(one: list[np.ndarray], two: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of each of the first sets with each of the second, a stretch of the joint shingles at a time."""
    names, column = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    owner = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    out = np.zeros((len(one), len(two)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, len(names) + width, width))
    for a, z in zip(cuts, cuts[1:]):
        has = np.zeros((len(one) + len(two), width), np.float32)
        has[owner[a:z], column[a:z] % width] = 1
        out += has[: len(one)] @ has[len(one) :].T
    return out.astype(np.int64)


def alike_in_blocks(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of components that a link joins among rows ``(key, body, component)`` of large buckets.

    Bodies that share large buckets are one cluster, cut into blocks; every two blocks of a cluster meet in a piece,
    with their shingle sets, and each pair of different components is decided there. A piece gives a forest of components.
    """
    least = placed.groupBy("key").agg(F.min("body").alias("b"))
    stars = placed.select("key", F.col("body").alias("a")).join(least.hint("merge"), "key").select("a", "b")
    cluster = components(stars).select(F.col("id").alias("body"), F.col("component").alias("cluster"))
    rows = placed.select("body", "component").distinct().join(cluster.hint("merge"), "body")
    rows = salted(materialize(rows), "body")
    sizes = rows.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.collect_set("_salt").alias("_salts"))
    sizes = sizes.select("cluster", "blocks", F.explode("_salts").alias("_salt"))
    rows = rows.join(sizes.hint("merge"), ["cluster", "_salt"]).join(sets.hint("merge"), "body")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("body"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "body", "component", "shingles")
    piece = ["cluster", "low", "high"]
    laid = rows.repartition(partitions_for(rows), *piece).sortWithinPartitions(*piece, "body")

    def found(table: pa.Table) -> np.ndarray:
        block, part = (table.column(c).to_numpy() for c in ("block", "component"))
        own = np.array([np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("shingles")], object)
        inner = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        x, y = (np.arange(len(block)),) * 2 if inner else (np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min()))
        if not len(x) or not len(y):
            return np.zeros((0, 2), np.int64)
        size = np.array([len(v) for v in own])
        both = common_shingles(list(own[x]), list(own[y]))
        near = (5 * both >= 4 * (size[x][:, None] + size[y][None, :] - both)) & (part[x][:, None] != part[y][None, :])
        i, j = np.nonzero(np.triu(near, 1) if inner else near)
        links = _Links()
        keep = [links.join(int(a), int(b)) for a, b in zip(part[x[i]], part[y[j]])]
        return np.column_stack([part[x[i]], part[y[j]]])[np.array(keep, bool)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def out(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends = found(pa.Table.from_batches(parts).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(1) if len(ends) else ends[:, 0]), pa.array(ends.max(1) if len(ends) else ends[:, 1])], names=["u", "v"])

        for batch in batches:
            names = [batch.column(c).to_numpy(zero_copy_only=False) for c in piece]
            cuts = [0, *(np.flatnonzero(np.any([np.diff(v) != 0 for v in names], axis=0)) + 1).tolist(), batch.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                part = batch.slice(a, z - a)
                if rest and part.num_rows and any(rest[-1].column(c)[0] != part.column(c)[0] for c in piece):
                    yield from out(rest)
                    rest = []
                rest += [part] if part.num_rows else []
        if rest:
            yield from out(rest)

    return laid.mapInArrow(run, "u long, v long").distinct()


def merged(linked: DataFrame, joined: DataFrame) -> DataFrame:
    """``linked(id, component)`` after links ``joined(u, v)`` between its components, or bodies that are in none yet.

    Only these few links take rounds; what is linked already only learns its component's new name.
    """
    moved = materialize(components(joined.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    new = moved.select(F.col("id").alias("_old"), F.col("component").alias("_new"))
    new = F.broadcast(new) if moved.count() <= BROADCAST_ROWS else new.hint("merge")
    renamed = linked.join(new, F.col("component") == F.col("_old"), "left").select("id", F.coalesce("_new", "component").alias("component"))
    out = materialize(renamed.union(moved).distinct())  # a component's own row is in both
    discard(moved)
    return out


# --- operators ----------------------------------------------------------------------------------------------------


def simhash_components(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row: near-duplicates by SimHash.

    Fingerprints that differ in at most ``distance`` bits are linked; component_id is the smallest doc_id
    reachable over links. Equal fingerprints are one vertex, so groups of copies are neither paired nor
    compared. Null and empty texts have fingerprint 0 and are linked like any other. A null doc_id is kept
    and never becomes a component's id unless no other is in it; repeated rows and ids are kept; an empty
    table gives no rows; other columns are ignored.
    """
    rows = salted(materialize(fingerprints(docs, width)), "doc_id")
    points = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.collect_set("_salt").alias("salts")))
    placed = replicas(points.select("fp"), "fp", ["fp"], distance)

    def near(x: dict, y: dict) -> np.ndarray:
        return differing(x["fp"], y["fp"]) <= distance

    linked = components(compare(placed, near, "fp", ["fp"]))
    named = points.join(linked.hint("merge"), F.col("fp") == F.col("id"), "left")
    named = with_minimum(named.select("fp", "least", "salts", F.coalesce("component", "fp").alias("group")), "group", "least", "fp", "component_id")
    named = materialize(named.select("fp", "component_id", F.explode("salts").alias("_salt")))
    return rows.join(named.hint("merge"), ["fp", "_salt"]).select("doc_id", "fp", "component_id")


def simhash_pairs(bodies: DataFrame, distance: int) -> DataFrame:
    """Pairs ``(a, b)`` of ``(body, fp)`` that the covering links: equal fingerprints, and those that differ in at most ``distance`` bits.

    An anchor gives a forest, and bodies of one fingerprint a star at the least of them.
    """
    points = materialize(bodies.groupBy("fp").agg(F.min("body").alias("least")))

    def near(x: dict, y: dict) -> np.ndarray:
        return differing(x["fp"], y["fp"]) <= distance

    links = compare(replicas(points.select("fp"), "fp", ["fp"], distance), near, "fp", ["fp"])
    for side in "ab":
        links = links.join(points.select(F.col("fp").alias(side), F.col("least").alias(f"of_{side}")).hint("merge"), side)
    same = bodies.select("body", "fp").join(points.hint("merge"), "fp").where("body <> least")
    pairs = links.select("of_a", "of_b").union(same.select("body", "least"))
    return pairs.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, bits: int = 76, distance: int = 4) -> DataFrame:
    """``(doc_id, body, group, component_id)`` of every row: texts whose sets of shingles have a Jaccard similarity of 0.8 or more are linked.

    SimHashes of the sets meet at the anchors of the covering, as in ``simhash_components``, and the sets of those that differ
    in at most ``distance`` bits decide. At Jaccard similarity 0.8 two SimHashes differ in about 15 % of their bits, too many
    to cover. So for what is left apart, candidates share one of ``BANDS`` sketches of ``ROWS`` shingle minima, which at similarity s has
    the chance 1 - (1 - s^ROWS)^BANDS whatever the edit. Sizes and the sets' 256 bits sort out far pairs (more
    than ``bits`` differ, 6 deviations above the mean at 0.8), and the sets themselves decide on every other.
    ``body`` is the text's 64-bit hash: equal texts are one vertex. ``group`` is the component's least body;
    component_id is its least doc_id, which two components share if an id is repeated.

    Pairs that follow each other in a bucket are decided first, in up to ``TURNS`` rounds, so that a large group
    of copies is connected by few pairs a body; then all pairs left between different components, so that a pair
    that fails hides no other: those of small buckets one by one, those of large ones in blocks inside tasks.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"), F.col("text").cast("string").alias("text"))
    ids = salted(materialize(keyed.select("doc_id", "body")), "doc_id")
    made = ["n", *VERDICT, "bands"]
    bodies = materialize(sketches(keyed, width).groupBy("body").agg(*[F.first(c).alias(c) for c in made]))
    placed = bodies.select("body", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    buckets = placed.join(shared.hint("merge"), "key", "left_semi")
    buckets = materialize(buckets.join(bodies.drop("bands").hint("merge"), "body"))
    forget_shuffles(docs.sparkSession)
    close = materialize(simhash_pairs(bodies, distance))
    forget_shuffles(docs.sparkSession)
    asked = buckets.select("body").union(close.select("a")).union(close.select("b")).distinct()
    wanted = keyed.join(asked.hint("merge"), "body", "left_semi")
    sets = materialize(shingle_sets(wanted.groupBy("body").agg(F.first("text").alias("text")), width))

    def candidates(pairs: DataFrame) -> DataFrame:
        differ = sum((F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in VERDICT), F.lit(0))
        pairs = pairs.where((F.least("x_n", "y_n") * 5 >= F.greatest("x_n", "y_n") * 4) & (differ <= bits))
        ends = [f("x_" + c, "y_" + c).alias(name) for c, names in (("body", "ab"), ("component", "uv")) for f, name in zip((F.least, F.greatest), names)]
        return pairs.select(*ends).distinct()

    def apart(linked: DataFrame) -> DataFrame:
        """The rows of buckets that hold more than one component."""
        rows = buckets.join(linked.hint("merge"), F.col("body") == F.col("id"), "left").withColumn("component", F.coalesce("component", "body")).drop("id")
        mixed_up = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        return materialize(rows.join(mixed_up.hint("merge"), "key", "left_semi"))

    tried, links = close, materialize(alike(close, sets))
    forget_shuffles(docs.sparkSession)
    linked = materialize(components(links))
    used = [buckets, sets, close, links]
    for turn in range(TURNS + 1):
        rows = apart(linked)
        used += [rows]
        joined = None
        if turn == TURNS:
            large = materialize(rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > PAIRED).select("key"))
            used += [large]
            if not large.isEmpty():
                joined = materialize(alike_in_blocks(rows.join(large.hint("merge"), "key", "left_semi"), sets))
                used += [joined]
                rows = rows.join(large.hint("merge"), "key", "left_anti")
        pairs = candidates(next_in_bucket(rows, turn) if turn < TURNS else all_in_bucket(rows))
        pairs = materialize(pairs.join(tried.hint("merge"), ["a", "b"], "left_anti"))
        tried = tried.union(pairs.select("a", "b"))
        found = materialize(alike(pairs, sets))
        used += [pairs, found]
        joined = found.select("u", "v") if joined is None else joined.union(found.select("u", "v"))
        forget_shuffles(docs.sparkSession)
        if not joined.isEmpty():
            used += [linked]
            linked = merged(linked, joined)
    least = ids.groupBy("body").agg(F.min("doc_id").alias("least"), F.collect_set("_salt").alias("salts"))
    named = least.join(linked.hint("merge"), F.col("body") == F.col("id"), "left")
    named = with_minimum(named.select("body", "least", "salts", F.coalesce("component", "body").alias("group")), "group", "least", "body", "component_id")
    named = materialize(named.select("body", "group", "component_id", F.explode("salts").alias("_salt")))
    for table in (bodies, *used, linked):
        discard(table)
    return ids.join(named.hint("merge"), ["body", "_salt"]).select("doc_id", "body", "group", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
