"""Fill-in-middle transformation with content-defined chunk memoization.

A rolling hash over the last ``WINDOW`` bytes cuts a text into chunks wherever its value meets a mask, so texts that
share a passage share its chunks. A chunk's boundary summary (code points, whether a mark lies inside, first and last
bytes) is kept in a cache under the chunk's own bytes, which a hit is compared with. Summaries combine from left
to right: their counts give the text's length and find the chunk that holds a cut, their ends tell marks that lie across
two chunks. Only the chunk with the cut is looked into.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmengine.llm.common import texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of the rolling hash's window, bits of the mask (a cut every 512 bytes or so), least and greatest chunk.
WINDOW, MASK, LEAST, GREATEST = 16, 511, 64, 8_192
#: Bytes that are hashed at once, that a worker keeps in either generation of its cache, and that make an output batch.
BLOCK, CACHE_BYTES, OUT_BYTES = 1 << 20, 16 << 20, 16 << 20
_CONTINUES = bytes(range(0x80, 0xC0))
_GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cut_points(data: bytes) -> np.ndarray:
    """Places after which the rolling hash of the last ``WINDOW`` bytes meets the mask; they depend on those bytes alone."""
    found = []
    for at in range(0, len(data), BLOCK):
        part = np.frombuffer(data, np.uint8, min(len(data) - at, BLOCK + WINDOW - 1), at)
        if len(part) < WINDOW:
            break
        gear, n = _GEAR[part], len(part) - WINDOW + 1
        rolled = np.zeros(n, np.uint32)
        for k in range(WINDOW):
            rolled ^= np.left_shift(gear[k : k + n], np.uint32(WINDOW - 1 - k))
        found.append(np.flatnonzero((rolled >> np.uint32(7)) & np.uint32(MASK) == MASK) + at + WINDOW)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunks(data: bytes) -> list[bytes]:
    """``data`` in chunks that end at cut points, between ``LEAST`` and ``GREATEST`` bytes (the last may be shorter).

    A cut moves up to the next byte that starts a character, so no character is split.
    """
    out, start = [], 0

    def take(end: int) -> None:
        nonlocal start
        while end < len(data) and 0x80 <= data[end] < 0xC0:
            end += 1
        if end > start:
            out.append(data[start:end])
            start = end

    for cut in cut_points(data).tolist():
        while cut - start > GREATEST:
            take(start + GREATEST)
        if cut - start >= LEAST:
            take(cut)
    while len(data) - start > GREATEST:
        take(start + GREATEST)
    take(len(data))
    return out


class Summaries:
    """Boundary summaries of chunks, kept in two generations of bounded size; a dropped one is made again."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.size, self.new, self.old, self.made = limit, 0, {}, {}, 0

    def of(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        """Code points, whether a mark lies inside, the first and the last two bytes."""
        known = self.new.get(chunk)
        if known is not None:
            return known
        known = self.old.get(chunk)
        if known is None:
            marked = PREFIX in chunk or SUFFIX in chunk or MIDDLE in chunk
            known = (len(chunk.translate(None, _CONTINUES)), marked, chunk[:2], chunk[-2:])
            self.made += 1
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[chunk] = known
        self.size += len(chunk) + 200
        return known


def byte_of(chunk: bytes, points: int) -> int:
    """The byte at which code point number ``points`` of a chunk begins."""
    if not points:
        return 0
    starts = np.flatnonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)
    return int(starts[points]) if points < len(starts) else len(chunk)


def transformed(data: bytes, name: str, cache: Summaries, seed: str, plain_from: int, spm_below: int) -> tuple:
    """``(n, form, prefix code points, middle code points, pieces of the output)`` of one text."""
    parts = chunks(data)
    made = [cache.of(c) for c in parts]
    ends = np.cumsum([0, *(m[0] for m in made)])
    n, marked, carry = int(ends[-1]), False, b""
    for _, inside, head, tail in made:
        seam = carry + head
        marked = marked or inside or PREFIX in seam or SUFFIX in seam or MIDDLE in seam
        carry = (carry + tail)[-2:]
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not n or marked or h3 % 100 >= plain_from:
        return n, "plain", None, None, [data]
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    sizes = np.cumsum([0, *map(len, parts)])
    at = []
    for cut in (a, b):
        k = min(int(np.searchsorted(ends, cut, "right")) - 1, len(parts) - 1)
        at.append(int(sizes[k]) + byte_of(parts[k], cut - int(ends[k])))
    prefix, middle, suffix = data[: at[0]], data[at[0] : at[1]], data[at[1] :]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]
    return n, "psm", a, b - a, [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``(key, n, form, prefix_chars, middle_chars, output)``: each text cut at two places and set out for infilling.

    Cuts and form come from the sha256 of ``seed``, a colon and the key, so a document is always cut alike. Texts
    with one of the marks in them, empty and null ones stay plain, with null cuts. A null key hashes as an empty one.
    Rows are independent: repeated rows give equal rows, an empty table none, other columns are dropped.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_name"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Summaries()

        def batch_of(keys: pa.Array, out: list) -> pa.RecordBatch:
            n, form, ahead, middle, output = zip(*out)
            arrays = [keys, pa.array(n, pa.int64()), pa.array(form), pa.array(ahead, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["_key", "n", "form", "prefix_chars", "middle_chars", "output"])

        for batch in batches:
            keys, names = batch.column(0), batch.column(1).to_pylist()
            out, start, size = [], 0, 0
            for i, data in enumerate(texts(batch.column(2))):
                *head, pieces = transformed(data, names[i], cache, seed, plain_from, spm_below)
                out.append((*head, b"".join(pieces)))
                size += len(data)
                if size > OUT_BYTES:
                    yield batch_of(keys.slice(start, len(out)), out)
                    out, start, size = [], i + 1, 0
            if out:
                yield batch_of(keys.slice(start, len(out)), out)

    kind = rows.schema["_key"].dataType.simpleString()
    made = rows.mapInArrow(run, f"_key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("_key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: a mark cannot begin earlier than where it was put."""
    first, second = F.lit(PREFIX.decode()), F.lit(SUFFIX.decode())
    last = F.lit(MIDDLE.decode())
    rest = F.substring(output, F.lit(4), F.length(output))

    def split(x: Column, mark: Column) -> tuple[Column, Column]:
        at = F.position(mark, x)
        return F.substring(x, F.lit(1), at - 1), F.substring(x, at + 3, F.length(x))

    ahead, more = split(rest, second)
    psm_suffix, psm_middle = split(more, last)
    behind, more = split(rest, first)
    spm_prefix, spm_middle = split(more, last)
    return F.when(form == "psm", F.concat(ahead, psm_middle, psm_suffix)).when(form == "spm", F.concat(spm_prefix, spm_middle, behind)).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: ``op13_fill_in_middle`` in DuckDB over the same table.
OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, left(t, least(x, y)) AS p, substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m, substr(t, greatest(x, y) + 1) AS s FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(x, y) - least(x, y) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c
"""
