"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

The vocabulary is a file of base64 tokens and ranks. Each byte is written as one printable character, so the library
sees the ranks' tokens as strings; its merges are the two parts that a token's own bytes merge into by lower ranks. A
text is cut by the pre-tokenisation pattern, every distinct piece of a batch is encoded once by the library, and the
texts' ids are put together from the pieces. Decoding turns each token's characters back into bytes by the reversed
byte table; a character whose bytes are split over tokens is whole again once the bytes are joined, and token offsets
are those of the characters touched.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmengine.llm.common import texts

#: Distinct pieces kept encoded between batches of a task.
CACHE = 400_000

_CODECS: dict[tuple[str, str], "Codec"] = {}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        shown = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
        out.append(chr(b if shown else spare))
        spare += not shown
    return out


def merged_parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, ...]:
    """The parts that ``token`` ends in when its bytes merge, lowest rank first, by ranks below its own."""
    parts = [bytes([b]) for b in token]
    limit = ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= limit:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(parts)


class Codec:
    """Encoder and decoder of one vocabulary; one a Python worker."""

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        shown = byte_characters()
        self.characters = {b: ord(c) for b, c in enumerate(shown)}
        spell = lambda token: "".join(shown[b] for b in token)
        merges = []
        for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
            parts = merged_parts(token, ranks)
            if len(parts) == 2:
                merges.append((spell(parts[0]), spell(parts[1])))
        vocabulary = {spell(t): r for t, r in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        # for lists of distinct words: the library's own cache would only be filled, never hit
        self.spaced = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True, cache_capacity=0))
        self.spaced.pre_tokenizer = pre_tokenizers.Split(shown[32], "merged_with_next")
        self.begins = np.zeros(max(ranks.values()) + 1, bool)
        self.begins[[r for t, r in ranks.items() if t.startswith(b" ")]] = True
        byte_of = {c: b for b, c in enumerate(shown)}  # the reversed byte table
        self.bytes_of = {r: bytes(map(byte_of.__getitem__, token)) for token, r in vocabulary.items()}
        self.size_of = np.zeros(len(self.begins), np.int64)
        self.size_of[list(self.bytes_of)] = [len(t) for t in self.bytes_of.values()]
        self.name_of = {r: str(r) for r in ranks.values()}
        self.split = regex.compile(pattern, regex.V0)
        self.cache: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def of(path: str, pattern: str) -> "Codec":
        if (path, pattern) not in _CODECS:
            _CODECS[path, pattern] = Codec(path, pattern)
        return _CODECS[path, pattern]

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet, all at once."""
        new = list(pieces.difference(self.cache))
        if len(self.cache) + len(new) > CACHE:
            self.cache = {p: self.cache[p] for p in pieces if p in self.cache}
        spelt = [p.encode().decode("latin-1").translate(self.characters) for p in new]
        for piece, found in zip(new, self.tokenizer.encode_batch_fast(spelt, add_special_tokens=False)):
            self.cache[piece] = tuple(found.ids)

    def encode(self, batch: list[str]) -> Iterator[list[int]]:
        cut = [self.split.findall(t) for t in batch]
        self.learn({p for pieces in cut for p in pieces})
        known = self.cache
        for pieces in cut:
            yield list(chain.from_iterable(map(known.__getitem__, pieces)))

    def encode_words(self, words: list[bytes], block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without spaces, each written with one before it, one after another; and where each word's ids start."""
        parts = []
        for at in range(0, len(words), block):
            joined = b" " + b" ".join(words[at : at + block])
            (found,) = self.spaced.encode_batch_fast([joined.decode("latin-1").translate(self.characters)], add_special_tokens=False)
            parts.append(np.array(found.ids, np.int64))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return flat, np.flatnonzero(self.begins[flat])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: list[int], data: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and past-the-end code point that each token touches, and whether it begins inside a character."""
        ends = np.cumsum(self.size_of[np.array(ids, np.int64)], dtype=np.int64)
        data = np.frombuffer(self.decode(ids) if data is None else data, np.uint8)
        upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        split = np.zeros(len(ends), bool) if not len(ends) else (data[starts] & 0xC0) == 0x80
        return upto[starts] - split, upto[ends], split


def batches_of(texts_: Iterator[str], size: int = 1 << 21) -> Iterator[list[str]]:
    """Lists of texts of about ``size`` characters together (a longer text is alone), to bound memory."""
    held, n = [], 0
    for t in texts_:
        held.append(t)
        n += len(t) + 1
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """``(doc_id, ids)`` of every row, with ``starts`` and ``ends`` in code points if ``offsets``.

    Null text: empty, no ids. Repeated rows and null doc_ids are kept; an empty table gives no rows; other
    columns are ignored. ``path`` must be readable where the tasks run.
    """
    schema = "doc_id long, ids array<int>" + (", starts array<long>, ends array<long>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            at = 0
            for part in batches_of(t.decode() for t in texts(batch.column("text"))):
                ids = list(codec.encode(part))
                columns = {"doc_id": batch.column("doc_id").slice(at, len(part)), "ids": pa.array(ids, pa.list_(pa.int32()))}
                at += len(part)
                if offsets:
                    found = [codec.offsets(i) for i in ids]
                    columns |= {n: pa.array([f[k] for f in found], pa.list_(pa.int64())) for k, n in enumerate(("starts", "ends"))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, data)``: the bytes of every row's ids; null ids: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [codec.decode(i or []) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, n_split, n_chars)``: encoding, decoding and offsets in one pass.

    ``n_split`` tokens begin inside a character; ``n_chars`` is the last token's end in code points. Null text: as
    empty, no ids; repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            at = 0
            for part in batches_of(t.decode() for t in texts(batch.column("text"))):
                counts, written, read, split, chars = [], [], [], [], []
                for ids in codec.encode(part):
                    counts.append(len(ids))
                    written.append(hashlib.sha256(" ".join(map(codec.name_of.__getitem__, ids)).encode()).hexdigest())
                    data = codec.decode(ids)
                    read.append(hashlib.sha256(data).hexdigest())
                    _, ends, inside = codec.offsets(ids, data)
                    split.append(int(inside.sum()))
                    chars.append(int(ends[-1]) if len(ends) else 0)
                columns = [batch.column("doc_id").slice(at, len(part)), pa.array(counts, pa.int64()), pa.array(written), pa.array(read), pa.array(split, pa.int64()), pa.array(chars, pa.int64())]
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split", "n_chars"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, n_chars long")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
