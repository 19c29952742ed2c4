import base64
import random

import public_tokenizers
import tiktoken

from tmengine.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(8)
    out = ["", None, "<|endoftext|>", "日本語😀👩‍👩‍👧 é", "  \n\n x", "don't I'LL", "a" * 4000, " \x1c\x85 x", "x " * 50_000]
    return out + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x1F300, 0x1FAFF), 10, 32])) for _ in range(50)) for _ in range(300)]


def test_ids_offsets_and_decoding(spark):
    want = odd_texts()
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(want)] + [(None, "null id", 5), (3, "twice", 5)], "doc_id long, text string, ids int")
    other = reference()
    encoded = bpe.encode(df, PATH, PATTERN, offsets=True)
    rows = [r for r in encoded.collect() if r.doc_id is not None and (r.doc_id != 3 or len(r.ids) > 1)]
    for r in rows:
        text = want[r.doc_id] or ""
        if r.doc_id == 3:
            continue
        assert r.ids == other.encode_ordinary(text)
        at = 0
        for i, a, z in zip(r.ids, r.starts, r.ends):
            n = len(other.decode_single_token_bytes(i))
            assert len(text.encode()[: at + n].decode(errors="ignore")) <= z <= len(text) and len(text[:a].encode()) <= at
            at += n
    data = {r.doc_id: bytes(r.data) for r in bpe.decode(encoded.where("doc_id <> 3"), PATH, PATTERN).collect()}
    assert all(data[i] == (t or "").encode() for i, t in enumerate(want) if i != 3)


def test_digests_tell_split_characters(spark):
    want = [t or "" for t in odd_texts()]
    other = reference()
    got = {r.doc_id: r for r in bpe.token_digests(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string"), PATH, PATTERN).collect()}
    for i, text in enumerate(want):
        tokens = [other.decode_single_token_bytes(t) for t in other.encode_ordinary(text)]
        assert got[i].n_split == sum(0x80 <= t[0] < 0xC0 for t in tokens) and got[i].n_chars == len(text) and got[i].n_tokens == len(tokens)
    assert any(got[i].n_split for i in got)


def test_small_cache_and_empty_table(spark, monkeypatch):
    codec = bpe.Codec(PATH, PATTERN)
    monkeypatch.setattr(bpe, "CACHE", 20)
    other = reference()
    for text in (t or "" for t in odd_texts()[:60]):
        assert list(codec.encode([text]))[0] == other.encode_ordinary(text)
    assert bpe.token_digests(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0
