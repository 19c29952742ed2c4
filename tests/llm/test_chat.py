import hashlib
import random

from tmengine.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def rows():
    rng = random.Random(4)
    pieces = ["<|turn|>", "<|end|>\n", "<|nl|>", "<\\|", "<", "|", "\\", "é", "😀", "\n", "[INST]", "</s>", "plain words "]
    out = []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
            out.append((c if c else None, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", "system", None, "od\nd<|x"]), text, "clash"))
    return out + [(7, 0, "assistant", "same", None), (7, 0, "assistant", "same", None), (99, 1, "assistant", "x" * 300_000, None)]


def expected(data):
    by = {}
    for c, t, r, x, _ in data:
        by.setdefault(c, []).append((-1 if t is None else t, (r or "").encode(), (x or "").encode()))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = b"".join(r + b"\n" + x + b"\n" for _, r, x in turns)
        learnt = b"".join(x for _, r, x in turns if r == b"assistant")
        out[c] = (len(turns), hashlib.sha256(said).hexdigest(), len(learnt.decode()), hashlib.sha256(learnt).hexdigest())
    return out


def test_reads_back_exactly_in_any_batching(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    for size, part in ((10_000, chat.PART_BYTES), (10_000, 40), (3, chat.PART_BYTES)):
        monkeypatch.setattr(chat, "PART_BYTES", part)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = chat.digests(chat.format_chats(df)).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(data)
        assert len(got) == len(expected(data))


def test_empty_table(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
