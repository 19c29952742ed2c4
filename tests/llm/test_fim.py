import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tmengine.llm import fim as op


def plain(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return key, n, "spm", a, b - a, sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return key, n, "psm", a, b - a, sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def run(spark, tmp_path, rows, schema="doc_id long, text string, n long, form string"):
    path = str(tmp_path / "t")
    spark.createDataFrame([(*r, 7, "x") for r in rows], schema).write.parquet(path + "/documents.parquet")
    return sorted(map(tuple, op.op13_fill_in_middle(spark, path).collect()), key=str)


def test_matches_plain_version(spark, tmp_path):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcde äß中😀\n") for _ in range(5000))
    rows = [(i, "".join(rng.choice(["word ", "é", "中文", "😀", "\r\n", "<", "S>", "<P", ">"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(500 + i, shared[rng.randrange(900) :] + str(i)) for i in range(30)]
    rows += [(1000, None), (1001, ""), (None, "no key"), (None, None), (3, "again"), (3, "again"), (1002, shared * 60), (1003, "x" * 40_000), (1004, "中" * 20_000)]
    rows += [(2000 + i, "a" * k + m + "b" * 9) for i, (k, m) in enumerate((k, m) for k in (0, 1, 62, 63, 64, 65, 8190, 8191, 8192, 9000) for m in ("<P>", "<S>", "<M>", "<X>"))]
    got = run(spark, tmp_path, rows)
    assert got == sorted((plain(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_string_keys_and_shares(spark):
    rows = spark.createDataFrame([(f"k{i}", f"some text {i}") for i in range(2000)], "name string, body string")
    out = op.fill_in_middle(rows, "name", "body", plain_from=50, spm_below=50)
    assert out.columns == ["name", "n", "form", "prefix_chars", "middle_chars", "output"]
    forms = {r["form"]: r["count"] for r in out.groupBy("form").count().collect()}
    assert 900 < forms["plain"] < 1100 and 430 < forms["psm"] < 570
    back = out.select("name", op.restored(out["output"], out["form"]).alias("body"))
    assert back.exceptAll(rows).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab<>PSM é中😀"), max_size=600), st.integers(0, 40))
def test_chunks_are_the_text(text, times):
    data = (text * times).encode()
    parts = op.chunks(data)
    assert b"".join(parts) == data and all(parts)
    assert all(p.decode() is not None for p in parts)
    assert all(op.LEAST <= len(p) <= op.GREATEST + 3 + op.LEAST for p in parts[:-1])


def test_blocks_do_not_move_cut_points(monkeypatch):
    data = random.Random(1).randbytes(50_000)
    whole = op.cut_points(data)
    monkeypatch.setattr(op, "BLOCK", 777)
    assert op.cut_points(data).tolist() == whole.tolist() and len(whole) > 50


def test_shared_passages_are_summarised_once():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    cache = op.Summaries()
    op.transformed(("first start " + passage).encode(), "1", cache, "1", 90, 20)
    before = cache.made
    op.transformed(("another and longer start, " + passage).encode(), "2", cache, "1", 90, 20)
    assert before > 40 and cache.made - before <= 3


def test_cache_is_bounded():
    cache = op.Summaries(10_000)
    for i in range(2_000):
        cache.of(b"%d" % i * 20)
    assert len(cache.new) + len(cache.old) < 120
