import random
import uuid

from pyspark.sql import functions as F

from tmengine.functions import text as fn


def values(spark, rows, *columns):
    df = spark.createDataFrame(rows, "a string, b string, c string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_clean_cells_and_status(spark):
    rows = [(" x\t", None, None), (None, "CQA_Done ", None), ("NaN", "odd", None), ("  nan ", "Done", None)]
    got = values(spark, rows, fn.clean_cell(F.col("a")), fn.status_rank(F.col("b")), fn.status_weight(F.col("b")))
    assert got == [("x", 99, 0.85), ("", 2, 0.97), ("", 99, 0.85), ("", 4, 0.90)]


def test_memory_text_and_file_status(spark):
    rows = [("a  b\n\tc ", "x/Designer_1.sdltm", None), ("", "p/my_CQA.sdltm", None), (None, "LQA final", None), ("x", "latest.sdltm", None), ("x", "main.sdltm", None)]
    got = values(spark, rows, fn.memory_text(F.col("a")), fn.status_from_file(F.col("b")))
    assert got == [("a b c", "Designer Reviewed"), ("", "CQA_Done"), (None, "Done_LQA edited"), ("x", "Done"), ("x", None)]


def test_pair_id_is_uuid5(spark):
    space = uuid.uuid4()
    rows = [("源", "target", "Done"), ("a", "b", None), ("", "", "")] + [(f"s{i}", f"t{i}", "x") for i in range(40)]
    got = values(spark, rows, fn.pair_id(F.col("a"), F.col("b"), F.col("c"), space))
    assert [g for (g,) in got] == [str(uuid.uuid5(space, f"{a}\x1f{b}\x1f{c or ''}")) for a, b, c in rows]


def affix(a, b):
    short, long = min(len(a), len(b)), max(len(a), len(b))
    if not short:
        return 0.0
    p = next((i for i in range(short) if a[i] != b[i]), short)
    s = next((i for i in range(short) if a[-1 - i] != b[-1 - i]), short)
    return (p + min(s, short - p)) / long


def test_affix_similarity_and_ngrams(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("ab😀") for _ in range(rng.randint(0, 7))), "".join(rng.choice("ab😀") for _ in range(rng.randint(0, 7))), None) for _ in range(150)]
    got = values(spark, rows, fn.affix_similarity(F.col("a"), F.col("b")), F.array_sort(fn.ngrams(F.col("a"), 2)), fn.jaccard(fn.ngrams(F.col("a"), 2), fn.ngrams(F.col("b"), 2)))
    grams = lambda t: {t[i : i + 2] for i in range(max(1, len(t) - 1))} if t else set()
    for (a, b, _), (sim, gs, j) in zip(rows, got):
        assert abs(sim - affix(a, b)) < 1e-12 and set(gs) == grams(a)
        x, y = grams(a), grams(b)
        assert abs(j - (len(x & y) / len(x | y) if x and y else 0)) < 1e-12


def test_tokens_hash_and_keys(spark):
    rows = [("Hello, wörld 42 少侠来了 我", "  A  b ", None), (None, None, None)]
    got = values(spark, rows, fn.tokens(F.col("a")), fn.cache_key(F.col("b")), fn.token_hash(F.lit("abc")))
    assert got[0][0] == ["hello", "w", "rld", "42", "少侠", "侠来", "来了", "我"] and got[1][0] == []
    assert got[0][1] == values(spark, [("x", "a B", None)], fn.cache_key(F.col("b")))[0][0]
    assert got[0][2] == 0x90015098


def test_content_types_and_languages(spark):
    rows = [("外观描述X", "zh-en", None), (" 任务 ", "ZH_CN>fr", None), ("abc", "ja", None), (None, None, None), ("未知", "pt/xx", None)]
    first, last = fn.language_codes(F.col("b"))
    got = values(spark, rows, fn.content_type(F.col("a")), fn.language_name(first), fn.language_name(last), fn.rule_class(fn.content_type(F.col("a"))))
    assert got == [("外观", "Chinese", "English", "other"), ("任务", "Chinese", "French", "functional"), (None, None, None, "other"), (None, None, None, "other"), ("未知", "Portuguese", "xx", "other")]


def test_parsed_answers(spark):
    said = [
        ('{"translation": " Hi ", "reason": ""}', ("Hi", None)), ('{"translation": "A", "reason": "it "is" so"}', ("A", 'it "is" so')),
        ("plain", ("plain", None)), ('{"other": 1}', ('{"other": 1}', None)), ('x "translation": "B" y', ("B", None)), ("", ("", None)),
        ('{"translation": 5, "reason": null}', ("5", None)),
    ]
    got = values(spark, [(s, None, None) for s, _ in said], fn.parsed_answer(F.col("a")).alias("p"))
    assert [tuple(p) for (p,) in got] == [e for _, e in said]


def test_lenient_numbers_and_segment_text(spark):
    xml = '<S xmlns="u"><Text><Value>a </Value><Value>b</Value></Text><Tag><Anchor>9</Anchor></Tag><Text>c&amp;</Text></S>'
    got = values(spark, [("1.5", xml, None), ("x", "<a/>", None), (None, None, None)], fn.lenient_double(F.col("a")), fn.segment_text(F.col("b")))
    assert got == [(1.5, "a bc&"), (None, ""), (None, None)]
