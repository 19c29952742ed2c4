import random

import numpy as np
import pandas as pd

from tmengine.operators import glossary

SCHEMA = "row_id long, source string, target string, category string"


def entries(spark):
    rows = [(1, "fire", "feu", "e"), (2, "fire ball", "boule", None), (3, "fire", "other", "e"), (4, "", "x", None), (5, "ice", " ", None), (6, "a.b", "point", "nan"), (7, "b", "bb", "e")]
    return spark.createDataFrame(rows, SCHEMA)


def test_load_keeps_first_and_counts(spark):
    got = {r.source: (r.target, r.category, r.n_rows) for r in glossary.load(entries(spark)).collect()}
    assert got == {"fire": ("feu", "e", 2), "fire ball": ("boule", None, 1), "a.b": ("point", None, 1), "b": ("bb", "e", 1)}


def test_matches_are_longest_first_in_order_and_distinct_by_pattern_and_by_joins(spark):
    terms = glossary.load(entries(spark))
    texts = spark.createDataFrame([(1, "a fire ball, fire and b a.b axb fire"), (2, None), (3, ""), (4, "none here?")], "row_id long, text string")
    want = {1: ["fire ball", "fire", "b", "a.b"], 2: [], 3: [], 4: []}
    for limit in (100, 0):
        assert {r.row_id: r.terms for r in glossary.matches(texts, terms, pattern_terms=limit).collect()} == want
    assert [r.terms for r in glossary.matches(texts, terms.where("false")).collect()] == [[]] * 4


def test_pages_differences_categories(spark):
    terms = glossary.load(entries(spark))
    assert [(r.source, r.total) for r in glossary.page(terms, 2, 1).collect()] == [("fire", 4), ("a.b", 4)]
    new = spark.createDataFrame([(1, "fire", "x", None), (2, "new", "x", None)], SCHEMA)
    assert {r.source: r.change for r in glossary.difference(terms, new).collect()} == {"fire": "updated", "new": "added"}
    assert [tuple(r) for r in glossary.by_category(terms).collect()] == [("e", 2, "b|fire")]
    asked = spark.createDataFrame([("fire",), ("zzz",)], "source string")
    assert {r.source: r.term_target for r in glossary.lookup(asked, terms).collect()} == {"fire": "feu", "zzz": None}


def test_unit_terms_keep_first_seen_order(spark):
    rows = spark.createDataFrame([("u", 1, ["b", "a"]), ("u", 0, ["c", "b"]), ("v", 0, [])], "unit_id string, pos int, terms array<string>")
    assert {r.unit_id: r.terms for r in glossary.unit_terms(rows).collect()} == {"u": ["c", "b", "a"]}


def scan(text, terms):
    """Plain leftmost-longest matching."""
    out, at = {}, 0
    while at < len(text):
        found = max((t for t in terms if text.startswith(t, at)), key=len, default=None)
        if found:
            out[found] = None
        at += len(found) if found else 1
    return list(out)


def test_joined_matches_equal_a_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(glossary, "BROADCAST_ROWS", -1)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab中😀 ") for _ in range(n))
    texts = [word(rng.randrange(0, 120)) for _ in range(80)]
    terms = {word(rng.randrange(1, 7)) for _ in range(60)} | {t[i : i + n] for t in texts[:40] for n in (3, 4, 7, 8, 9, 33, 64) for i in [rng.randrange(60)] if t[i : i + n]}
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 2), (901, "", 3), (902, texts[0], 4)], "row_id long, text string, terms int").drop("terms")
    named = spark.createDataFrame([(t,) for t in sorted(terms)] + [("",), (None,)], "source string")
    want = {i: scan(t, terms) for i, t in enumerate(texts)} | {900: [], 901: [], 902: scan(texts[0], terms)}
    for block in (1 << 20, 16):
        monkeypatch.setattr(glossary, "BLOCK", block)
        monkeypatch.setattr(glossary.fingerprints, "__defaults__", (block,))
        assert {r.row_id: r.terms for r in glossary.matches(df, named, pattern_terms=0).collect()} == want
    assert [r.terms for r in glossary.joined_matches(df.limit(2), named.where("source is null")).collect()] == [[], []]


def test_short_texts_share_batches_and_few_places_leave_a_task(spark):
    """A sieve lets all its own prints through and few others; texts are put together, none is cut."""
    own, other = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, (2, 9000))
    bits = glossary.sieve(spark.createDataFrame([(int(x),) for x in own], "x long"), "x").value
    assert len(glossary._passes(bits, own.view(np.uint64))) == len(own) and len(glossary._passes(bits, other.view(np.uint64))) < len(other) / 10
    bodies = ["ab", "c", "", "defgh", "i"]
    parts = list(glossary._joined(bodies, 3))
    assert [(at, said, cuts.tolist()) for at, said, cuts in parts] == [(0, "abc", [0, 2, 3]), (2, "defgh", [0, 0, 5]), (4, "i", [0, 1])]
    texts = spark.createDataFrame([(i, f"number {i} of all") for i in range(3000)], "_text long, body string")
    found = glossary.places(texts, spark.createDataFrame([("number 7 ",), ("all",), ("r 2999",)], "source string"))
    assert sorted((r._text, r.place, r.source) for r in found.where("source <> 'all'").collect()) == [(7, 0, "number 7 "), (2999, 5, "r 2999")]
    assert found.where("source = 'all'").count() == 3000


def test_a_sieve_that_lets_all_through_changes_nothing(spark, monkeypatch):
    """Whatever a task takes for a term is compared with the terms; texts that took something else are resolved again."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc中 ") for _ in range(n))
    texts = [word(rng.randrange(0, 60)) for _ in range(40)] + ["x" * 50]
    terms = {word(rng.randrange(1, 5)) for _ in range(9)} | {t[i : i + n] for t in texts[:20] for n in (3, 9, 17, 40) for i in [rng.randrange(20)] if t[i : i + n]}
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    named = spark.createDataFrame([(t,) for t in sorted(terms)], "source string")
    full = spark.sparkContext.broadcast(np.full(glossary._PAGE, 2**64 - 1, np.uint64))
    monkeypatch.setattr(glossary, "sieve", lambda rows, column: full)
    assert {r.row_id: r.terms for r in glossary.joined_matches(df, named).collect()} == {i: scan(t, terms) for i, t in enumerate(texts)}
    found = glossary.places(df.selectExpr("row_id _text", "text body"), named).collect()
    assert sorted((r._text, r.place, r.source) for r in found) == sorted((i, p, t) for i, said in enumerate(texts) for t in terms for p in range(len(said)) if said.startswith(t, p))


def test_texts_and_terms_meet_no_shuffle_and_few_false_places_pass(spark):
    """A line glossary of all texts: only digests of terms and of takings meet, and a false print passes in one of a thousand cases."""
    texts = spark.createDataFrame([(i, f"line {i * 7919} of all\nand line {i}\n{'z' * (i % 90)}") for i in range(3000)], "row_id long, text string")
    lines = texts.selectExpr("explode(split(text, '\\n')) source").where("source <> ''")
    assert "source" not in glossary.printed_terms(lines).columns
    out = glossary.joined_matches(texts, lines)
    assert not [x for x in ("Exchange", "SortMergeJoin") if x in out._jdf.queryExecution().executedPlan().toString()]
    assert {r.row_id: r.terms for r in out.collect()} == {r.row_id: list(dict.fromkeys(x for x in r.text.split("\n") if x)) for r in texts.collect()}
    own, other = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, (2, 200_000))
    bits = glossary.sieve(spark.createDataFrame(pd.DataFrame({"x": own})), "x").value
    assert len(glossary._passes(bits, own.view(np.uint64))) == len(own) and len(glossary._passes(bits, other.view(np.uint64))) < len(other) / 200
