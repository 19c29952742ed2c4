import math
import random

import numpy as np
from pyspark.sql import functions as F

from tmengine.operators import cells, retrieve, textindex


def test_dense_topk_matches_numpy_and_skips_unsound_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(80, 8))
    rows = [(i, [float(x) for x in v[i]]) for i in range(80)] + [(80, None), (81, [0.0] * 8), (82, [float("nan")] * 8)]
    index = spark.createDataFrame(rows, "pair_id long, vector array<double>").repartition(3)
    asked = index.where("pair_id % 9 = 0 or pair_id > 79").withColumnRenamed("pair_id", "query_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = []
    for q in range(0, 80, 9):
        s = np.round(u[q] @ u.T, 6)
        want += [(q, int(i), float(s[i])) for i in sorted(range(80), key=lambda i: (-s[i], i))[:5] if s[i] >= 0.1]
    for block in (4096, 3):
        monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
        got = [(r.query_id, r.pair_id, r.score) for r in retrieve.dense_scores(asked, index, 5, 0.1).collect()]
        assert sorted(got) == sorted(want)


def test_sparse_scores(spark):
    index = spark.createDataFrame([(1, "red fox fox"), (2, "red dog"), (3, ""), (4, None)], "pair_id long, text string")
    asked = spark.createDataFrame([(9, "Fox fox dog"), (8, "?")], "query_id long, text string")
    n = spark.createDataFrame([(4,)], "n long")
    got = {(r.query_id, r.pair_id): r.score for r in retrieve.sparse_scores(textindex.postings(asked, "query_id"), textindex.postings(index, "pair_id"), n).collect()}
    idf = math.log(1 + (4 - 1 + 0.5) / 1.5)
    assert got == {(9, 1): round(2 * idf * 2, 6), (9, 2): round(idf, 6)}


def test_fusion_and_weighted_top(spark):
    ranked = "query_id long, pair_id long, nth int"
    dense, sparse = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], ranked), spark.createDataFrame([(1, 2, 1), (1, 4, 2)], ranked)
    scores = {r.pair_id: r.score for r in retrieve.fused([dense, sparse]).collect()}
    assert scores == {1: round(1 / 61, 9), 2: round(1 / 62 + 1 / 61, 9), 3: round(1 / 63, 9), 4: round(1 / 62, 9)}
    index = spark.createDataFrame([(1, "s", "t", "Done"), (2, "s", "t ", None), (3, "s", "u", "Designer Reviewed"), (4, "x", "y", None)], "pair_id long, source string, target string, status string")
    hits = retrieve.hybrid_search(dense, sparse, index, 2).orderBy("nth").collect()
    assert [(h.pair_id, h.score) for h in hits] == [(3, scores[3]), (1, scores[1])] or [h.pair_id for h in hits][0] in (1, 3)
    assert 2 not in [h.pair_id for h in hits]


def test_diagnostics_and_weak_recall(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    scored = "query_id long, pair_id long, score double"
    out = retrieve.recall_diagnostics(queries, spark.createDataFrame([(1, 5, 0.4), (1, 6, 0.7)], scored), spark.createDataFrame([(1, i, 1.0) for i in range(30)], scored))
    assert {r.query_id: (r.dense_top1, r.sparse_hits) for r in out.collect()} == {1: (0.7, 20), 2: (None, 0)}
    rows = spark.createDataFrame([(1, 0, None, 0), (2, 0, 0.4, 0), (3, 0, 0.5, 0), (4, 1, 0.1, 0), (5, 0, 0.1, 2)], "q int, term_count int, dense_top1 double, sparse_hits int")
    assert [r.weak for r in retrieve.weak_recall(rows, 0.5).orderBy("q").collect()] == [True, True, False, False, False]


def test_unit_references_keep_the_best_score(spark):
    members = spark.createDataFrame([("u", 1), ("u", 2)], "unit_id string, query_id long")
    hits = spark.createDataFrame([(1, 7, "s", "t", "Done", 0.2), (2, 8, "s", "t", None, 0.9), (2, 9, "a", "b", None, 0.5)], "query_id long, pair_id long, source string, target string, status string, score double")
    got = retrieve.unit_references(members, hits, 1).orderBy("nth").collect()
    assert [(r.source, r.score, r.status) for r in got] == [("s", 0.9, None), ("a", 0.5, None)]


def hits_by_all_postings(spark, index, asked, n):
    scores = retrieve.sparse_scores(textindex.postings(asked, "query_id"), textindex.postings(index, "pair_id"), index.agg(F.count("*").alias("n")))
    return sorted(map(tuple, retrieve.top(scores, n).collect()))


def test_pruned_hits_equal_all_hits(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(4000)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(int(rng.paretovariate(0.9)) % 300))) for i in range(400)] + [(900, None), (901, ""), (902, "w1 " * 500)]
    texts += [(1000 + i, "w1 w2 w3 same text") for i in range(60)]
    index = spark.createDataFrame(texts, "pair_id long, text string")
    asked = spark.createDataFrame([(q, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for q in range(25)] + [(50, "w1"), (51, "none such"), (52, None), (53, "same w399")], "query_id long, text string")
    for block, n, direct in ((128, 5, 0), (7, 20, 0), (16, 1, 0), (128, 5, 10**9)):
        monkeypatch.setattr(textindex, "BLOCK", block)
        hits = retrieve.sparse_hits(textindex.postings(asked, "query_id"), textindex.postings(index, "pair_id"), index.agg(F.count("*").alias("n")), n, direct=direct)
        got = sorted(map(tuple, hits.select("query_id", "pair_id", "score", "nth").collect()))
        assert got == hits_by_all_postings(spark, index, asked, n)
    empty = index.where("false")
    assert retrieve.sparse_hits(textindex.postings(asked, "query_id"), textindex.postings(empty, "pair_id"), empty.agg(F.count("*").alias("n")), 5).count() == 0


def test_counted_texts_give_the_same_hits(spark, monkeypatch):
    """Texts counted in one row, scored where they lie: repeated and null ids, copies, Han pairs, any size of what is made at once."""
    rng = random.Random(6)
    words = [f"w{min(int(rng.paretovariate(0.7)), 300)}" for _ in range(3000)] + ["K9", "İx", "中国人民", "民", "a中b"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(int(rng.paretovariate(0.9)) % 200))) for i in range(300)] + [(900, None), (901, ""), (902, "w1 " * 500)]
    texts += [(1000 + i, "w1 w2 w3 same text 中国") for i in range(60)] + [(5, "w1 w2"), (5, "w1 x"), (None, "w1 w3"), (None, "w3 民")]
    index = spark.createDataFrame(texts, "pair_id long, text string").repartition(5)
    asked = spark.createDataFrame([(q, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for q in range(25)] + [(50, "w1"), (51, "none such"), (52, None), (53, "same w299 国人")], "query_id long, text string")
    made = textindex.counted(index, "pair_id").select("pair_id", "n", F.inline("counts")).select("pair_id", "token", "tf", "n")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(map(tuple, textindex.postings(index, "pair_id").collect()), key=key)
    n_index = index.agg(F.count("*").alias("n"))
    want = retrieve.top(retrieve.sparse_scores(textindex.postings(asked, "query_id"), textindex.postings(index, "pair_id"), n_index), 5)
    want = sorted(map(tuple, want.select("query_id", "pair_id", "score", "nth").collect()), key=key)
    for meet, sums, rows in ((1 << 20, 1 << 21, 200_000), (10, 40, 200_000), (1, 1, 3)):
        for name, value in (("_MEET", meet), ("_SUMS", sums), ("BROADCAST_ROWS", rows)):
            monkeypatch.setattr(retrieve, name, value)
        hits = retrieve.sparse_hits(textindex.postings(asked, "query_id"), textindex.counted(index, "pair_id"), n_index, 5)
        assert sorted(map(tuple, hits.select("query_id", "pair_id", "score", "nth").collect()), key=key) == want
    none = index.where("false")
    assert retrieve.sparse_hits(textindex.postings(asked, "query_id"), textindex.counted(none, "pair_id"), none.agg(F.count("*").alias("n")), 5).count() == 0


def test_a_token_of_every_text_is_hardly_met(spark):
    """One token is in every text: a tenth of the rows before the last aggregate, or less, and the same hits."""
    rng = random.Random(9)
    texts = [(i, "the " * rng.choice([1, 1, 1, 2]) + " ".join(f"x{rng.randrange(300)}" for _ in range(8))) for i in range(6000)]
    index = spark.createDataFrame(texts, "pair_id long, text string")
    asked = spark.createDataFrame([(q, f"the x{q} x{q + 1}") for q in range(40)], "query_id long, text string")
    posted, n_index, seen = textindex.postings(index, "pair_id"), index.agg(F.count("*").alias("n")), {}
    hits = retrieve.sparse_hits(textindex.postings(asked, "query_id"), posted, n_index, 20, counts=seen, direct=0)
    got = sorted(map(tuple, hits.select("query_id", "pair_id", "score", "nth").collect()))
    assert got == hits_by_all_postings(spark, index, asked, 20)
    every = textindex.postings(asked, "query_id").join(posted, "token").count()
    assert (seen["found"] + seen["looked_up"]) * 10 <= every


def test_kept_frequencies_follow_loads(spark):
    rows = lambda some: textindex.postings(spark.createDataFrame(some, "pair_id long, text string"), "pair_id")
    kept = textindex.frequencies(rows([(1, "a b"), (2, "a c")]))
    kept = textindex.changed_frequencies(kept, rows([(2, "a c")]), rows([(3, "a d"), (4, "d")]))
    assert {r.token: r.df for r in kept.collect()} == {"a": 2, "b": 1, "d": 2}
    same = textindex.changed_frequencies(kept, rows([]), rows([]))
    assert {r.token: r.df for r in same.collect()} == {"a": 2, "b": 1, "d": 2}


def test_cells_give_the_same_hits_and_visit_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 40)
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(30, 16))
    v = np.concatenate([m + 0.15 * rng.normal(size=(60, 16)) for m in middle])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0, 2.0]), (5005, [2.0, 1.0])]
    rows += [(6000 + i, [float(x) for x in v[0]]) for i in range(30)]
    index = spark.createDataFrame(rows, "pair_id long, vector array<double>").repartition(3)
    asked = index.where("pair_id % 20 = 0 or pair_id > 4999").withColumnRenamed("pair_id", "query_id")
    for n, least in ((10, -1.0), (3, 0.9)):
        seen = {}
        got = sorted(map(tuple, cells.dense_hits(asked, index, n, least, cells=30, counts=seen).collect()))
        assert got == sorted(map(tuple, retrieve.dense_scores(asked, index, n, least).collect()))
        assert seen["visits"] * 4 < seen["blocks"] * asked.count()
    none = index.where("false")
    assert cells.dense_hits(asked, none, 5).count() == 0 and cells.dense_hits(none.withColumnRenamed("pair_id", "query_id"), index, 5).count() == 0


def test_texts_are_cut_along_the_likeliest_path(spark):
    words = {"中国": 50, "国人": 20, "中国人": 30, "人民": 40, "民": 5, "研究": 30, "研究生": 20, "生命": 30, "命": 4, "起源": 10, "长城": 9, "a": 99}
    total = sum(words.values())
    rng = random.Random(2)
    texts = ["研究生命起源", "中国人民 Abc9 中国人", "长城!长", "x", "", None] + ["".join(rng.choice("中国人民研究生命起源x 1") for _ in range(14)) for _ in range(60)]

    def plain(text):
        out, i = [], 0
        while text and i < len(text):
            j = i
            kind = lambda c: 1 if c.isascii() and c.isalnum() else 2 if "\u4e00" <= c <= "\u9fff" else 0
            while j < len(text) and kind(text[j]) == kind(text[i]):
                j += 1
            run = text[i:j]
            if kind(text[i]) == 1:
                out.append(run.lower())
            elif kind(text[i]) == 2:
                def ways(k):
                    if k == len(run):
                        return [(0.0, ())]
                    steps = [(len(w), math.log(f / total)) for w, f in words.items() if run.startswith(w, k)]
                    steps += [] if any(n == 1 for n, _ in steps) else [(1, math.log(1 / total))]
                    return [(p + q, (n, *rest)) for n, p in steps for q, rest in ways(k + n)]

                best = max(ways(0), key=lambda x: (round(x[0], 9), x[1]))
                at = 0
                for n in best[1]:
                    out.append(run[at : at + n])
                    at += n
            i = j
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    named = spark.createDataFrame([*words.items(), ("", 3), (None, 1), ("零", 0), ("中国", 7)], "word string, freq long")
    made = textindex.segmented(df, named)
    assert {r.id: r.tokens for r in made.collect()} == {i: plain(t) for i, t in enumerate(texts)}
    counts = textindex.postings(made, "id", "tokens", lambda c: c)
    assert counts.where("id = 1 and token = 'abc9'").first()["n"] == 4 or counts.where("id = 1").count() > 1
    assert {r.id: r.tokens for r in textindex.segmented(df.limit(2), named.where("false")).collect()}[0] == list("研究生命起源")
