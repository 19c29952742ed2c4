import random

import numpy as np
import pytest

from tests.llm.brute import classes, simhash
from tmengine.llm import simhash as op


def expected(rows, distance=4):
    fps = [simhash(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= distance]
    top = classes(len(rows), links)
    least = {}
    for (doc, _), c in zip(rows, top):
        if doc is not None:
            least[c] = min(least.get(c, doc), doc)
    return sorted((str(d), f, least.get(c)) for (d, _), f, c in zip(rows, fps, top))


def texts(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeXYZé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(1, 220))]
        out.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(rng.choice([" ", "\n", "\t "]).join(copy) + rng.choice(["", " "]))
    return [*out, "", None, " \n", "One", "one two THREE", " ", "w " * 30_000, "w " * 30_000]


def test_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "One"), (5, "dup id"), (5, "dup id")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, fp int, component_id int").repartition(5)
    got = op.simhash_components(df).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == expected(rows)


def test_empty_table(spark):
    assert op.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("threshold", [1, 2])
def test_covering_reaches_every_near_half(threshold):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**32, 300, dtype=np.uint64)
    y = x.copy()
    for _ in range(threshold):
        y ^= np.uint64(1) << rng.integers(0, 32, 300).astype(np.uint64)
    wx, ax, hx = op.anchors(x, threshold)
    wy, ay, _ = op.anchors(y, threshold)
    homes = dict(zip(wx[hx].tolist(), ax[hx].tolist()))
    assert len(homes) == 300 and hx.sum() == 300
    reach = set(zip(wy.tolist(), ay.tolist()))
    assert all((i, homes[i]) in reach for i in range(300))


def test_a_large_anchor_is_streamed(spark):
    """Many fingerprints of one neighbourhood, over several Arrow batches, still connect."""
    rng = np.random.default_rng(5)
    fps = sorted({int(b1 | b2 | b3) for b1, b2, b3 in (np.left_shift(1, rng.integers(0, 40, 3)) for _ in range(1500))})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        placed = op.replicas(df, "fp", ["fp"], 4)
        links = op.compare(placed, lambda x, y: op.differing(x["fp"], y["fp"]) <= 4, "fp", ["fp"])
        rows = op.components(links).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = {f: i for i, f in enumerate(fps)}
    want = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    got = {r["id"]: r["component"] for r in rows}
    assert [at[got.get(f, f)] for f in fps] == want


def test_stage_form_links_near_copies_and_leaves_others(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    rows = []
    for k in range(30):
        base = [rng.choice(words) for _ in range(250)]
        rows.append((2 * k, " ".join(base)))
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(250)] = rng.choice(words)
        rows.append((2 * k + 1, " ".join(copy)))
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(200))) for i in range(40)] + [(300, None), (301, "")]
    got = {r.doc_id: r.component_id for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(30)) >= 28
    assert all(got[100 + i] == 100 + i for i in range(40)) and got[301] == 300


def test_one_long_text_alone_in_a_block(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(140_000))
    got = op.simhash_components(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(1, 1)] and got[0].fp % 2**64 == simhash(long)


def test_components_run_no_round_to_see_that_nothing_is_left(spark, monkeypatch):
    """Stars are only looked at; other links take few stages a round; hubs, chains and cycles with and without broadcasts."""
    from tmengine.operators import graph

    def stages(edges):
        group = f"components-{len(edges)}-{edges[0]}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            got = dict(op.components(spark.createDataFrame(edges, "a long, b long")).collect())
        finally:
            spark.sparkContext.setJobGroup("", "")
        tracker = spark.sparkContext.statusTracker()
        return got, sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group))

    rng = np.random.default_rng(3)
    hub = [(5, i) for i in range(6, 400)]
    chain = [(i, i + 1) for i in range(1000, 1090)] + [(1000, 1090), (2000, 2000), (None, 7)]
    some = [tuple(x) for x in rng.integers(3000, 3300, (260, 2)).tolist()]
    for rows in (1_000_000, 0):
        monkeypatch.setattr(graph, "BROADCAST_ROWS", rows)
        got, n_star = stages(hub)
        assert got == dict.fromkeys([5, *range(6, 400)], 5)
        got, _ = stages([*chain, *some])
        top = {v: v for e in some for v in e if e[0] != e[1]}
        for _ in range(300):
            for a, b in some:
                if a != b:
                    top[a] = top[b] = min(top[a], top[b])
        assert got == dict.fromkeys(range(1000, 1091), 1000) | top
        if rows:
            assert n_star <= 20
