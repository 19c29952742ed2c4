import random

import corpus_pipeline
import numpy as np

from tmengine.llm import simhash as op


def words_of(rng, n=4000):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def groups(spark, rows):
    return {r.doc_id: r.component_id for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_added_and_cut_passages_are_found(spark):
    rng = random.Random(2)
    words = words_of(rng)
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(300)]
        new = [rng.choice(words) for _ in range(36)]
        copy = [base + new, base[:150] + new + base[150:], base[:264]][k % 3]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    got = groups(spark, rows)
    assert sum(got[2 * k + 1] == 2 * k for k in range(60)) >= 58
    assert all(got[2 * k] == 2 * k for k in range(60))


def test_common_shingles_counts_intersections():
    rng = np.random.default_rng(1)
    one, two = ([np.unique(rng.integers(0, 50, rng.integers(0, 40)).astype(np.uint64)) for _ in range(k)] for k in (7, 5))
    for width in (4, 16, 1 << 14):
        assert op.common_shingles(one, two, width).tolist() == [[len(np.intersect1d(x, y)) for y in two] for x in one]
    assert op.common_shingles([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]).tolist() == [[0]]


def test_blocks_decide_as_pairs_do(spark, monkeypatch):
    """A group in which many pairs are just below the similarity, in small buckets' pairs and in blocks; nulls, empty table."""
    rng = random.Random(9)
    words = words_of(rng)
    rows = [(500, None), (501, ""), (502, "few words only")]
    for g in range(3):
        base = [rng.choice(words) for _ in range(200)]
        for i in range(30):
            copy = list(base)
            for at in rng.sample(range(200), rng.randint(2, 9)):
                copy[at] = rng.choice(words)
            rows.append((100 * g + i, " ".join(copy)))
    sets = {d: {tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for d, t in rows if d < 500}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    least = {d: d for d in sets}
    for _ in range(50):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    want = least | {500: 500, 501: 500, 502: 502}
    assert len(set(want.values())) > 10
    assert groups(spark, rows) == want
    monkeypatch.setattr(op, "PAIRED", 2)
    monkeypatch.setattr(op, "BLOCK", 8)
    assert groups(spark, rows) == want
    assert op.near_duplicates(spark.createDataFrame([], "doc_id long, text string, body int")).count() == 0


def test_the_exact_similarity_decides(spark):
    """All pairs of edited copies at 0.7 to 0.9, some with repeated lines, against their shingle sets."""
    rng = random.Random(6)
    words = words_of(rng)
    rows, same = [], {}
    for k in range(120):
        base = [rng.choice(words) for _ in range(300)]
        if k % 3 == 0:
            base += [rng.choice(words) for _ in range(9)] * 60
        copy = list(base)
        if k % 3 == 1:
            copy += [rng.choice(words) for _ in range(rng.randint(45, 105))]
        else:
            for at in rng.sample(range(300), rng.randint(3, 10)):
                copy[at] = rng.choice(words)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, copy))
        same[k] = 5 * len(a & b) >= 4 * len(a | b)
    got = groups(spark, rows)
    assert 20 < sum(same.values()) < 100
    assert {k: got[2 * k + 1] == 2 * k for k in same} == same


def test_a_failed_pair_hides_no_link(spark):
    """A chain: each text is near the next only, and all share most shingles' sketches."""
    rng = random.Random(7)
    words = words_of(rng)
    base = [rng.choice(words) for _ in range(400)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(base)))
        base = base[28:] + [rng.choice(words) for _ in range(28)]
    assert set(groups(spark, rows).values()) == {0}


def test_one_row_of_each_group_survives_repeated_and_missing_ids(spark, sf_dir):
    rng = random.Random(8)
    words = words_of(rng)
    x, y, z = (" ".join(rng.choice(words) for _ in range(200)) for _ in range(3))
    rows = [(1, x), (1, y), (1, y), (2, y + " more"), (None, z), (None, z), (None, z + " more"), (3, x + " more")]
    docs = spark.createDataFrame([(d, t, "en", "a", 5) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()]
    assert len(kept) == 3 and {(1, x), (1, y)} < set(kept)
    assert [t for d, t in kept if d is None][0] in (z, z + " more")


def test_simhash_links_without_sketches(spark, monkeypatch):
    """Near fingerprints meet at anchors: equal sets in another order and texts of a few other shingles, decided by their sets."""
    rng = random.Random(4)
    words = words_of(rng)
    rows = []
    for k in range(8):
        base = [rng.choice(words) for _ in range(1500)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base, rng.choice(words)])), (10 * k + 2, " ".join([*base, *base]))]
    for name in ("next_in_bucket", "all_in_bucket"):
        whole = getattr(op, name)
        monkeypatch.setattr(op, name, lambda placed, *turn, whole=whole: whole(placed.where("false"), *turn))
    got = groups(spark, rows)
    assert got == {d: d - d % 10 for d, _ in rows}


def test_later_rounds_link_components_only(spark, monkeypatch):
    """What the first round linked is one vertex in later ones: they take a link or so for each component that they join."""
    rng = random.Random(9)
    words = words_of(rng)
    rows = []
    for k in range(3):
        base = [rng.choice(words) for _ in range(1500)]
        rows += [(100 * k + i, " ".join([*base, rng.choice(words)])) for i in range(30)]  # near by SimHash as well
        rows += [(100 * k + 50 + i, " ".join([*base, *(rng.choice(words) for _ in range(200))])) for i in range(4)]  # by sketches only
    taken, whole = [], op.components
    monkeypatch.setattr(op, "components", lambda links: taken.append(links.count()) or whole(links))
    assert groups(spark, rows) == {d: d - d % 100 for d, _ in rows}
    assert taken[0] >= 80 and 0 < sum(taken[1:]) <= 60
    linked, joined = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "id long, component long"), spark.createDataFrame([(1, 5), (5, 0), (8, 9)], "u long, v long")
    assert {tuple(r) for r in op.merged(linked, joined).collect()} == {(i, 0) for i in (0, 1, 2, 5, 6)} | {(8, 8), (9, 8)}
