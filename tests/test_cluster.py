import random

from tests.test_functions import affix
from tmengine.operators import cluster


def brute(texts, t):
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    pairs = set()
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] and texts[j] and affix(texts[i], texts[j]) >= t - 1e-9:
                pairs.add((j, i))
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return pairs, [find(i) for i in range(len(texts))]


def sample(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(60)]


def test_pairs_and_components_match_brute_force(spark):
    for seed, t in ((1, 0.4), (2, 0.8)):
        texts = sample(seed)
        df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
        pairs, tops = brute(texts, t)
        assert {(r.a, r.b) for r in cluster.affix_pairs(df, t).collect()} == pairs
        got = {r.row_id: r.component for r in cluster.template_components(df, t).collect()}
        assert got == {i: c for i, c in enumerate(tops) if texts[i]}


def test_groups_are_covered_and_sliced(spark):
    frame = [f"请前往第{i}层寻找宝箱" for i in range(12)]
    texts = [*frame, "完全不同的一句话", "another thing", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    rows = {r.row_id: r for r in cluster.template_groups(df, 0.4, 0.5, 5).collect()}
    assert [rows[i].slice_no for i in range(12)] == [0] * 5 + [1] * 5 + [2] * 2
    assert rows[0].is_grouped and rows[0].template == "请前往第…层寻找宝箱"
    assert not rows[12].is_grouped and rows[12].template == "" and 14 not in rows and 15 not in rows


def test_a_chain_without_common_frame_is_no_group(spark):
    texts = ["aaaabbbb", "aaaacccc", "ddddcccc"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    rows = cluster.template_groups(df, 0.4, 0.5).collect()
    assert len({r.component for r in rows}) == 1 and not any(r.is_grouped for r in rows)


def test_similar_sets_match_brute_force_with_few_candidates(spark):
    rng = random.Random(3)
    base = [[f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(1, 40))] for _ in range(120)]
    base += [[*b[: rng.randrange(1, len(b) + 1)], f"x{rng.randrange(5)}"] for b in base]
    base += [[], None, ["a", None, "a"], ["a"]]
    rows = spark.createDataFrame(list(enumerate(base)), "row_id long, items array<string>")
    asked = rows.where("row_id % 5 = 0 or row_id > 239").withColumnRenamed("row_id", "query_id")
    sets = {i: {x for x in b or [] if x is not None} for i, b in enumerate(base)}
    for least in (0.3, 0.7, 1.0):
        want, all_pairs = set(), 0
        for q in sets:
            for r in sets:
                if q != r and (q % 5 == 0 or q > 239) and sets[q] & sets[r]:
                    all_pairs += 1
                    if len(sets[q] & sets[r]) / len(sets[q] | sets[r]) >= least:
                        want.add((q, r))
        seen = {}
        assert {(r.query_id, r.row_id) for r in cluster.similar_sets(asked, rows, least, seen).collect()} == want
        assert least < 0.5 or seen["candidates"] * 5 < all_pairs


def test_similar_sets_of_several_blocks_match_brute_force(spark, monkeypatch):
    """Every row shares common items, so that many pairs meet: all are compared inside tasks, block by block."""
    monkeypatch.setattr(cluster, "QUERY_SETS", 7)
    monkeypatch.setattr(cluster, "ROW_SETS", 5)
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", -1)
    rng = random.Random(5)
    base = [["the", "of", *(f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 25)))] for _ in range(70)]
    rows = spark.createDataFrame(list(enumerate(base)), "row_id long, items array<string>")
    asked = rows.where("row_id % 3 = 0").withColumnRenamed("row_id", "query_id")
    for least in (0.05, 0.5):
        found = {(r.query_id, r.row_id): r.similarity for r in cluster.similar_sets(asked, rows, least).collect()}
        exact = {(q, r): len({*base[q]} & {*base[r]}) / len({*base[q]} | {*base[r]}) for q in range(0, 70, 3) for r in range(70) if q != r}
        assert found == {k: round(v, 6) for k, v in exact.items() if v >= least}


def test_keys_that_a_wider_one_makes_redundant_give_no_edges(spark):
    """Numbered texts share affixes of many depths; the components stay those of all linked pairs, with few edges for each text."""
    from pyspark.sql import functions as F

    texts = [f"order {i * 37} of {('FURNITURE', 'MACHINERY', 'BUILDING')[i % 3]}" for i in range(150)] + ["order", "of", "x" * 60, "order 5 of " + "y" * 40]
    rows = cluster.trimmed(spark.createDataFrame(list(enumerate(texts)), "row_id long, text string"))
    edges = [(r.a, r.b) for r in cluster.affix_edges(rows, 0.4).collect()]
    pairs = [(r.a, r.b) for r in cluster.affix_links(rows, 0.4).collect()]

    def tops(links):
        top = list(range(len(texts)))
        for _ in texts:
            for a, b in links:
                top[a] = top[b] = min(top[a], top[b])
        return top

    assert tops(edges) == tops(pairs)
    same = cluster.affix_edges(rows.where(F.length("text").between(15, 22)), 0.4).count()
    assert same < 100  # 139 with all keys, 70 without the redundant ones


def test_rare_items_and_sketches_leave_few_pairs_to_compare(monkeypatch):
    """Sets that share their common items: all similar ones are found, by a small part of the items that sets share."""
    import numpy as np

    rng = random.Random(11)
    draw = lambda n: {min(3999, int(4000 * rng.random() ** 0.2)) for _ in range(n)}  # noqa: E731  # high numbers are common
    sets = [draw(rng.randrange(1, 300)) for _ in range(300)]
    sets += [{*rng.sample(sorted(x), max(1, len(x) * 3 // 4)), *draw(rng.randrange(0, 20))} for x in sets[::3]]
    asked = sorted((sorted(x) for x in sets[::2]), key=len)
    alone = [rng.randrange(0, 20) for _ in sets]  # items that no stated set has
    rows = sorted(((len(x) + n, sorted(x)) for x, n in zip(sets, alone)), key=lambda r: r[0])
    packed = lambda each: (np.cumsum([len(x) for x in each]), np.array([i for x in each for i in x], np.int32))
    looked = []
    plain = cluster._Near._sorted_out
    monkeypatch.setattr(cluster._Near, "_sorted_out", lambda self, row, nth, start, many, *rest: looked.append(int(many.sum())) or plain(self, row, nth, start, many, *rest))
    for posts in (1 << 19, 50):
        monkeypatch.setattr(cluster, "_POSTS", posts)
        for least in (0.25, 0.5, 0.8, 1.0):
            looked.clear()
            near = cluster._Near(np.arange(len(asked)), np.array([len(x) for x in asked], np.int32), *packed(asked), least)
            found = list(zip(*(x.tolist() for x in near.pairs(np.array([n for n, _ in rows], np.int32), *packed([x for _, x in rows])))))
            shared = {(i, j): len({*x} & {*y}) for i, (n, x) in enumerate(rows) for j, y in enumerate(asked)}
            want = {(i, j) for (i, j), c in shared.items() if c and c / (rows[i][0] + len(asked[j]) - c) >= least}
            assert want <= set(found) and len(found) == len(set(found)) and len(found) < max(3 * len(want), 0.2 * len(shared))
            assert least < 0.5 or sum(looked) * 10 < sum(shared.values())
            i = found[0][0]
            js = np.array([j for k, j in found if k == i])
            assert near.common(js, np.array(rows[i][1], np.int32)).tolist() == [shared[i, j] for j in js.tolist()]


def test_few_stated_sets_are_one_block_whatever_the_partitions(spark):
    rows = spark.createDataFrame([(i, [f"w{i % 7}", f"v{i % 3}"]) for i in range(40)], "row_id long, items array<string>")
    places = spark.createDataFrame([(f"{c}{i}", 10 * (c == "w") + i) for c, n in (("w", 7), ("v", 3)) for i in range(n)], "item string, place int")
    assert cluster._set_blocks(rows, "row_id", places, 100, True).count() == 1
    assert sorted(len(r.ids) for r in cluster._set_blocks(rows, "row_id", places, 5, True).collect())[-1] <= 5
