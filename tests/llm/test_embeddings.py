import math
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.brute import classes
from tmengine.llm import embeddings as op

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, component_id int"


def expected(rows):
    def sound(r):
        return r[1] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    vs = [np.array(r[1], np.float32).astype(float) if sound(r) else None for r in rows]
    n, links = [0] * len(rows), []
    for i, a in enumerate(rows):
        for j in range(i):
            if vs[i] is None or vs[j] is None or a[2] != rows[j][2] or len(vs[i]) != len(vs[j]):
                continue
            if vs[i] @ vs[j] / np.linalg.norm(vs[i]) / np.linalg.norm(vs[j]) >= 0.98:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    top, least = classes(len(rows), links), {}
    for r, t in zip(rows, top):
        if r[0] is not None:
            least[t] = min(r[0], least.get(t, r[0]))
    return sorted(str((r[0], k, least.get(t))) for r, k, t in zip(rows, n, top))


def sample():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        base = rng.normal(size=64)
        for _ in range(5):
            rows.append([len(rows), [float(x) for x in base + rng.normal(size=64) * rng.uniform(0, 0.2)], k % 3])
    base = rng.normal(size=64)
    rows += [[1000 + i, [float(x) for x in base + 0.03 * rng.normal(size=64)], 1] for i in range(120)]
    rows += [[2000 + i, [float(x) for x in base], 1] for i in range(30)]
    odd = [None, [], [0.0] * 64, [None, *[1.0] * 63], [float("nan"), *[1.0] * 63], [float("inf"), *[1.0] * 63], [1.0, 2.0], [2.0, 4.0], [1e-30] * 64, [1e30] * 64]
    rows += [[3000 + i, v, 2] for i, v in enumerate(odd)] + [[4000, rows[0][1], None], [4001, rows[0][1], None], [0, rows[0][1], 0], [None, rows[0][1], 0]]
    return [(*r, 1, 1) for r in rows]


def test_matches_brute_force_whole_and_in_chunks(spark, monkeypatch):
    rows = sample()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for chunk in (2000, 40):
        monkeypatch.setattr(op, "CHUNK", chunk)
        got = op.embedding_links(df).collect()
        assert sorted(str(tuple(r)) for r in got) == expected(rows)


def test_empty_table(spark):
    assert op.embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decoding_lists_all_directions_within_the_slack():
    v = np.random.default_rng(2).normal(size=(5, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rotation, code = op.product_code(12, 2, 9)
    for x, found in zip(v, op.decode(v, 2, 9, 0.2)):
        y = x @ rotation
        scores = {a * 9 + b: y[:6] @ code[0][a] + y[6:] @ code[1][b] for a in range(9) for b in range(9)}
        best = max(scores.values())
        assert sorted(k for k, s in scores.items() if s >= best - 0.2) == found.tolist()


def test_pairs_at_the_threshold_share_a_filter_at_any_dimension():
    """Pairs at cosine 0.98 exactly; the filters of a vector do not grow with the dimension."""
    rng = np.random.default_rng(9)
    filters = []
    for dim in (16, 64, 384):
        v, w = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 1500, dim)))
        w = w - (w * v).sum(1, keepdims=True) * v
        w = 0.98 * v + math.sqrt(1 - 0.98**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
        a, b = (op.decode(x, 2, 80, op.slack_for(dim, 0.98)) for x in (v, w))
        assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b)]) >= 0.998
        filters.append(np.mean([len(x) for x in a]))
    assert 15 > filters[0] > filters[1] > filters[2]
    assert [op.words_for(n) for n in (0, 51_200, 10**9)] == [16, 40, 4096]


def test_recall_on_the_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label", F.lit(0), F.lit(0)).collect()]
    assert sorted(str(tuple(r)) for r in op.embedding_links(table).collect()) == expected(rows)
