import math
import random

import pytest
from pyspark.sql import functions as F

from tmengine.llm import topk as op

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def plain(rows, k, every=20):
    held = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in held:
        if i % every == 0:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in held if (j, w) != (i, v) and len(v) == len(w))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(hits[:k])]
    return sorted(out)


def run(spark, rows, k=20, lists=2, schema=SCHEMA):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], schema)
    out = op.exact_top(op.scaled(df, 64), k, lists=lists)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, out.collect()))


def sample():
    rng = random.Random(7)
    vector = lambda d: [rng.choice([-1, 1]) * rng.randrange(0, 65) / 64 for _ in range(d)]
    rows = [(i, vector(6)) for i in range(300)]
    copy, tied = vector(6), vector(6)
    rows += [(300 + i, copy) for i in range(120)]
    rows += [(500 + i, [*tied[:-1], (i % 3) / 64]) for i in range(60)]
    rows += [(700, None), (720, [1.0, None, 0.5, 0.0, 0.0, 0.0]), (740, [math.nan] * 6), (760, [math.inf] * 6), (None, vector(6)), (780, []), (800, []), (801, [0.0] * 6), (820, [0.0] * 6)]
    rows += [(840, vector(3)), (841, vector(3)), (860, vector(9)), (20, rows[20][1]), (880, vector(6)), (880, vector(6)), (900, [-x for x in copy])]
    return rows


@pytest.mark.parametrize("k,lists", [(20, 2), (3, 3), (1, 1)])
def test_matches_plain_version(spark, k, lists):
    rows = sample()
    assert run(spark, rows, k, lists) == plain(rows, k)


def test_few_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "QUERY_BLOCK", 3)
    monkeypatch.setattr(op, "POINT_BLOCK", 5)
    rows = sample()[:40]
    assert run(spark, rows, 50) == plain(rows, 50)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_large_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-(1 << 24), 1 << 24)) for _ in range(5)]) for i in range(60)]
    assert run(spark, rows, 5) == plain(rows, 5)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [1e30]), (1, [1.0])])


def test_cutoff_spares_most_points(spark, sf_dir):
    """Lists give few of all pairs, and no pair of copies is made."""
    rows = op.scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 64)
    points = rows.select(F.col("vec_id").alias("point"), "v").cache()
    queries = points.where("point % 20 = 0").withColumnRenamed("point", "query")
    found = op.top_points(queries, points, 20)
    assert found.groupBy("query").count().where("count < 20").isEmpty()
    assert found.count() < queries.count() * 60
