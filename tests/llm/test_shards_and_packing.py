import itertools
import random
import zlib

import numpy as np

from tmengine.llm import packing, sharding

DOCS = "doc_id long, text string, lang string, source string, shard string, rank int"


def test_the_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        at = sharding.hilbert_index(cells, bits)
        order = cells[np.argsort(at)]
        assert sorted(at.tolist()) == list(range(len(cells))) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def sample(n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["same", "é" * rng.randint(0, 300), None]), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]), "clash", 1) for i in range(n)]
    return rows + ([(None, "null id", "en", "a", "x", 1), (0, "dup", "en", "a", "x", 1), (0, "dup", "en", "a", "x", 1)] if n else [])


def test_shards_are_even_and_gapless(spark):
    for n in (0, 5, 333):
        rows = sample(n)
        got = sharding.hilbert_shards(spark.createDataFrame(rows, DOCS).repartition(3), 16).collect()
        want = sorted(str((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for d, t, *_ in rows)
        assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == want
        slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
        assert all(v == list(range(len(v))) for v in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        curve = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        assert curve == sorted(curve)


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "a") for i in range(64)], "doc_id long, text string, lang string, source string")
    sharding.write_shards(docs, sharding.hilbert_shards(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 64 and back.select("shard").distinct().count() == 4


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        totals = [n * x - rng.randint(0, n) for n, x in zip(counts, lengths)]
        buckets = rng.randint(1, 4)
        best = min(
            sum(n * min(e for e in (*ends, lengths[-1]) if e >= x) - t for n, x, t in zip(counts, lengths, totals))
            for k in range(min(buckets, len(lengths))) for ends in itertools.combinations(lengths[:-1], k)
        )
        ends, cost = packing.best_boundaries(lengths, counts, totals, buckets)
        assert cost == best and ends[-1] == lengths[-1] and len(ends) <= buckets
    assert packing.best_boundaries([], [], [], 3) == ([], 0)


def test_batches_fill_the_budget(spark):
    rng = random.Random(5)
    texts = [None, "", "one"] + [" ".join("w" for _ in range(rng.choice([1, 2, 7, 30, 31, 33, 400]))) for _ in range(300)] + ["w " * 5000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id here", "x", 1), (1, "twice", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, bucket int").repartition(3)
    got = packing.pack(df, budget=1000, buckets=4).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(d), len((t or "").split())) for d, t, *_ in rows)
    batches = {}
    for r in got:
        batches.setdefault(r.batch_id, []).append(r)
    for rows_ in batches.values():
        length = rows_[0].bucket_length
        assert len({r.bucket for r in rows_}) == 1 and all(r.padding == length - r.n_tokens >= 0 for r in rows_)
        assert sorted(r.row_in_batch for r in rows_) == list(range(len(rows_))) and (len(rows_) * length <= 1000 or len(rows_) == 1)
    for bucket in {r.bucket for r in got}:
        mine = [len(v) for k, v in batches.items() if v[0].bucket == bucket]
        assert sum(n < max(mine) for n in mine) <= 1
    assert len({r.bucket for r in got}) <= 4 and packing.pack(df.where("false")).count() == 0
