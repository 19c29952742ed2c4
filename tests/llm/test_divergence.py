import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.brute import lower_az
from tmengine.llm import divergence as op

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, least, top=10):
    docs = [tuple(x or "" for x in d) for d in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [(s, Counter(TERM.findall(lower_az(t)))) for la, s, t in docs if la == lang]
        df = Counter(w for _, c in mine for w in c)
        kept = sorted((w for w, n in df.items() if n >= least), key=lambda w: w.encode())
        names = sorted({s for s, _ in mine})
        count = {s: Counter() for s in names}
        for s, c in mine:
            count[s].update(c)
        count[None] = sum(count.values(), Counter())
        total = {s: sum(c[w] for w in kept) for s, c in count.items()}
        p = {s: {w: 1 + (10**9 * (c[w] + 2)) // (total[s] + 2 * len(kept)) for w in kept} for s, c in count.items()}
        f = lambda a, b, w: (p[a][w] - p[b][w]) ** 2 // (p[a][w] + p[b][w])
        for a in names:
            pairs = [(b, sum(f(a, b, w) for w in kept)) for b in names if b != a]
            terms = [(w, f(a, None, w)) for w in kept if count[a][w] and p[a][w] > p[None][w]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, a, part, item, v, k + 1) for k, (item, v) in enumerate(rows if part == "pair" else rows[:top])]
    return sorted(out)


def sample():
    rng = random.Random(5)
    words = ["Alpha", "beta", "ÄRGER", "中文", "don't", "x1y", "z", "É", "emoji😀", "ALPHA"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(260):
        lang, source = rng.choice(["de", "en", None, ""]), rng.choice(["web", "web", "web", "book", "ärz", None])
        rows.append((lang, source, " ".join(rng.choice(words[: 10 + (3 * len(source or "")) % 20]) for _ in range(rng.randrange(12)))))
    rows += [("one", "only", "alone alone")] * 12 + [("xx", "a", "rare"), ("xx", "b", None), ("xx", "c", "")] + [("en", "book", "beta " * 30_000)]
    return rows


def run(spark, rows, least=10, columns=None):
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "lang string, source string, text string, value long, rank string")
    out = op.source_divergence(docs.repartition(5), least)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("least", [1, 10])
def test_matches_plain_version(spark, least):
    rows = sample()
    assert run(spark, rows, least) == plain(rows, least)


def test_spills_and_pieces_change_nothing(spark, monkeypatch):
    rows = sample()
    for name, value in (("SPILL_CELLS", 20), ("FOLD_ENTRIES", 10), ("PIECE_CELLS", 25), ("DENSE_CELLS", 12), ("TEXT_BLOCK", 50)):
        monkeypatch.setattr(op, name, value)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    want, batches = plain(rows, 1), docs.toArrow().combine_chunks().to_batches(max_chunksize=7)
    filled = [pa.record_batch([pa.array([x or "" for x in b.column(k).to_pylist()]) for k in range(3)], names=["lang", "source", "text"]) for b in batches]
    spilled = pa.Table.from_batches(list(op.fold(iter(filled)))).sort_by([("lang", "ascending"), ("term", "ascending")])
    assert spilled.num_rows > len({(r["lang"], r["term"]) for r in spilled.to_pylist()})  # some keys were spilled more than once
    merged = pa.Table.from_batches(list(op.merge(iter(spilled.to_batches(max_chunksize=3))))).to_pylist()
    assert len(merged) == len({(r["lang"], r["term"]) for r in merged})
    assert run(spark, rows, 1) == want


def test_empty_table(spark):
    assert run(spark, []) == []


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    total = np.array([rng.randrange(1, 9 * 10**15) for _ in range(500)])
    count = np.array([rng.randrange(0, int(t)) for t in total])
    want = [1 + int(Fraction(10**9 * (int(c) + 2), int(t)) // 1) for c, t in zip(count, total)]
    assert op.shares(count, total).tolist() == want
