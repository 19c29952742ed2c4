import math
import random
import zlib

import numpy as np
import public_tokenizers

from tmengine.llm import lm_score as op

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def brute_base(rows):
    split = lambda t: (t or "").encode().translate(op.LOWER_AZ).split()
    counts, ends = {}, 0
    for doc, text in rows:
        if doc is None or zlib.crc32(str(doc).encode()) % 7 != 2:
            ends += 1
            for w in split(text):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for doc, text in rows:
        words = split(text)
        known = sum(w in counts for w in words) + (ends > 0)
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        out.append((str(doc), len(words) + 1, known, n, round(base, 4)))
    return sorted(out)


def sample():
    rng = random.Random(5)
    words = {k: ["".join(rng.choice(k) for _ in range(rng.randint(1, 6))) for _ in range(60)] for k in ("abcdeÉ", "uvwxyz")}
    rows = []
    for i in range(260):
        own = words[rng.choice(list(words))]
        rows.append((i, " ".join(own[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.randint(0, 120)))))
    return rows + [(300, None), (301, ""), (302, " \n"), (None, "null id"), (5, "again twice"), (303, "Z" * 5000), (304, "w " * 20_000)]


def test_base_and_model(spark, monkeypatch):
    rows = sample()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    scores = []
    for held in (op.HELD_WORDS, 10):
        monkeypatch.setattr(op, "HELD_WORDS", held)
        got = op.lm_scores(df, PATH, PATTERN).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == brute_base(rows)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
        twins = {r.doc_id: r.score for r in got}
        assert max(abs(twins[300] - twins[i]) for i in (301, 302)) < 1e-5
        scores.append(sorted((str(r.doc_id), r.n_tokens, r.score) for r in got))
    # a word's count enters its score whether tasks hold it or it is joined
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 0.02 + 1e-3 * abs(a[2]) for a, b in zip(*scores))
    assert op.lm_scores(df.where("false"), PATH, PATTERN).count() == 0


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    """Words come in runs of two languages and follow each other in pairs, which counts of single words cannot know."""
    rng = random.Random(4)
    words = {k: ["".join(rng.choice(k) for _ in range(rng.randint(2, 6))) for _ in range(80)] for k in ("abcdeé", "uvwxyz")}
    rows = []
    for i in range(600):
        own = words[rng.choice(list(words))]
        firsts = [min(int(rng.expovariate(0.05)), 79) for _ in range(40)]
        rows.append((i, " ".join(f"{own[k]} {own[(k + 7) % 80]}" for k in firsts)))
    got = op.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), PATH, PATTERN).where("held_out").collect()
    n = sum(r.n_tokens for r in got)
    assert n > 2000 and sum(r.score for r in got) / n > sum(r.base_score for r in got) / n + 0.2


def random_weights(rng, classes):
    w = {k: v.astype(float) for k, v in op.new_weights(rng.integers(0, 5, (classes, classes)).astype(float)).items()}
    w["out"] += rng.normal(0, 0.3, w["out"].shape)
    return w


def test_gradients():
    rng = np.random.default_rng(0)
    c = op.CLASSES
    w = random_weights(rng, c)
    near, far, target = (rng.integers(0, c, (3, op.WINDOW)) for _ in range(3))
    real = (rng.random((3, op.WINDOW)) < 0.8) * 1.0
    loss = lambda: -(op.target_logs(op.forward(w, near, far, op.WINDOW)["logits"], target) * real).sum() / real.sum()
    g = op.gradients(w, near, far, target, real)
    assert set(g) == set(w) - {"pair"}  # the class-pair table is counted
    for k in g:
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        kept, e = w[k][i], 1e-4
        w[k][i] = kept + e
        up = loss()
        w[k][i] = kept - e
        down = loss()
        w[k][i] = kept
        assert abs((up - down) / 2 / e - g[k][i]) < 1e-6


def test_pair_table_holds_exact_counts_of_all_sequences(spark, monkeypatch):
    """Every sequence comes back whole however it is cut, every pair of neighbours is counted, and training leaves the table as it is."""
    rng = random.Random(6)
    rows = [(i % 3 == 0, [rng.randrange(1, 6) for _ in range(rng.choice([0, 1, 5, 40]))]) for i in range(50)] + [(True, [2] * 3000)]
    df = spark.createDataFrame([(w, " ".join(map(str, v))) for w, v in rows], "warm boolean, text string").repartition(3)

    def sequences(column):
        for text in column.to_pylist():
            near = np.array([op.START, *map(int, text.split())], np.int16)
            yield near, near + 100, np.array([len(near)])

    table = op.encoded(df, "text", sequences)
    got = sorted((r.warm, list(r.near), [b - 100 for b in r.far]) for r in table.collect())
    assert got == sorted((w, [0, *v], [0, *v]) for w, v in rows)
    want = np.zeros((8, 8))
    for _, v in rows:
        for a, b in zip([0, *v], [*v, 0]):
            want[a, b] += 1
    assert np.array_equal(op.pair_counts(table, 8), want)
    batch = table.select("near", "far").toArrow().combine_chunks().to_batches()[0]
    for places in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(op, "PLACES", places)
        parts = list(op.decoded(iter([batch.slice(0, 0), batch.slice(2), batch.slice(0, 2)])))
        met = [tuple(x) for near, _, n in parts for x in np.split(near, np.cumsum(n)[:-1])]
        assert sorted(met) == sorted((0, *v) for _, v in rows)
        assert all(np.array_equal(near + 100, far) and (len(near) <= places or len(n) == 1) for near, far, n in parts)
    assert np.allclose(op.fit(table, 200)["pair"], op.new_weights(op.pair_counts(table, 200))["pair"])
    assert np.isfinite(op.fit(table.where("false"), 8)["pair"]).all()


def plain_logs(w, near, far):
    """Sum of the log shares of each next class (START ends), one place at a time, each from the places its window shows it."""
    total = 0.0
    x = w["near"][near] + w["far"][far]
    for p, target in enumerate([*near[1:], op.START]):
        begin = 0 if p < op.WINDOW else -(-(p - op.WINDOW + 1) // op.STRIDE) * op.STRIDE
        query = x[p] @ w["query"] / math.sqrt(op.WIDTH)
        weight = np.array([math.exp(query @ (x[j] @ w["key"]) + w["distance"][p - j]) for j in range(begin, p + 1)])
        seen = sum(a * (x[j] @ w["value"]) for a, j in zip(weight / weight.sum(), range(begin, p + 1)))
        logits = np.tanh(x[p] @ w["own"] + seen) @ w["out"] + w["pair"][near[p]]
        total += logits[target] - math.log(np.exp(logits).sum())
    return total


def test_whole_scores_by_a_plain_version(spark, monkeypatch):
    """With given weights, each text's score is the product of class and word shares computed place by place."""
    rng = np.random.default_rng(8)
    weights = {c: random_weights(rng, c) for c in (op.CLASSES, op.SPELLING_CLASSES)}
    made = []
    build = op.Lexicon.__init__
    monkeypatch.setattr(op, "fit", lambda rows, classes: weights[classes])
    monkeypatch.setattr(op.Lexicon, "__init__", lambda self, *a: (build(self, *a), made.append(self))[0])
    monkeypatch.setattr(op, "HELD_WORDS", 10)
    rows = [r for r in sample() if r[0] is None or r[0] < 40 or r[0] in (300, 301)] + [(303, "Zq" * 60), (304, "w x " * 60)]
    got = op.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, PATTERN).collect()
    counts = {}
    for doc, text in rows:
        if doc is None or zlib.crc32(str(doc).encode()) % 7 != 2:
            for word in op.words_of((text or "").encode()):
                counts[word] = counts.get(word, 0) + 1
    lex = made[0]
    assert 0 < len(lex.held) <= 10 < len(counts)
    codec, described = op.Codec.of(PATH, PATTERN), {}

    def describe(word):
        if word not in described:
            ids = np.asarray(codec.encode_words([word])[0])
            first, near = lex.first_class[ids[0]], lex.inner_class[ids].astype(int)
            spelt = plain_logs(weights[op.SPELLING_CLASSES], near, np.array([op.START, *near[:-1]])) + lex.log_first[ids[0]] + lex.log_inner[ids[1:]].sum()
            own = max(counts.get(word, 0) - lex.discount, 0) + lex.spelt_mass[first] * math.exp(spelt)
            described[word] = int(first), int(lex.last_class[ids[-1]]), math.log10(own / lex.mass[first])
        return described[word]

    want = []
    for doc, text in rows:
        parts = [describe(word) for word in op.words_of((text or "").encode())]
        near, far = (np.array([op.START, *(p[k] for p in parts)]) for k in (0, 1))
        want.append((str(doc), len(parts) + 1, plain_logs(weights[op.CLASSES], near, far) / math.log(10) + sum(p[2] for p in parts)))
    for a, b in zip(sorted((str(r.doc_id), r.n_tokens, r.score) for r in got), sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4 * (1 + abs(b[2])), (a, b)


def test_windows_hold_every_place_once_and_scores_do_not_depend_on_company():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 5, 33, 24, 25, 100, 48, 49])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    near, far = (rng.integers(1, op.CLASSES, lengths.sum()) for _ in range(2))
    near[start], far[start] = op.START, op.START
    met = []
    for a, b, target, real in op.windows(near, far, lengths, block=60):
        inside = real > 0
        met += zip(a[inside].tolist(), b[inside].tolist(), target[inside].tolist())
    wanted = []
    for s, n in zip(start, lengths):
        wanted += zip(near[s : s + n].tolist(), far[s : s + n].tolist(), [*near[s + 1 : s + n].tolist(), op.START])
    assert sorted(met) == sorted(wanted)
    w = random_weights(rng, op.CLASSES)
    whole = op.sequence_logs(w, near, far, lengths)
    assert np.allclose(whole, [op.sequence_logs(w, near[s : s + n], far[s : s + n], np.array([n]))[0] for s, n in zip(start, lengths)])
    # by hand: each place sees those before it in its window
    logits = op.forward(w, near[None, start[2] : start[2] + 24], far[None, start[2] : start[2] + 24], 24)["logits"][0]
    share = np.exp(logits) / np.exp(logits).sum(-1, keepdims=True)
    by_hand = np.log(share[np.arange(24), np.append(near[start[2] + 1 : start[2] + 24], near[start[2] + 24])]).sum()
    alone = op.sequence_logs(w, near[start[2] : start[2] + 24], far[start[2] : start[2] + 24], np.array([24]))[0]
    assert abs(by_hand - np.log(share[23, near[start[2] + 24]]) + np.log(share[23, op.START]) - alone) < 1e-6


def test_shares_of_a_class_sum_to_one(spark):
    """The spelling network's shares and the lexicon's counts are distributions."""
    rng = np.random.default_rng(3)
    w = random_weights(rng, op.SPELLING_CLASSES)
    near = rng.integers(0, op.SPELLING_CLASSES, (2, 6))
    share = np.exp(op.forward(w, near, near, 4)["logits"])
    share /= share.sum(-1, keepdims=True)
    assert np.allclose(share.sum(-1), 1)
    words = spark.createDataFrame([("ab", 5), ("abc", 1), ("the", 9), ("then", 2), ("zq", 1)], "word string, n long")
    held, least = op.frequent_words(words, 3)
    assert held == {b"ab": 5, b"the": 9, b"then": 2} and 0 < least <= 8
    assert op.frequent_words(words, 5)[1] <= 0 and len(op.frequent_words(words, 5)[0]) == 5 and op.frequent_words(words.where("false"), 5) == ({}, 1)
    lexicon = op.Lexicon(PATH, PATTERN, op.id_pairs(words, PATH, PATTERN), held, 0.5)
    for k in range(1, op.CLASSES):
        own = lexicon.first_class == k
        if own.any():
            assert abs(np.exp(lexicon.log_first[own]).sum() - 1) < 1e-9
    for k in range(1, op.SPELLING_CLASSES):
        own = lexicon.inner_class == k
        if own.any():
            assert abs(np.exp(lexicon.log_inner[own]).sum() - 1) < 1e-9


def test_attention_is_causal():
    rng = np.random.default_rng(1)
    w = op.new_weights(np.ones((op.CLASSES, op.CLASSES)))
    w["out"] += rng.normal(0, 0.3, w["out"].shape).astype(np.float32)
    a = rng.integers(0, op.CLASSES, (1, op.WINDOW))
    b = a.copy()
    b[0, 20:] = (b[0, 20:] + 1) % op.CLASSES
    x, y = (op.forward(w, v, v, op.WINDOW)["logits"] for v in (a, b))
    assert np.allclose(x[0, :20], y[0, :20], atol=1e-5) and not np.allclose(x[0, 20:], y[0, 20:])


def test_texts_are_described_once_for_training_and_scoring():
    """One look-up of a text's words gives its classes as bytes, as the training reads them, and all of its score but the classes' shares."""
    table = {b"a": (3, 4, -1.0, -2.0, 9), b"b": (5, 6, -2.5, -3.5, -1), b"c": (7, 8, -0.5, -1.5, 0)}
    looked = []

    def describe(words):
        looked.extend(words)
        return np.array([table[w] for w in words], float)

    near, far, known, base, shares, rare, spelt = op.described([[b"a", b"b"], [], [b"b", b"c", b"a", b"b"]], op.MetWords(describe, 5))
    assert sorted(looked) == [b"a", b"b", b"c"]
    assert [list(x) for x in near.to_pylist()] == [[0, 3, 5], [0], [0, 5, 7, 3, 5]] and [list(x) for x in far.to_pylist()] == [[0, 4, 6], [0], [0, 6, 8, 4, 6]]
    assert list(known) == [1, 0, 1] and np.allclose(base, [1, 0, 1]) and np.allclose(shares, [-3.5, 0, -6.5])
    assert rare.to_pylist() == [["b"], [], ["b", "b"]] and spelt.to_pylist() == [[-3.5], [], [-3.5, -3.5]]
