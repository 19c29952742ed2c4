"""Language-model scores: causal self-attention in numpy over subword ids.

A word is its byte-level BPE ids. Two networks of one shape, both causal self-attention, share the work. The context
network reads the first and last ids of the words so far and predicts the class of the next word's first id. The
spelling network reads a word's ids so far and predicts the class of its next id, or its end; so it runs once for each
distinct word of a task, not once for each token. A class holds one frequent id or a band of rarer ids of like
neighbours, whose shares come from counts. Inside its first id's class a word has its discounted count, and the
discounted mass goes to words by their spelling. All parts are proper distributions, so a score is the log10
probability of the whole word sequence with its end.

Counts cover every training document, the context network learns from every window of every training document, and the
spelling network from every distinct training word. A network's table of class pairs is no learnt weight: it holds the
smoothed log shares of exact counts over all windows, and attention learns what they leave open. Tasks run Adam over
their windows from common weights, and the driver averages the tasks' weights, so scores differ a little with the number
of tasks.
"""

from __future__ import annotations

import ctypes
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmengine.llm.bpe import Codec
from tmengine.llm.common import LOWER_AZ, discard, materialize, texts

#: Classes of the context network (first and last ids of words) and of the spelling network, each with BANDS bands of rarer ids.
CLASSES, SPELLING_CLASSES, BANDS, WIDTH = 96, 192, 16, 16
VOCABULARY = 50_256
WINDOW, STRIDE = 24, 16
#: The most frequent words, whose counts every task holds; the others' counts are joined by word.
HELD_WORDS = 100_000
CACHED_WORDS = 600_000
#: Places of windows worked on together: few enough for the processor's cache, enough to hide numpy's calls.
BLOCK, RATE = 1536, 0.01
#: A first round on one text (or word) of so many gives the tasks common weights to start from; the second takes all.
WARM_SHARE = 32
#: Places of encoded sequences that a task works on together, besides the longest one.
PLACES = 1 << 18
PROJECTIONS = ("value", "query", "key", "own")
START = 0  # class 0 starts a sequence as input and ends it as target


# --- the network --------------------------------------------------------------------------------------------------


def new_weights(bigram: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; the class-pair table is the smoothed log shares of ``bigram`` counts."""
    rng = np.random.default_rng(seed)
    c, d = len(bigram), WIDTH
    total = bigram.sum(1, keepdims=True)
    back = (bigram.sum(0) + 0.5) / (bigram.sum() + 0.5 * c)
    table = np.log((bigram + 20.0 * back) / (total + 20.0))
    w = {"near": rng.normal(0, 0.3, (c, d)), "far": rng.normal(0, 0.3, (c, d))}
    w |= {k: rng.normal(0, 1 / np.sqrt(d), (d, d)) for k in ("query", "key", "value", "own")}
    w |= {"distance": np.zeros(WINDOW), "out": np.zeros((d, c)), "pair": table}
    return {k: v.astype(np.float32) for k, v in w.items()}


def forward(w: dict, near: np.ndarray, far: np.ndarray, scored: int) -> dict[str, np.ndarray]:
    """Log shares of the next class at the final ``scored`` places of windows (rows, length) of input classes.

    A place has two input classes: in the context network a word's first and last ids, in the spelling network
    the latest id and the one before. Embeddings pass through the projections as tables of one row a class, so
    nothing but attention itself and the output layer is multiplied for each place.
    """
    n = near.shape[1]
    x = {}
    for names, at, scale in ((("key", "value"), 0, 1.0), (("query", "own"), n - scored, 1 / np.sqrt(WIDTH))):
        both = np.concatenate([w[names[0]] * np.asarray(scale, w["key"].dtype), w[names[1]]], 1)
        rows = np.take(w["near"] @ both, near[:, at:], axis=0, mode="clip")
        rows += np.take(w["far"] @ both, far[:, at:], axis=0, mode="clip")
        x[names[0]], x[names[1]] = rows[..., :WIDTH], rows[..., WIDTH:]
    scores = x["query"] @ x["key"].transpose(0, 2, 1)
    gap = np.arange(n - scored, n)[:, None] - np.arange(n)[None, :]
    scores += np.where(gap >= 0, w["distance"][np.maximum(gap, 0)], -np.inf).astype(scores.dtype)
    np.minimum(scores, 60, out=scores)  # in place of taking each row's maximum away
    np.exp(scores, out=scores)
    scores *= (1 / (scores @ np.ones(n, scores.dtype) + 1e-30).astype(scores.dtype))[..., None]
    hidden = np.tanh(x["own"] + scores @ x["value"])
    logits = hidden.reshape(-1, WIDTH) @ w["out"]
    logits = logits.reshape(*hidden.shape[:2], -1)
    logits += np.take(w["pair"], near[:, n - scored :], axis=0, mode="clip")
    return x | {"attention": scores, "hidden": hidden, "logits": logits, "gap": gap}


def target_logs(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log share of each target class; uses up ``logits``, which lie close enough for one common offset."""
    logits -= logits.max()
    target_at = np.take_along_axis(logits, target[..., None].astype(np.int64), -1)[..., 0]
    np.exp(logits, out=logits)
    return target_at - np.log(logits @ np.ones(logits.shape[-1], logits.dtype))


def gradients(w: dict, near: np.ndarray, far: np.ndarray, target: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean negative log share over the ``real`` places, of all but the class-pair table, which is counted."""
    f = forward(w, near, far, near.shape[1])
    size = f["logits"].shape[-1]
    flat = f["logits"].reshape(-1, size)
    flat -= flat.max()
    np.exp(flat, out=flat)
    weight = (real.ravel() / max(1.0, real.sum())).astype(flat.dtype)
    flat *= (weight / (flat @ np.ones(size, flat.dtype)))[:, None]
    flat[np.arange(len(flat)), target.ravel()] -= weight
    hidden = f["hidden"].reshape(-1, WIDTH)
    g = {"out": hidden.T @ flat}
    d_sum = ((flat @ w["out"].T) * (1 - hidden * hidden)).reshape(f["hidden"].shape)
    d_scores = d_sum @ f["value"].transpose(0, 2, 1)
    d_scores -= ((d_scores * f["attention"]) @ np.ones(near.shape[1], flat.dtype))[..., None]
    d_scores *= f["attention"]
    g["distance"] = np.bincount(np.maximum(f["gap"], 0).ravel(), d_scores.sum(0).ravel(), WINDOW).astype(np.float32)
    d_query = (d_scores @ f["key"]) * np.asarray(1 / np.sqrt(WIDTH), flat.dtype)  # forward's queries are scaled already
    d = np.concatenate([f["attention"].transpose(0, 2, 1) @ d_sum, d_query, d_scores.transpose(0, 2, 1) @ f["query"], d_sum], -1)
    d = d.reshape(-1, len(PROJECTIONS) * WIDTH)  # side by side, so that each product below is one
    d_x = d @ np.concatenate([w[k] for k in PROJECTIONS], 1).T
    x = np.take(w["near"], near.ravel(), axis=0, mode="clip") + np.take(w["far"], far.ravel(), axis=0, mode="clip")
    g |= dict(zip(PROJECTIONS, np.split(x.T @ d, len(PROJECTIONS), 1)))
    for name, at in (("near", near), ("far", far)):
        cell = at.reshape(-1, 1).astype(np.int64) * WIDTH + np.arange(WIDTH)
        g[name] = np.bincount(cell.ravel(), d_x.ravel(), size * WIDTH).reshape(size, WIDTH).astype(flat.dtype)
    return g


def train(w: dict, batches: Iterator[tuple], rate: float) -> dict[str, np.ndarray]:
    """Adam over the batches, from the given weights, with steps that shrink slowly; the class-pair table stays as counted."""
    w = {k: v.copy() for k, v in w.items()}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    for step, batch in enumerate(batches, 1):
        now = rate / np.sqrt(1 + step / 200)
        for k, g in gradients(w, *batch).items():
            m[k] += np.float32(0.1) * (g - m[k])
            s[k] += np.float32(0.01) * (g * g - s[k])
            w[k] -= np.float32(now) * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(s[k] / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return w


def keep_freed_memory() -> None:
    """Let this process keep freed blocks below 32 MB for the next arrays: numpy's temporaries else fault in new pages each time."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library; only slower
        pass


# --- sequences ----------------------------------------------------------------------------------------------------


def pieces_of(sizes: np.ndarray, block: int) -> list[tuple[int, int]]:
    """Cut ascending sizes into runs whose number times their largest is about ``block``."""
    out, at = [], 0
    while at < len(sizes):
        upto = min(len(sizes), at + max(1, block // int(sizes[at])))
        upto = min(upto, at + max(1, block // int(sizes[upto - 1])))
        out.append((at, upto))
        at = upto
    return out


def windows(near: np.ndarray, far: np.ndarray, lengths: np.ndarray, seed: int = 0, block: int = BLOCK) -> Iterator[tuple]:
    """Consecutive windows over all places of sequences that lie one after another (START at each head), in batches.

    Gives (near, far, target, real). Windows of like length share a batch, and batches come in a random order.
    """
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    target = np.roll(near, -1)
    target[start + lengths - 1] = START
    n = -(-lengths // WINDOW)
    who = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    begin, left = start[who] + nth * WINDOW, np.minimum(WINDOW, lengths[who] - nth * WINDOW)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(begin))
    order = order[np.argsort(left[order], kind="stable")]
    pieces = pieces_of(left[order], block)
    for k in rng.permutation(len(pieces)).tolist():
        own = order[slice(*pieces[k])]
        place = np.arange(int(left[own].max()))
        inside = place[None, :] < left[own][:, None]
        index = np.where(inside, begin[own][:, None] + place[None, :], begin[own][:, None])
        yield near[index], far[index], target[index], inside.astype(np.float32)


def sequence_logs(w: dict, near: np.ndarray, far: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Sum of the targets' log shares for each sequence; they lie one after another, START at each head.

    A sequence's first window scores all its places; each further one moves on by STRIDE and scores its final
    STRIDE places, so every token is scored once with at least WINDOW - STRIDE places before it.
    """
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    near, far = np.concatenate([near, np.zeros(WINDOW, near.dtype)]), np.concatenate([far, np.zeros(WINDOW, far.dtype)])
    target = np.roll(near, -1)
    target[start + lengths - 1] = START
    out = np.zeros(len(lengths))
    more = np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    who = np.repeat(np.arange(len(lengths)), more)
    nth = np.arange(int(more.sum())) - np.repeat(np.concatenate([[0], np.cumsum(more)[:-1]]), more)
    by_length = np.argsort(lengths, kind="stable")  # short sequences together, in windows as long as the longest of them
    jobs = [(by_length, start[by_length], WINDOW), (who, start[who] + (nth + 1) * STRIDE, STRIDE)]
    for owner, begin, scored in jobs:
        sizes = np.minimum(WINDOW, lengths[owner]) if scored == WINDOW else np.full(len(owner), WINDOW)
        for at, upto in pieces_of(sizes, block):
            o, b = owner[at:upto], begin[at:upto]
            size = int(sizes[upto - 1])
            final = min(size, scored)
            index = b[:, None] + np.arange(size)[None, :]
            inside = index < (start[o] + lengths[o])[:, None]
            index = np.where(inside, index, b[:, None])  # what lies past the end is masked: nothing before it sees it
            logits = forward(w, near[index], far[index], final)["logits"]
            logs = target_logs(logits, target[index[:, size - final :]])
            out += np.bincount(o, (logs * inside[:, size - final :]).sum(1), len(lengths))
    return out


# --- vocabulary and counts ----------------------------------------------------------------------------------------


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than space, tab, newline, vertical tab, form feed and carriage return; A-Z lowered."""
    return text.translate(LOWER_AZ).split()


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts; tasks hold and sum the counts of many texts before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in texts(batch.column("text")):
                seen.update(words_of(text))
                if len(seen) > CACHED_WORDS:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_pairs(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(a, b, n, types)``: tokens and distinct words in which id a comes just before id b; -1 is either edge."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            ids, start = codec.encode_words([w.encode() for w in batch["word"]])
            n = np.repeat(batch["n"].to_numpy(float), np.diff(np.append(start, len(ids))))
            before, after = np.append(-1, ids[:-1]), np.append(ids[1:], -1)
            before[start], after[start[1:] - 1] = -1, -1
            ends = np.append(start[1:] - 1, len(ids) - 1) if len(ids) else start
            a, b, m = np.append(before, ids[ends]), np.append(ids, np.full(len(ends), -1)), np.append(n, n[ends])
            key, at = np.unique((a + 1) * (VOCABULARY + 1) + b + 1, return_inverse=True)
            a, b = key // (VOCABULARY + 1) - 1, key % (VOCABULARY + 1) - 1
            yield pd.DataFrame({"a": a, "b": b, "n": np.bincount(at, m, len(key)).astype(np.int64), "types": np.bincount(at, minlength=len(key))})

    found = words.mapInPandas(run, "a int, b int, n long, types long").groupBy("a", "b")
    return materialize(found.agg(F.sum("n").alias("n"), F.sum("types").alias("types")))


def by_id(pairs: DataFrame, column: str, value: str = "n") -> np.ndarray:
    """Sums by id; one row for each id of the vocabulary at most."""
    out = np.zeros(VOCABULARY)
    found = pairs.groupBy(column).agg(F.sum(value).alias("n")).toPandas()
    out[found[column].to_numpy(int)] = found["n"].to_numpy(float)
    return out


def id_classes(counts: np.ndarray, classes: int, group: np.ndarray) -> np.ndarray:
    """Classes 1.. of all ids: one for each frequent id, by falling count, and a band for each group of the rest."""
    single = classes - BANDS - 1
    order = np.argsort(-counts, kind="stable")
    out = np.zeros(len(counts), np.int16)
    out[order[:single]] = 1 + np.arange(single)
    out[order[single:]] = 1 + single + group[order[single:]]
    return out


def clusters(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Weighted k-means with spread-out first centres; the cluster of every row."""
    rng = np.random.default_rng(3)
    centres = x[[int(np.argmax(weight))]]
    while len(centres) < min(k, len(x)):
        far = weight * np.min(((x[:, None, :] - centres[None]) ** 2).sum(-1), 1)
        if far.sum() <= 0:
            break
        centres = np.concatenate([centres, x[[int(np.argmax(np.cumsum(far) >= rng.random() * far.sum()))]]])
    for _ in range(rounds):
        band = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), 1)
        for c in range(len(centres)):
            if weight[band == c].sum() > 0:
                centres[c] = np.average(x[band == c], 0, weight[band == c])
    return np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), 1)


def id_groups(pairs: DataFrame, types: np.ndarray, frequent: int = 96) -> np.ndarray:
    """One of BANDS groups for every id, by its neighbours inside words.

    The ``frequent`` ids are clustered by their neighbours among themselves; any other id joins the group that
    is most over-represented beside it. Spark sends one row for each pair of frequent ids and each id at most.
    """
    spark = pairs.sparkSession
    top = np.argsort(-types, kind="stable")[:frequent]
    place = spark.createDataFrame(pd.DataFrame({"id": top.astype(np.int32), "p": np.arange(frequent, dtype=np.int32)}))
    place = F.broadcast(place)  # ``frequent`` rows
    inner = pairs.where("a >= 0 and b >= 0").select("a", "b", "types")
    both = inner.union(inner.select("b", "a", "types")).join(place.select(F.col("id").alias("b"), "p"), "b").select(F.col("a").alias("id"), "p", "types")
    square = both.join(place.select("id", F.col("p").alias("q")), "id").groupBy("p", "q").agg(F.sum("types").alias("n")).toPandas()
    near = np.zeros((frequent, frequent))
    near[square["p"].to_numpy(int), square["q"].to_numpy(int)] = square["n"].to_numpy(float)
    weight = near.sum(1) + 1e-9
    share = near.sum(0) / max(near.sum(), 1.0)
    group = clusters(np.sqrt((near + 5 * share) / (weight[:, None] + 5)), weight, BANDS)
    mass = np.bincount(group, weight, BANDS)
    named = F.broadcast(spark.createDataFrame(pd.DataFrame({"p": np.arange(frequent, dtype=np.int32), "g": group.astype(np.int32), "mass": mass[group]})))
    beside = both.join(named, "p").groupBy("id", "g").agg((F.sum("types") / (F.first("mass") + 1)).alias("n"))
    best = beside.groupBy("id").agg(F.max(F.struct("n", "g"))["g"].alias("g")).toPandas()
    out = np.full(VOCABULARY, int(np.argmax(mass)))
    out[best["id"].to_numpy(int)] = best["g"].to_numpy(int)
    out[top] = group
    return out


class Lexicon:
    """What is known of words whatever their context, from counts over all training documents.

    A word's share among the words of its first id's class is its discounted count, and the discounted mass by
    its spelling: (max(c - d, 0) + (d T + 1/2) s) / (N + 1/2) with the class's N tokens and T types, the
    discount d and the spelling's probability s, which sums to one over the words of the class.
    """

    def __init__(self, path: str, pattern: str, pairs: DataFrame, held: dict[bytes, int], discount: float) -> None:
        self.path, self.pattern, self.held, self.discount = path, pattern, held, discount
        starts, later = pairs.where("a = -1"), pairs.where("a >= 0 and b >= 0")
        tokens, types, inner = by_id(starts, "b"), by_id(starts, "b", "types"), by_id(later, "b", "types")
        group = id_groups(pairs, types + inner)
        self.first_class, self.last_class = id_classes(tokens, CLASSES, group), id_classes(types + inner, CLASSES, group)
        self.inner_class = id_classes(inner, SPELLING_CLASSES, group)
        self.log_first = np.log((types + 0.05) / np.bincount(self.first_class, types + 0.05, CLASSES)[self.first_class])
        self.log_inner = np.log((inner + 0.01) / np.bincount(self.inner_class, inner + 0.01, SPELLING_CLASSES)[self.inner_class])
        self.mass = np.bincount(self.first_class, tokens, CLASSES) + 0.5
        self.spelt_mass = discount * np.bincount(self.first_class, types, CLASSES) + 0.5

    def spelling(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words as the spelling network's sequences (near, far, lengths), with their ids and where each word's start."""
        ids, start = Codec.of(self.path, self.pattern).encode_words(words)
        near = self.inner_class[ids]
        far = np.concatenate([[0], near[:-1]])
        far[start] = START
        return near, far, np.diff(np.append(start, len(ids))), ids, start

    def describe(self, weights: dict, words: list[bytes]) -> np.ndarray:
        """Rows (first class, last class, log10 of share, log10 of spelt count, count or -1) of the words.

        A word that is not held has the share of its spelling alone, to be mended where its count is joined.
        """
        near, far, lengths, ids, start = self.spelling(words)
        inner = self.log_inner[ids]
        inner[start] = self.log_first[ids[start]]
        first = self.first_class[ids[start]]
        spelt = (sequence_logs(weights, near, far, lengths) + np.add.reduceat(inner, start)) / np.log(10) + np.log10(self.spelt_mass[first])
        count = np.fromiter((self.held.get(w, -1) for w in words), float, len(words))
        share = np.where(count < 0, spelt, np.log10(np.maximum(count - self.discount, 1e-9) + 10**spelt)) - np.log10(self.mass[first])
        return np.column_stack([first, self.last_class[ids[start + lengths - 1]], share, spelt, count])


class MetWords:
    """Rows of ``describe`` for the words met so far in this Python worker, up to CACHED_WORDS of them."""

    _latest: tuple = (None, None)

    @classmethod
    def of(cls, owner: object, describe: Callable, width: int) -> "MetWords":
        """The worker's table, kept between tasks as long as they have the same ``owner``."""
        if cls._latest[0] is not owner:
            cls._latest = (owner, cls(describe, width))
        return cls._latest[1]

    def __init__(self, describe: Callable, width: int) -> None:
        self.describe, self.width = describe, width
        self.clear(CACHED_WORDS)

    def clear(self, size: int) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((size, self.width))

    def places(self, flat: list[bytes]) -> np.ndarray:
        """Each word's row; unknown words are described first."""
        at = np.fromiter(map(self.at.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list({flat[i] for i in missing})
            if len(self.at) + len(new) > len(self.rows):
                new = list(set(flat))
                self.clear(max(CACHED_WORDS, len(new)))
                missing = range(len(flat))
            self.rows[len(self.at) : len(self.at) + len(new)] = self.describe(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            at[missing] = [self.at[flat[i]] for i in missing]
        return at


def text_sequences(group: list[list[bytes]], met: MetWords) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as the context network's sequences (near, far, lengths), with each word's row and its text."""
    flat = list(chain.from_iterable(group))
    at = met.places(flat)
    lengths = np.array([len(words) for words in group], np.int64)
    owner = np.repeat(np.arange(len(group)), lengths)
    place = np.arange(len(flat)) + owner + 1  # after one START for each text so far
    near, far = (np.full(len(flat) + len(group), START, np.int16) for _ in range(2))
    near[place], far[place] = met.rows[at, 0], met.rows[at, 1]
    return near, far, lengths + 1, at, owner


# --- training -----------------------------------------------------------------------------------------------------


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of ``(at, value)`` over all tasks, as a vector; only the sums reach the driver."""
    found = rows.groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(size)
    out[found["at"].to_numpy(int)] = found["value"].to_numpy(float)
    return out


def encoded(rows: DataFrame, column: str, sequences: Callable[[pa.Array], Iterator[tuple]]) -> DataFrame:
    """``(warm, near, far)`` for each text of ``column``, one byte a place, written once for all passes of the training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for near, far, lengths in sequences(batch.column(column)):
                both = (as_bytes(v, lengths) for v in (near, far))
                yield pa.RecordBatch.from_arrays([batch.column("warm").slice(at, len(lengths)), *both], names=["warm", "near", "far"])
                at += len(lengths)

    return materialize(rows.mapInArrow(run, "warm boolean, near binary, far binary"))


def as_bytes(classes: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Sequences that lie one after another, one byte a place."""
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets, pa.py_buffer(classes.astype(np.uint8))])


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences (near, far, lengths) of ``encoded`` rows, about PLACES places at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        near, far = (batch.column(k).cast(pa.large_binary()) for k in ("near", "far"))
        offsets, other = (np.frombuffer(v.buffers()[1], np.int64, len(v) + 1, v.offset * 8) for v in (near, far))
        near, far = (np.frombuffer(v.buffers()[2], np.uint8) for v in (near, far))
        at = 0
        while at < len(offsets) - 1:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PLACES, "right")) - 1)
            yield near[offsets[at] : offsets[upto]], far[other[at] : other[upto]], np.diff(offsets[at : upto + 1])
            at = upto


def pair_counts(rows: DataFrame, classes: int) -> np.ndarray:
    """How often each class follows each other one (START ends a sequence), over all ``encoded`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(classes * classes)
        for near, _, lengths in decoded(batches):
            target = np.roll(near, -1)
            target[np.cumsum(lengths) - 1] = START
            out += np.bincount(near.astype(np.int64) * classes + target, minlength=classes * classes)
        yield vector(out)

    return summed(rows.select("near", "far").mapInArrow(run, "at int, value double"), classes * classes).reshape(classes, classes)


def vector(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["at", "value"])


def fit(rows: DataFrame, classes: int) -> dict[str, np.ndarray]:
    """Train on all windows of all ``encoded`` rows; those marked ``warm`` also start the weights off.

    The class pairs of all rows are counted. The marked rows give a first round; then every task trains on all its
    windows. After each round the weights are averaged over the tasks by their numbers of windows.
    """

    def learn(w: dict, rate: float) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_freed_memory()
            seen = [0]

            def cut() -> Iterator[tuple]:
                for k, found in enumerate(decoded(batches)):
                    for batch in windows(*found, seed=k):
                        seen[0] += len(batch[0])
                        yield batch

            new = train(w, cut(), rate)
            yield vector(np.concatenate([[1.0], *(new[k].ravel().astype(np.float64) for k in learnt)]) * seen[0])

        return run

    w = new_weights(pair_counts(rows, classes))
    learnt = sorted(w.keys() - {"pair"})
    size = sum(w[k].size for k in learnt)
    for table, rate in ((rows.where("warm"), RATE), (rows, RATE / 2)):
        total = summed(table.select("near", "far").mapInArrow(learn(w, rate), "at int, value double"), size + 1)
        if total[0]:
            at = 1
            for k in learnt:
                w[k] = (total[at : at + w[k].size] / total[0]).reshape(w[k].shape).astype(np.float32)
                at += w[k].size
    return w


# --- scoring ------------------------------------------------------------------------------------------------------


def frequent_words(words: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """Counts of the words that occur at least some number of times, ``most`` of them at most; and that number.

    The number comes from a histogram of counts with eight steps a doubling, so no task sorts the words.
    """
    step = F.floor(F.log2("n") * 8)
    sizes = {int(r["k"]): int(r["n"]) for r in words.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, max(sizes, default=0) + 1
    while sizes and least > 0 and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    found = words.where(step >= least).toPandas()
    return {w.encode(): int(n) for w, n in zip(found["word"], found["n"])}, least


def lm_scores(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Learns from rows whose crc32(doc_id as text) mod 7 is not 2 (a null doc_id is learnt from), from all words
    and windows of theirs. Null text: empty, one token, the end. Repeated rows and ids are scored alone and
    counted each; an empty table gives no rows; other columns are ignored. Frequent words' counts are held by
    every task; the others', which are many but rare each, are joined by word into both scores, so no table
    that grows is broadcast.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2, F.lit(False))
    slim = slim.withColumn("held_out", held_out)
    training = slim.where(~F.col("held_out"))
    words = materialize(count_words(training))
    one, two = (F.coalesce(F.sum((F.col("n") == k).cast("long")), F.lit(0)) for k in (1, 2))
    head = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), one.alias("one"), two.alias("two")).first()
    ends = training.count()
    n_all, n_types = int(head["n"]) + ends, int(head["v"]) + (1 if ends else 0)
    discount = min(0.9, max(0.1, head["one"] / max(1, head["one"] + 2 * head["two"])))
    held, least = frequent_words(words, HELD_WORDS)
    pairs = id_pairs(words, path, pattern)
    shared = spark.sparkContext.broadcast(Lexicon(path, pattern, pairs, held, discount))

    def word_sequences(column: pa.Array) -> Iterator[tuple]:
        if len(column):
            yield shared.value.spelling([w.encode() for w in column.to_pylist()])[:3]

    spelt = words.select("word", (F.pmod(F.xxhash64("word"), F.lit(WARM_SHARE)) == 0).alias("warm"))
    table = encoded(spelt, "word", word_sequences)
    spelling = spark.sparkContext.broadcast(fit(table, SPELLING_CLASSES))
    discard(table)
    log_all = float(np.log10(n_all + n_types + 1))
    log_end = float(np.log10(ends + 1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        met = MetWords.of(spelling.value, lambda words: shared.value.describe(spelling.value, words), 5)
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for group in word_groups(batch.column("text")):
                n, m = len(group), np.array([len(ws) + 1 for ws in group], np.int64)
                near, far, known, base, shares, rare, spelt = described(group, met)
                known, base = known + (1 if ends else 0), base + log_end - m * log_all
                columns = [
                    pa.array((part << 40) + np.arange(row, row + n)), *(batch.column(k).slice(at, n) for k in ("doc_id", "held_out", "warm")),
                    pa.array(m), pa.array(known), pa.array(base), pa.array(shares), rare, spelt, near, far,
                ]
                at, row = at + n, row + n
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    schema = "row long, doc_id long, held_out boolean, warm boolean, n_tokens long, n_known long, base_score double, shares double, rare array<string>, spelt array<float>, near binary, far binary"
    warm = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(WARM_SHARE)) == 0
    table = materialize(slim.select("doc_id", "text", "held_out", warm.alias("warm")).mapInArrow(read, schema))
    context = spark.sparkContext.broadcast(fit(table.where(~F.col("held_out")), CLASSES))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for batch in batches:
            at = 0
            for near, far, lengths in decoded(iter([batch])):
                own = batch.slice(at, len(lengths))
                logs = sequence_logs(context.value, near, far, lengths) / np.log(10) + own.column("shares").to_numpy()
                at += len(lengths)
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in kept), pa.array(logs)], names=[*kept, "score"])

    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    rows = materialize(table.select(*kept, "shares", "near", "far").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    if least > 0:  # the words that no task holds: their counts are met by word
        asked = table.select("row", F.explode(F.arrays_zip("rare", "spelt")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.spelt").cast("double").alias("spelt"))
        met = asked.join(words.where(F.floor(F.log2("n") * 8) < least).hint("merge"), "word")
        own = F.col("n") - F.lit(discount)
        gain = F.log10(own) - F.col("spelt") + F.log10(F.pow(F.lit(10.0), F.col("spelt")) / own + 1)
        met = met.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("plus"), F.sum(gain).alias("gain"))
        rows = rows.join(met.hint("merge"), "row", "left")
        for column, more, none in (("n_known", "more", 0), ("base_score", "plus", 0.0), ("score", "gain", 0.0)):
            rows = rows.withColumn(column, F.col(column) + F.coalesce(more, F.lit(none)))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def word_groups(column: pa.Array, size: int = 1 << 20) -> Iterator[list[list[bytes]]]:
    """The words of consecutive texts of about ``size`` bytes together."""
    held, n = [], 0
    for text in texts(column):
        held.append(words_of(text))
        n += len(text)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def described(group: list[list[bytes]], met: MetWords) -> tuple:
    """For each text: its classes (near, far), words with a held count, sum of log10(count + 1) and of log10 shares, the other words with their spelt counts."""
    near, far, lengths, at, owner = text_sequences(group, met)
    n, found = len(group), met.rows[at]
    count = found[:, 4]
    others = np.flatnonzero(count < 0)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[others], minlength=n))]), pa.int32())
    flat = list(chain.from_iterable(group))
    rare = pa.ListArray.from_arrays(ends, pa.array([flat[i] for i in others.tolist()], pa.binary()).cast(pa.string()))
    spelt = pa.ListArray.from_arrays(ends, pa.array(found[others, 3].astype(np.float32)))
    known = np.bincount(owner, count > 0, n).astype(np.int64)
    base, shares = np.bincount(owner, np.log10(np.maximum(count, 0) + 1.0), n), np.bincount(owner, found[:, 2], n)
    return as_bytes(near, lengths), as_bytes(far, lengths), known, base, shares, rare, spelt


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scores(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
