"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled covariance and its diagonal. The score is the
logistic of the two classes' log-density difference, with Mahalanobis distances by cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmengine.llm.common import materialize, texts

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "stop", "exclaim", "symbol", "quote", "other_punct", "wide",
    "space", "log_lines", "log_words_per_line", "distinct_words", "repeated_lines", "top_word", "upper_words", "marked_words", "log_longest",
)

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?", "exclaim": b"!", "symbol": b"#*$%&|<>", "quote": b"\"'`", "space": b" \t\n\r\x0b\x0c"}
_CLASS = np.zeros(256, np.int64)
for _k, _members in enumerate(_KINDS.values()):
    _CLASS[list(_members)] = _k + 1
_OTHER = [b for b in range(33, 127) if not chr(b).isalnum() and not _CLASS[b]]
_CLASS[_OTHER] = len(_KINDS) + 1
_CLASS[128:] = len(_KINDS) + 2
_N_CLASSES = len(_KINDS) + 3
_MARKS = frozenset("#*$%&|<>!")


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of a text, all finite and near unit range; the empty text gives zeros."""
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(data)
    counts = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=_N_CLASSES)
    share = {name: float(np.sqrt(counts[k + 1] / n)) for k, name in enumerate(_KINDS)}
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    upper = sum(k for w, k in seen.items() if len(w) > 1 and w.isupper())
    marked = sum(k for w, k in seen.items() if not w[-1:].isalnum() and chr(w[-1]) in _MARKS)
    m = len(words)
    return [
        np.log1p(n), np.log1p(m), np.log1p((n - m) / m), share["upper"], share["digit"], share["stop"], share["exclaim"], share["symbol"],
        share["quote"], float(np.sqrt(counts[-2] / n)), float(np.sqrt(counts[-1] / n)), share["space"], np.log1p(len(lines)), np.log1p(m / len(lines)),
        len(seen) / m, 1 - len(set(lines)) / len(lines), float(np.sqrt(max(seen.values()) / m)), float(np.sqrt(upper / m)),
        float(np.sqrt(marked / m)), np.log1p(max(map(len, seen))),
    ]


def document_statistics(docs: DataFrame, carry: tuple | None = None) -> DataFrame:
    """``(doc_id, stats)`` of every row, with a long column ``carry`` = (name, column) if asked; null text counts as empty."""
    extra = [carry[0]] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [statistics(t) for t in texts(part.column("text"))]
                columns = [part.column("doc_id"), *(part.column(c) for c in extra), pa.array(found, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *extra, "stats"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *([carry[1].alias(carry[0])] if carry else []), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, " + "".join(f"{c} long, " for c in extra) + "stats array<double>")


@dataclass
class Discriminant:
    """Two Gaussian classes; ``factors`` are the lower Cholesky factors of their covariances."""

    means: np.ndarray
    factors: list[np.ndarray]
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(offset - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))


def discriminant(count: np.ndarray, total: np.ndarray, square: np.ndarray, pool: float, diagonal: float) -> Discriminant | None:
    """Fit from each class's count, sum and sum of outer products; None if a class has no rows."""
    if (count < 1).any():
        return None
    means = total / count[:, None]
    scatter = [square[c] - count[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / count.sum()
    size = np.trace(pooled) / len(pooled) + 1e-9
    factors = []
    for c in (0, 1):
        weight = count[c] / (count[c] + pool)  # few rows: mostly the pooled covariance
        cov = weight * scatter[c] / count[c] + (1 - weight) * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-3 * size * np.eye(len(cov))
        factors.append(np.linalg.cholesky(cov))
    return Discriminant(means, factors, np.log(count / count.sum()))


def fit(labelled: DataFrame, pool: float = 60.0, diagonal: float = 0.02) -> Discriminant | float:
    """Fit on all rows of ``(stats, quality)``; the class share (0.5 without rows) if a class is missing.

    Each task's count, sum and sum of outer products for each class are summed by Spark; the driver gets the totals.
    """
    d = len(STATISTICS)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if len(batch):
                x, y = np.stack(batch["stats"].to_numpy()), batch["quality"].to_numpy()
                for c in (0, 1):
                    own = x[y == c]
                    out[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pd.DataFrame({"at": np.arange(out.size), "value": out.ravel()})

    found = labelled.mapInPandas(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    both = np.zeros((2, 1 + d + d * d))
    both.ravel()[found["at"].to_numpy(int)] = found["value"].to_numpy(float)
    model = discriminant(both[:, 0], both[:, 1 : 1 + d], both[:, 1 + d :].reshape(2, d, d), pool, diagonal)
    return model or float((both[1, 0] + 0.5) / (both[:, 0].sum() + 1.0))


def quality_scores(docs: DataFrame, labels: DataFrame, carry: tuple | None = None) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``, and a long column to carry along if given.

    Learns from all labelled rows whose crc32(doc_id as text) mod 4 is not 2; only the text's statistics
    enter a score. Null and empty texts are scored by zero statistics; a null doc_id is never held out or
    learnt from; null labels are ignored, and of several labels of one doc_id the largest holds; ties and
    repeated rows are scored alone; without labels every score is 0.5; an empty table gives no rows; other
    columns are ignored. Texts are read once; only the statistics are joined with the labels.
    """
    stats = materialize(document_statistics(docs, carry))
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("quality").cast("int")).alias("quality")).where("quality in (0, 1)")
    model = fit(stats.where(~held_out).join(known.hint("merge"), "doc_id").select("stats", "quality"))

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=float)
        x = np.stack(values.to_numpy())
        return pd.Series(np.full(len(x), model) if isinstance(model, float) else model.score(x))

    out = stats.select("doc_id", held_out.alias("held_out"), score("stats").alias("score"), *([carry[0]] if carry else []))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
