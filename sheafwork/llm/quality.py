"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and then towards a multiple
of the identity. A document's score is the posterior from the difference of the two log-densities, with
Mahalanobis distances taken through Cholesky factors that are computed once. Counts, means and second
moments are summed over all labelled rows by Spark; the driver sees only those sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import cut, held_out, read_table, scratch

#: Shrinkage of a class covariance towards the pooled one, and of that towards the identity.
TO_POOLED = 0.1
TO_IDENTITY = 0.02
#: Documents with a posterior below this are rejected.
THRESHOLD = 0.3
PARTS, HELD = 5, 0

UPPER, LOWER, DIGIT, MARK, SIGN, SHOUT = range(1, 7)
_CLASS = np.zeros(256, dtype=np.int64)
for _group, _chars in ((UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (LOWER, "abcdefghijklmnopqrstuvwxyz"), (DIGIT, "0123456789"), (MARK, ".,;:'\"()-"), (SIGN, "#$%&*|~^=<>{}[]\\@_+/`"), (SHOUT, "!?")):
    _CLASS[[ord(c) for c in _chars]] = _group
#: Bytes counted at once.
BLOCK = 1 << 20
STATISTICS = ("chars", "words", "word_mean", "word_spread", "upper", "digit", "mark", "sign", "shout", "distinct", "top_word", "repeats", "short", "line_words", "closed_lines")
MOMENTS = StructType([StructField("label", IntegerType()), StructField("at", IntegerType()), StructField("value", DoubleType())])


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text; null counts as empty, and an empty text has all zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [float(np.log1p(len(text)))] + [0.0] * (len(STATISTICS) - 1)
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    classes = np.zeros(7)
    for start in range(0, len(data), BLOCK):
        classes += np.bincount(_CLASS[data[start : start + BLOCK]], minlength=7)
    n, size = len(words), len(data)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    counts = Counter(words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    closed = sum(x.rstrip()[-1] in ".!?" for x in lines)
    return [
        np.log1p(len(text)), np.log1p(n), np.log(lengths.mean()), np.log1p(lengths.std()),
        np.sqrt(classes[UPPER] / max(1.0, classes[UPPER] + classes[LOWER])), np.sqrt(classes[DIGIT] / size), np.sqrt(classes[MARK] / size),
        np.sqrt(classes[SIGN] / size), np.sqrt(classes[SHOUT] / size), np.log1p(len(counts)) / np.log1p(n), np.sqrt(max(counts.values()) / n),
        np.sqrt(repeats / n), np.sqrt(float((lengths <= 3).mean())), np.log1p(n / max(1, len(lines))), closed / max(1, len(lines)),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def statistics_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([np.asarray(statistics(t), dtype=np.float64) for t in batch])


@dataclass(frozen=True)
class Discriminant:
    """Standardisation, and per class the mean, the inverse Cholesky factor and half the log-determinant."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    half_logs: tuple[float, ...]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for rows of statistics."""
        if not self.means:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = [-0.5 * ((z - m) @ f.T).__pow__(2).sum(axis=1) - h for m, f, h in zip(self.means, self.factors, self.half_logs, strict=True)]
        logit = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


def fit(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """A discriminant from class counts, sums and sums of outer products. With one class or none it scores that class's share, or 0.5."""
    total, d = counts.sum(), sums.shape[1]
    if counts.min() < 2:
        return Discriminant(np.zeros(d), np.ones(d), (), (), (), float(counts[1] / total) if total else 0.5)
    centre = sums.sum(axis=0) / total
    spread = np.sqrt(np.maximum(np.diag(squares.sum(axis=0)) / total - centre**2, 0))
    scale = np.where(spread > 1e-6, spread, 1.0)
    means = [(sums[k] / counts[k] - centre) / scale for k in (0, 1)]
    raw = [squares[k] / counts[k] - np.outer(sums[k], sums[k]) / counts[k] ** 2 for k in (0, 1)]
    covariances = [c / np.outer(scale, scale) for c in raw]
    pooled = sum(c * n for c, n in zip(covariances, counts, strict=True)) / total
    factors, half_logs = [], []
    for c in covariances:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(factor))
        half_logs.append(float(np.log(np.diag(factor)).sum()))
    return Discriminant(centre, scale, tuple(means), tuple(factors), tuple(half_logs), float(counts[1] / total))


def train(marked: DataFrame, labels: DataFrame, parts: int = PARTS, held: int = HELD) -> Discriminant:
    """A discriminant from rows (doc_id, _stats) and labels (doc_id, quality), all rows that are not held out.

    Null labels do not count; of several labels of a document the largest does.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id", parts, held)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    rows = marked.select("doc_id", "_stats").join(known, "doc_id").select("label", "_stats")
    d = len(STATISTICS)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if len(batch):
                x, y = np.stack(batch["_stats"].to_numpy()), batch["label"].to_numpy()
                for k in (0, 1):
                    z = x[y == k]
                    sums[k] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        yield pd.DataFrame({"label": np.repeat([0, 1], sums.shape[1]).astype(np.int32), "at": np.tile(np.arange(sums.shape[1], dtype=np.int32), 2), "value": sums.ravel()})

    total = np.zeros((2, 1 + d + d * d))
    for r in rows.mapInPandas(partial, MOMENTS).groupBy("label", "at").agg(F.sum("value").alias("value")).collect():
        total[r.label, r.at] = r.value
    return fit(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def posterior(model: Discriminant, stats: str = "_stats") -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores(np.stack(batch.to_numpy())) if len(batch) else [], dtype=np.float64)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, DoubleType())(stats)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null text counts as empty; an empty text gets the posterior of all-zero statistics. A null doc_id
    counts as held out. Long texts are read whole. Repeated rows are scored each, and each counts for
    training if its id is labelled. A score at the threshold counts as good. Other columns, whatever their
    names, are not looked at. Without labels of both classes every score is the share of class 1, or 0.5
    without any. No rows give none.
    """
    marked = cut(docs.select("doc_id", statistics_of("text").alias("_stats")))
    score = posterior(train(marked, labels))
    return marked.select("doc_id", held_out("doc_id", PARTS, HELD).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns, whatever these are called.

    The rows are written once with their statistics as a table in the shared folder: training reads the
    statistics only, and scoring does not take them again. Nulls, long texts and repeats are as in `score_documents`.
    """
    path = scratch(docs.sparkSession, "quality")
    marked = docs.select("doc_id", F.struct("*").alias("_row"), statistics_of("text").alias("_stats"))
    marked.write.parquet(path)
    marked = docs.sparkSession.read.schema(marked.schema).parquet(path)
    return marked.select("_row", posterior(train(marked, labels)).alias("_score")).where(F.col("_score") >= THRESHOLD).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
