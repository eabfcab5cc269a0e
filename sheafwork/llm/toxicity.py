"""Toxicity by multiple-instance learning.

Only documents are labelled. A document is a bag of sentences; a sentence has a logistic score over its
words, each weighing as much as its most telling feature (itself or a beginning), and the document's score is the noisy-or of its sentences: one minus the
product of their complements. The weights are trained through the noisy-or, so the sentences that make a
document toxic are found on the way.

The training sample is bounded (`SAMPLE` labelled rows, smallest hashes first); features are chosen by
a likelihood-ratio statistic over that sample's documents. Training starts from their log-odds, with a
ridge towards these, and goes on by full-batch Adam.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import cut, held_out, read_table

#: Labelled rows to train on, features to keep, and documents of the toxic class a feature must be in.
SAMPLE = 12_000
FEATURES = 3000
LEAST_DOCUMENTS = 6
LEAST_RATIO = 10.0
PREFIXES = range(4, 9)
THRESHOLD = 0.5
PARTS, HELD = 5, 0
STEPS, RATE, RIDGE = 300, 0.05, 3e-5
#: Words whose weight a Python worker keeps.
KEPT = 200_000
#: Rows in a batch that a Python worker returns.
ROWS = 20_000

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORDS = re.compile(r"\w+")
COUNTS = StructType([StructField("feature", StringType()), StructField("toxic", LongType()), StructField("clean", LongType())])
BAGS = StructType([StructField("label", IntegerType()), StructField("sentences", IntegerType()), StructField("ids", ArrayType(ArrayType(IntegerType())))])
PLACES = StructType([StructField("sentence_no", IntegerType()), StructField("start", LongType()), StructField("stop", LongType()), StructField("sentence", StringType()), StructField("score", DoubleType())])


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence that has a word."""
    return [m.span() for m in SENTENCE.finditer(text or "") if WORDS.search(m[0])]


def features(word: str) -> list[str]:
    """A lower-case word and its proper beginnings (marked with *)."""
    return [word] + [word[:k] + "*" for k in PREFIXES if len(word) > k]


def telling(word: str, ranks: dict[str, int]) -> int | None:
    """The best-ranked feature of a word."""
    return min((ranks[f] for f in features(word) if f in ranks), default=None)


@dataclass
class Model:
    """Weights of features, the most telling first, and the bias of a sentence."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.kept: dict[str, float] = {}
        self.ranks = {f: i for i, f in enumerate(self.weights)}
        self.values = list(self.weights.values())

    def word(self, word: str) -> float:
        found = self.kept.get(word)
        if found is None:
            known = telling(word, self.ranks)
            found = 0.0 if known is None else self.values[known]
            if len(self.kept) < KEPT:
                self.kept[word] = found
        return found

    def sentence_logit(self, sentence: str) -> float:
        """The bias and the weights of the sentence's distinct words."""
        kept, word = self.kept, self.word
        return self.bias + sum([kept[w] if w in kept else word(w) for w in set(WORDS.findall(sentence.lower()))])

    def document(self, text: str | None) -> float:
        """The noisy-or over sentences; 0 without any."""
        logits = [self.sentence_logit(text[a:b]) for a, b in sentences(text)]
        return float(-np.expm1(-np.logaddexp(0.0, logits).sum())) if logits else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, text) of at most `sample` labelled documents that are not held out, those with the smallest hash of their id.

    Null labels do not count; of several labels of a document the largest does. Of rows that repeat an id
    the one with the smallest hash of its text counts, so no more than `sample` rows are trained on.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id", PARTS, HELD)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("_order", F.struct(F.xxhash64("text"), "text"))
    one = found.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("_order").alias("_order")).select("label", "_order.text")
    return one.repartition(docs.sparkSession.sparkContext.defaultParallelism)


def choose_features(rows: DataFrame, keep: int = FEATURES, least: int = LEAST_DOCUMENTS) -> dict[str, float]:
    """The features most associated with toxic documents, by the likelihood ratio of their document counts, with their log-odds.

    Where the sample is too small for any feature to reach both bounds, those count that are in a quarter of the
    toxic documents (two at least, `least` at most) and have half the best one's ratio or more.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"], strict=True):
                seen[label].update({f for w in set(WORDS.findall((text or "").lower())) for f in features(w)})
        names = list(seen[1])
        names += [f for f in seen[0] if f not in seen[1]]
        for start in range(0, len(names), ROWS):
            part = names[start : start + ROWS]
            yield pd.DataFrame({"feature": part, "toxic": [seen[1][f] for f in part], "clean": [seen[0][f] for f in part]})

    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {}
    n1, n0 = float(sizes[1]), float(sizes[0])
    a, b = F.col("toxic"), F.col("clean")
    share = (a + b) / (n1 + n0)
    part = lambda k, n: k * F.ln(F.greatest(k, F.lit(0.5)) / (n * share)) + (n - k) * F.ln(F.greatest(n - k, F.lit(0.5)) / F.greatest(n * (1 - share), F.lit(0.5)))
    totals = rows.mapInPandas(count, COUNTS).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.ln((a + 0.5) / (n1 + 1)) - F.ln((b + 0.5) / (n0 + 1))

    def best(bound: int, ratio: float) -> list:
        told = totals.where((a >= bound) & (a / n1 > b / n0)).withColumn("ratio", part(a, F.lit(n1)) + part(b, F.lit(n0)))
        return told.where(F.col("ratio") > ratio).withColumn("odds", odds).orderBy(F.desc("ratio"), "feature").limit(keep).collect()

    rows = best(least, LEAST_RATIO)
    if not rows:
        rows = best(min(least, max(2, math.ceil(n1 / 4))), 0.0)
        rows = [r for r in rows if r.ratio >= rows[0].ratio / 2]
    return {r.feature: r.odds for r in sorted(rows, key=lambda r: (-r.odds, -len(r.feature), r.feature))}


def bag(text: str | None, ranks: dict[str, int]) -> tuple[int, list[list[int]]]:
    """The number of a text's sentences, and of those that have a known word the features of its distinct words."""
    spans = sentences(text)
    found = ([telling(w, ranks) for w in sorted(set(WORDS.findall(text[a:b].lower())))] for a, b in spans)
    known = ([i for i in s if i is not None] for s in found)
    return len(spans), [s for s in known if s]


def bags(rows: DataFrame, names: list[str]) -> list:
    """The bag of each training document with its label."""
    index = {f: i for i, f in enumerate(names)}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(y, *bag(t, index)) for y, t in zip(batch["label"], batch["text"], strict=True)], columns=BAGS.names)

    return rows.mapInPandas(find, BAGS).collect()


def fit(found: list, odds: dict[str, float]) -> Model:
    """Weights by Adam on the mean negative log-likelihood of the document labels, with a ridge towards the log-odds."""
    names = list(odds)
    start = np.array([*odds.values(), -6.0])
    y = np.array([r.label for r in found])
    sizes = [len(r.ids) for r in found]
    document = np.repeat(np.arange(len(found)), sizes)
    empty = np.array([r.sentences for r in found]) - np.array(sizes)
    flat = [x for r in found for x in r.ids]
    sentence = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    feature = np.fromiter((i for x in flat for i in x), dtype=np.int64)
    w = start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, STEPS + 1):
        bias = w[-1]
        z = bias + np.bincount(sentence, weights=w[feature], minlength=len(flat))
        area = np.bincount(document, weights=np.logaddexp(0, z), minlength=len(found)) + empty * np.logaddexp(0, bias)
        slope = np.where(y == 1, -1.0 / np.expm1(np.clip(area, 1e-9, 700)), 1.0) / len(found)
        dz = sigmoid(z) * slope[document]
        g = np.append(np.bincount(feature, weights=dz[sentence], minlength=len(names)), dz.sum() + (empty * slope).sum() * sigmoid(bias))
        g[:-1] += RIDGE * (w - start)[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(x) for f, x in zip(names, w, strict=False)}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from a bounded sample; without labels of both classes, or a feature that two toxic documents share, it scores 0 everywhere."""
    rows = cut(training_rows(docs, labels, sample))
    odds = choose_features(rows)
    if not odds:
        return Model({}, -60.0)
    return fit(bags(rows, list(odds)), odds)


def scored(model: Model, text: str = "text") -> Column:
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(weights, bias)
        for batch in batches:
            yield pd.Series([own.document(t) for t in batch], dtype=np.float64)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, DoubleType())(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts, and texts without a word, score 0. Long texts are scored whole. A null doc_id
    counts as held out. Repeated rows are scored each. A score at the threshold counts as toxic. Other
    columns, whatever their names, are not looked at. No rows give none; without labels of both classes
    every score is 0 or next to it.
    """
    model = train(docs, labels)
    return docs.select("doc_id", held_out("doc_id", PARTS, HELD).alias("held_out"), scored(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def offending_sentences(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The sentences that score `least` or more: doc_id, sentence_no (from 0), start, stop (code points), sentence, score. A null or empty text has none; long texts are read whole; repeated rows and ids give theirs each. Other columns, whatever their names, are not looked at. No rows give none."""
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(weights, bias)
        for batch in batches:
            out = []
            for text in batch:
                spans = sentences(text)
                logits = [own.sentence_logit(text[a:b]) for a, b in spans]
                p = 1.0 / (1.0 + np.exp(-np.clip(logits, -60, 60)))
                out.append([{"sentence_no": i, "start": a, "stop": b, "sentence": text[a:b], "score": float(x)} for i, ((a, b), x) in enumerate(zip(spans, p, strict=True)) if x >= least])
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    places = F.pandas_udf(run, ArrayType(PLACES))("text")
    return docs.select("doc_id", F.explode(places).alias("_place")).select("doc_id", "_place.*")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with all their columns, whatever these are called. Nulls, long texts and repeats are as in `score_documents`."""
    return docs.select(F.struct("*").alias("_row"), scored(train(docs, labels)).alias("_score")).where(F.col("_score") < THRESHOLD).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
