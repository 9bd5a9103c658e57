"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The features of a document are the distinct character n-grams (UTF-8 bytes of
the lower-cased text) inside its words, hashed into a table.  Each is scaled by
the log ratio of its document counts in toxic and in other texts, and a logistic
regression over the scaled features is trained by stochastic gradient descent on
a bounded sample of labelled rows (``PER_CLASS`` rows of each class,
``labelled.MOST_BYTES`` of text), in one task.  A score of exactly 0.5 counts as 1.

A feature with a small log ratio says nothing about toxicity but adds noise to
long texts, so only ratios of at least ``MIN_RATIO`` count.

Defined results: a null or empty text gets the score of the bias alone; without
labels of both classes every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import append_columns, documents, remainder, table
from sparkloom.llm.labelled import byte_ngrams, fitted, sample, spaced, text_slices, texts_and_labels
from sparkloom.llm.textops import LOWER_ASCII, Slice

#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 3000
BITS = 20
NGRAMS = (4, 6)
MIN_DOCS = 5
MIN_RATIO = 1.5
EPOCHS = 12
RATE = 0.02
DECAY = 1e-4


@dataclass
class Ratios:
    weight: np.ndarray
    bias: float


def _buckets(part: Slice, useful: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct features of a slice; with ``useful`` only of buckets marked there."""
    text, at = spaced(Slice(part.first, LOWER_ASCII[part.data], part.offsets))
    found = []
    for n in NGRAMS:
        where, bucket = byte_ngrams(text, n, BITS)
        if useful is not None:
            keep = useful[bucket]
            where, bucket = where[keep], bucket[keep]
        doc = np.searchsorted(at, where, "right") - 1
        found.append((doc << BITS) | bucket)
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def fit(texts: pa.Array, y: np.ndarray, seed: int = 11) -> Ratios:
    size = 1 << BITS
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Ratios(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    docs: list[np.ndarray] = []
    for part in text_slices(texts):
        doc, bucket = _buckets(part, None)
        edges = np.searchsorted(doc, np.arange(len(part) + 1))
        docs += [bucket[lo:hi].astype(np.int32) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    toxic, other = np.zeros(size), np.zeros(size)
    for own, label in zip(docs, y, strict=True):
        (toxic if label else other)[own] += 1
    seen = toxic + other
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = np.log((toxic + 1) / (n1 + 2)) - np.log((other + 1) / (n0 + 2))
    ratio[(seen < MIN_DOCS) | (np.abs(ratio) < MIN_RATIO)] = 0
    docs = [own[ratio[own] != 0] for own in docs]
    rng = np.random.RandomState(seed)
    weight = np.zeros(size)
    bias, steps, step = 0.0, EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            own = docs[i]
            x = ratio[own]
            rate = RATE * (1 - step / steps)
            step += 1
            error = 1 / (1 + np.exp(-np.clip(bias + x @ weight[own], -30, 30))) - y[i]
            weight[own] -= rate * (error * x + DECAY * weight[own])
            bias -= rate * error
    return Ratios((weight * ratio).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int = PER_CLASS) -> Ratios:
    return fitted(sample(docs, labels, label, learn, per_class), lambda rows: fit(*texts_and_labels(rows)))


def score(docs: DataFrame, model: Ratios, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Append the probability that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))  # 2**BITS floats

    def make():
        weight, bias = shared.value
        useful = weight != 0

        def step(part: Slice) -> list:
            doc, bucket = _buckets(part, useful)
            total = np.bincount(doc, weight[bucket].astype(np.float64), len(part)) if len(doc) else np.zeros(len(part))
            return [1 / (1 + np.exp(-np.clip(bias + total, -60, 60)))]

        return step

    return append_columns(docs, text_col, [T.StructField(score_col, T.DoubleType())], make)


def learning_rows():
    """The rows whose labels may be learned from."""
    return remainder("doc_id", 5) != 0


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), "toxic", learning_rows())
    return score(docs, model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
