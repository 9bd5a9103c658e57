"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words, of the character n-grams
(UTF-8 bytes) inside them, both hashed into one table, and of word n-grams that
end in the word they begin with; a softmax layer
turns the mean into class probabilities.  Vectors and layer are trained together
by stochastic gradient descent in numpy on a bounded sample of labelled rows
(``PER_CLASS`` rows of each class, ``labelled.MOST_BYTES`` of text), in one task;
all documents are scored.  A score of exactly 0.5 counts as 1.

As the output layer is linear in the mean, scoring needs one number per bucket:
the table folded with the difference of the two output rows.

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
from sparkloom.llm.textops import PrefixHash, Slice

#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 1500
BITS = 17
DIM = 16
NGRAMS = (3, 4)
#: A word n-gram whose last word is its first makes a feature of its own for each n - 1 up to this, whatever the word:
#: a page that repeats itself does so in words that no learning row has, so vectors of the words can't tell.
REPEAT_SPAN = 12
#: Hashed features share the first rows of the table; repetitions have rows of their own behind them.
ROWS = (1 << BITS) + REPEAT_SPAN
EPOCHS = 6
RATE = 8.0


@dataclass
class Embeddings:
    """``folded[bucket]``: a feature's share of the log-odds of class 1 against class 0."""

    folded: np.ndarray
    bias: float


def features(part: Slice) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per kind of feature: the buckets, document after document, and how many each document has."""
    starts, ends, first = part.words()
    words = (PrefixHash(part.data).of(starts, ends) >> np.uint64(64 - BITS)).astype(np.int64) if len(starts) else starts
    counts = [np.diff(first)]
    groups = [words]
    doc = np.repeat(np.arange(len(part)), counts[0])
    again, place = [], []
    for k in range(1, REPEAT_SPAN + 1):
        hit = np.flatnonzero((words[k:] == words[:-k]) & (doc[k:] == doc[:-k])) + k
        again.append(doc[hit])
        place.append(np.full(len(hit), (1 << BITS) + k - 1))
    again, place = np.concatenate(again), np.concatenate(place)
    order = np.argsort(again, kind="stable")
    groups.append(place[order])
    counts.append(np.bincount(again, minlength=len(part)))
    text, at = spaced(part)
    for n in NGRAMS:
        where, bucket = byte_ngrams(text, n, BITS)
        edges = np.searchsorted(where, at)
        counts.append(np.diff(edges))
        groups.append(bucket[edges[0] : edges[-1]])
    return groups, counts


def fit(texts: pa.Array, y: np.ndarray, seed: int = 7) -> Embeddings:
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Embeddings(np.zeros(ROWS, np.float32), float(np.log(share / (1 - share))))
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for part in text_slices(texts):
        groups, counts = features(part)
        edges = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
        for i in range(len(part)):
            own = np.concatenate([g[e[i] : e[i + 1]] for g, e in zip(groups, edges, strict=True)])
            idx, n = np.unique(own, return_counts=True)
            docs.append((idx.astype(np.int32), (n / max(1, len(own))).astype(np.float32)))
    rng = np.random.RandomState(seed)
    table_ = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    steps, step = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            idx, weight = docs[i]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = weight @ table_[idx]
            logit = out @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ out
            out -= 0.1 * rate * np.outer(p, hidden)
            bias -= 0.01 * rate * p
            table_[idx] -= rate * weight[:, None] * back
    return Embeddings((table_ @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int = PER_CLASS) -> Embeddings:
    return fitted(sample(docs, labels, label, learn, per_class), lambda rows: fit(*texts_and_labels(rows)))


def score(docs: DataFrame, model: Embeddings, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Append the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.folded, model.bias))  # ROWS floats

    def make():
        folded, bias = shared.value

        def step(part: Slice) -> list:
            total = np.zeros(len(part))
            count = np.zeros(len(part), np.int64)
            groups, counts = features(part)
            for bucket, n in zip(groups, counts, strict=True):
                run = np.concatenate([[0.0], np.cumsum(folded[bucket], dtype=np.float64)])
                edges = np.concatenate([[0], np.cumsum(n)])
                total += run[edges[1:]] - run[edges[:-1]]
                count += n
            return [1 / (1 + np.exp(-np.clip(bias + total / np.maximum(count, 1), -60, 60)))]

        return step

    return append_columns(docs, text_col, [T.StructField(score_col, T.DoubleType())], make)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), "quality", remainder("doc_id", 3) != 1)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
