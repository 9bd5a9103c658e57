"""Language identification of words by a linear-chain conditional random field.

Every word of a line carries a language.  A word's potentials are sums of learned
weights of its features: the word itself (lexicon), its prefixes and suffixes of
up to three bytes and the byte n-grams inside it, hashed into one table with a
column for each language; learned transitions tie neighbouring words, so that
single foreign-looking words don't break a run while real switches do.
Forward-backward gives each word's marginals; a document's language is the one
with the largest sum of marginals over its words with a letter, and the score
is its share.  With ``words_col`` the words' own languages are returned too, so
that text which switches languages shows where.

Training maximises the likelihood of the learning documents, whose words are all
labelled with the document's language, by AdaGrad in numpy on a bounded sample
of ``PER_LANGUAGE`` documents of each language (``MOST_BYTES`` of text), in one
task.  Labels of documents that switch languages are noisy in their foreign part,
which the shared weights outvote.

Lines are the sequences: the lines of a slice are advanced together, a word at a
time, longest first, so a long line costs steps only for itself.

Defined results: of languages with equal sums the first by name counts; ``und`` with score 0.0 for a text that is null or has no letter,
or where no language could be learned; such a text has no labelled words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import append_columns, documents, remainder
from sparkloom.llm.labelled import byte_ngrams, first_rows, fitted, spaced, text_slices
from sparkloom.llm.textops import LOWER_ASCII, PrefixHash, Slice, mix

#: Documents of each language that the model is fitted on, at most; every language is learned.
PER_LANGUAGE = 500
#: Bytes that their texts hold together in each language, at most.
MOST_BYTES = 4 << 20
#: Beyond this many languages slices are cut shorter, so that the tables of words by languages keep their size.
WIDE = 64
BITS = 16
NGRAMS = (3,)
AFFIXES = (1, 2, 3)
EPOCHS = 4
RATE = 0.1
DECAY = 1e-6
UNKNOWN = "und"
WORD_LABELS = T.ArrayType(
    T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
        + [T.StructField("lang", T.StringType()), T.StructField("probability", T.DoubleType())]
    )
)


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    transitions: np.ndarray  # from x to
    first: np.ndarray


class Words:
    """The words of a slice, their lines and their features."""

    def __init__(self, part: Slice):
        data = LOWER_ASCII[part.data]
        low = Slice(part.first, data, part.offsets)
        self.starts, self.ends, self.first = low.words()
        n = len(self.starts)
        self.doc = np.repeat(np.arange(len(part)), np.diff(self.first))
        letter = ((data >= 97) & (data <= 122)) | (data >= 128)
        run = np.concatenate([[0], np.cumsum(letter)])
        self.lettered = run[self.ends] > run[self.starts]
        # a line begins at a document's first word and after a line break
        breaks = np.concatenate([[0], np.cumsum(data == 10)])[self.starts]
        new = np.ones(n, bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (breaks[1:] != breaks[:-1])
        self.line_start = np.flatnonzero(new)
        self.line_length = np.diff(np.append(self.line_start, n))
        # features: buckets of all words, and the word of each
        self.single: list[np.ndarray] = []
        if not n:
            self.gram, self.gram_edges = np.empty(0, np.int64), np.zeros(1, np.int64)
            return
        hashed = PrefixHash(data)
        shift = np.uint64(64 - BITS)
        self.single.append((hashed.of(self.starts, self.ends) >> shift).astype(np.int64))
        for k in AFFIXES:
            for salt, lo, hi in ((k, self.starts, np.minimum(self.starts + k, self.ends)), (k + 8, np.maximum(self.ends - k, self.starts), self.ends)):
                self.single.append((mix(hashed.of(lo, hi) + np.uint64(salt)) >> shift).astype(np.int64))
        text, at = spaced(low)
        shifted = self.starts + (at[:-1] + 4 - part.offsets[:-1])[self.doc]
        grams, edges = [], []
        for k in NGRAMS:
            where, bucket = byte_ngrams(text, k, BITS)
            grams.append(bucket)
            edges.append(np.append(np.searchsorted(where, shifted - 1), len(where)))
        self.gram, self.gram_edges = grams[0], edges[0]

    def potentials(self, weights: np.ndarray) -> np.ndarray:
        total = np.zeros((len(self.starts), weights.shape[1]), np.float32)
        for bucket in self.single:
            total += weights[bucket]
        if len(self.gram):
            part = weights[self.gram]
            lo, hi = self.gram_edges[:-1], self.gram_edges[1:]
            solid = np.flatnonzero(hi > lo)
            total[solid] += np.add.reduceat(part, lo[solid], axis=0)[: len(solid)] if len(solid) else 0
        return total

    def add_gradient(self, gradient: np.ndarray, error: np.ndarray) -> None:
        for k in range(error.shape[1]):
            column = np.zeros(gradient.shape[0])
            for bucket in self.single:
                column += np.bincount(bucket, error[:, k], gradient.shape[0])
            if len(self.gram):
                column += np.bincount(self.gram, np.repeat(error[:, k], np.diff(self.gram_edges)), gradient.shape[0])
            gradient[:, k] += column


def forward_backward(words: Words, scores: np.ndarray, transitions: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Marginals of all words; with ``pairs`` also the expected transitions and first states."""
    n, size = scores.shape
    step = np.exp(transitions - transitions.max())
    begin = np.exp(first - first.max())
    local = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    order = np.argsort(-words.line_length, kind="stable")
    start, length = words.line_start[order], words.line_length[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, longest + 1), "right")
    forward = np.empty((n, size))
    state = None
    for t in range(longest):
        at = start[: active[t]] + t
        state = local[at] * (begin if t == 0 else state[: active[t]] @ step)
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    marginal = np.empty((n, size))
    expected = np.zeros((size, size))
    backward = np.ones((len(start), size))
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        now = forward[at] * backward[:m]
        now /= now.sum(axis=1, keepdims=True)
        marginal[at] = now
        if t:
            incoming = local[at] * backward[:m]
            back = incoming @ step.T
            if pairs:
                before = forward[at - 1]
                scale = (before * back).sum(axis=1, keepdims=True)
                expected += step * ((before / scale).T @ incoming)
            backward[:m] = back / back.sum(axis=1, keepdims=True)
    return (marginal, expected, marginal[words.line_start].sum(axis=0)) if pairs else marginal


def _slice_bytes(most: int, languages: int) -> int:
    return most * WIDE // max(WIDE, languages)


def fit(texts: pa.Array, labels: list[str], seed: int = 5) -> Crf:
    languages = sorted(set(labels))
    size = len(languages)
    weights = np.zeros((1 << BITS, size), np.float32)
    model = Crf(languages, weights, np.zeros((size, size)), np.zeros(size))
    if size < 2:
        return model
    number = {x: k for k, x in enumerate(languages)}
    index = np.array([number[x] for x in labels])
    groups = []
    shuffled = np.random.RandomState(seed).permutation(len(labels))
    for part in text_slices(texts.take(pa.array(shuffled)), _slice_bytes(128 << 10, size)):
        words = Words(part)
        if len(words.starts):
            groups.append((words, index[shuffled[part.first : part.first + len(part)]][words.doc]))
    squares = np.full(weights.shape, 1e-3, np.float32)
    chain_squares, first_squares = np.full((size, size), 1e-3), np.full(size, 1e-3)
    for _ in range(EPOCHS):
        for words, truth in groups:
            n = len(truth)
            marginal, expected, begun = forward_backward(words, words.potentials(weights), model.transitions, model.first, True)
            marginal[np.arange(n), truth] -= 1
            marginal[~words.lettered] = 0
            gradient = np.zeros(weights.shape)
            words.add_gradient(gradient, marginal / n)
            inner = np.ones(n, bool)
            inner[words.line_start] = False
            at = np.flatnonzero(inner)
            np.add.at(expected, (truth[at - 1], truth[at]), -1.0)
            begun = begun - np.bincount(truth[words.line_start], minlength=size)
            gradient += DECAY * weights
            squares += gradient**2
            weights -= RATE * gradient / np.sqrt(squares)
            # expected switches are few: one is added for each, so that none becomes impossible
            chain = (expected + (model.transitions > 6) - (model.transitions < -6)) / n
            chain_squares += chain**2
            model.transitions -= RATE * chain / np.sqrt(chain_squares)
            first_squares += (begun / n) ** 2
            model.first -= RATE * (begun / n) / np.sqrt(first_squares)
    return model


def train(docs: DataFrame, learn, lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Crf:
    """Fit on learning rows with a text and a language; rows are taken in the order of a hash of their id and text.

    Rows are ranked by numbers alone, and only those picked fetch their texts.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col(lang_col).isNotNull() & learn)
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    hashed = {"h": F.xxhash64("doc_id"), "size": F.octet_length("text").cast("long"), "t": F.xxhash64("text")}
    place = ["lang", "h", "t"]
    picked = first_rows(rows.withColumns(hashed).select(*place, "size"), "lang", "size", [F.col("h"), F.col("t")], per_language, MOST_BYTES)
    picked = picked.select(place).distinct()  # at most per_language rows of three values for each language
    texts = rows.withColumns(hashed).join(F.broadcast(picked), place).select("doc_id", "text", "lang").distinct()
    return fitted(texts, _fit_rows)


def _fit_rows(rows: pa.Table) -> Crf:
    if not len(rows):
        return Crf([], np.zeros((1, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    rows = rows.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    return fit(pa.array(rows["text"].to_pylist(), pa.string()), rows["lang"].to_pylist())


def predict(docs: DataFrame, model: Crf, text_col: str = "text", words_col: str | None = None) -> DataFrame:
    """Append ``lang_pred`` and ``score``; with ``words_col`` also each word with a letter, as (start, end, lang, probability).

    Words begin and end at code points of the text; a word's language is the one
    of its largest marginal, and the probability is that marginal.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats for each language

    def make():
        crf = shared.value

        def step(part: Slice) -> list:
            words = Words(part)
            n, size = len(part), len(crf.languages)
            share = np.zeros((n, max(size, 1)))
            marginal = np.zeros((0, max(size, 1)))
            if len(words.starts) and size:
                marginal = forward_backward(words, words.potentials(crf.weights), crf.transitions, crf.first)
                for k in range(size):
                    share[:, k] = np.bincount(words.doc, marginal[:, k] * words.lettered, n)
            total = share.sum(axis=1)
            best = share.argmax(axis=1)
            plain = (part.data >= 65) & (part.data <= 122) & ((part.data <= 90) | (part.data >= 97))
            ascii_letters = np.diff(np.concatenate([[0], np.cumsum(plain)])[part.offsets])
            names, scores = [], []
            for i in range(n):
                lettered = ascii_letters[i] > 0 or any(c.isalpha() for c in part.text(i))
                known = lettered and size and total[i] > 0
                names.append(crf.languages[best[i]] if known else UNKNOWN)
                scores.append(float(share[i, best[i]] / total[i]) if known else 0.0)
            return [names, scores] + ([_labelled(part, words, marginal, crf.languages, np.array(scores) > 0)] if words_col else [])

        return step

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if words_col:
        fields.append(T.StructField(words_col, WORD_LABELS))
    return append_columns(docs, text_col, fields, make, _slice_bytes(1 << 20, len(model.languages)))


def _labelled(part: Slice, words: Words, marginal: np.ndarray, languages: list[str], known: np.ndarray) -> pa.Array:
    """A list of labelled words for each document of a slice."""
    at = np.flatnonzero(words.lettered & known[words.doc]) if len(marginal) else np.empty(0, np.int64)
    doc, label = words.doc[at], marginal[at].argmax(axis=1)
    points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
    begin = points[part.offsets[:-1]][doc]
    columns = [
        pa.array(points[words.starts[at]] - begin, pa.int64()),
        pa.array(points[words.ends[at]] - begin, pa.int64()),
        pa.array(languages, pa.string()).take(pa.array(label, pa.int64())),
        pa.array(marginal[at, label], pa.float64()),
    ]
    values = pa.StructArray.from_arrays(columns, names=WORD_LABELS.elementType.names)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(part) + 1)), pa.int32()), values)


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.select("doc_id", "text", "lang"), remainder("doc_id", 5) != 0)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
