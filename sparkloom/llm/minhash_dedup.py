"""Near-duplicate removal by an inverted join on the coordinates of MinHash signatures.

A document's set of distinct word shingles has a signature of ``COORDINATES``
minima under as many hash functions; two sets of Jaccard similarity J agree in
each coordinate with probability J.  Documents are posted under their
(coordinate, value) pairs, and pairs of documents that collide in at least a
match threshold of coordinates are retained and confirmed on their full sets,
after exact bounds from parity sketches, which spare most of those that are only
nearly similar.

* The threshold is the largest that a similar pair misses with a probability of
  at most ``MISS``, by the binomial distribution.
* Prefix: two signatures that agree in t of k coordinates agree in one of any
  k - t + 1, so each document is posted only under that many of its pairs, those
  that are rarest in the corpus (one order for all documents, in which the pairs
  that tasks report as frequent come last).
* Skip: counting goes on block by block of coordinates and leaves out a pair as
  soon as the coordinates left can't bring it to the threshold.

A posting list isn't expanded to its pairs.  Every member is first paired with the
list's smallest; the links among these give components; then members outside a
list's largest component are counted against its others, in blocks, so a list of
any length is spread over tasks.  Equal sets are one set from the start.

Defined results: null and empty texts, and texts without words, have the empty set,
link with nothing and are kept.  Of a component the document of the least id is kept; rows that
repeat as a whole are kept or go together.  A document without an id is linked
like any other and goes if one in its component has an id; if none has, all are kept.
An empty table gives none.  Texts are read whole, whatever their length.  Only id,
text and columns to carry are read, so others don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents
from sparkloom.llm.jaccard_join import _ENTRIES, CHUNK_TOKENS, Order, SetJoin, Similarity, blobs, sketch, small_sketch
from sparkloom.llm.textops import mix

WIDTH = 4
PERCENT = 80
COORDINATES = 64
#: Probability that a pair just similar enough is missed, at most.
MISS = 1e-8
#: Coordinates counted before pairs that can't get there any more are left out.
STEP = 16

_RANDOM = np.random.RandomState(20240613).randint(0, 1 << 62, (2, COORDINATES)).astype(np.uint64)
_FACTOR, _SHIFT = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]


def match_threshold(coordinates: int, similarity: float, miss: float) -> int:
    """The largest number of matches that fewer of the pairs of this similarity than ``miss`` fall short of."""
    below, t = 0.0, 0
    while True:
        below += comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            return max(1, t)
        t += 1


THRESHOLD = match_threshold(COORDINATES, PERCENT / 100, MISS)


def signature(tokens: np.ndarray) -> np.ndarray:
    """The least values of a set's hashes, one for each function."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(tokens), 4096):
        values = tokens[lo : lo + 4096, None] * _FACTOR + _SHIFT
        np.minimum(out, values.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def postings(minima: np.ndarray) -> np.ndarray:
    """The (coordinate, value) pairs of signatures (rows) as 64-bit numbers."""
    return mix(minima.astype(np.uint64) + (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))


def collisions(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which of many rows of signatures' lowest bytes reach the threshold with one (or row by row).

    Bytes of equal values are equal, so no pair is lost; one in 256 of other
    coordinates counts too, which later steps make good.
    """
    one = np.broadcast_to(one, many.shape)
    alive = np.arange(len(many))
    count = np.zeros(len(many), np.int64)
    for lo in range(0, COORDINATES, STEP):
        count = count + (many[alive, lo : lo + STEP] == one[alive, lo : lo + STEP]).sum(axis=1)
        keep = count >= THRESHOLD - (COORDINATES - lo - STEP)
        alive, count = alive[keep], count[keep]
    return alive


def _minima(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def _index(shared, buckets: int):
    """Entries of the rarest (coordinate, value) pairs of sets (key, signature)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*shared.value)
        need = COORDINATES - THRESHOLD + 1
        step = CHUNK_TOKENS // need
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                rows = batch.slice(lo, step)
                tokens = np.sort(postings(_minima(rows.column(1))), axis=1)
                keys = np.concatenate([order.prefix(t, need) for t in tokens])
                yield blobs(keys, np.repeat(rows.column(0).to_numpy(), need), np.full(len(keys), 2, np.uint8), buckets)

    return run


class _Coordinates(SetJoin):
    """Pairs that collide often enough and, by parity sketches behind the signatures, may be similar before whole sets are read."""

    width = WIDTH
    similarity = Similarity(PERCENT, COORDINATES, collisions)
    sketches = ("small", "sketch", "signature")

    @staticmethod
    def sketch(tokens: np.ndarray) -> tuple[np.ndarray, dict[str, bytes]]:
        minima, parity = signature(tokens), sketch(tokens)
        head = minima.astype(np.uint8).tobytes()
        return postings(minima), {"small": head + small_sketch(parity, len(tokens)), "sketch": head + parity, "signature": minima.tobytes()}

    def entries(self, buckets: Callable[[int], int]) -> DataFrame:
        order = self.spark.sparkContext.broadcast(self.frequent())  # HOT_TOKENS pairs of numbers
        size = self.n_sets * (COORDINATES - THRESHOLD + 1)
        return self.sets.select("key", "signature").mapInArrow(_index(order, buckets(size)), _ENTRIES)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to carry, n_shingles, component_id, group and kept of each row; the id is taken as a long.

    ``group`` names the component also where no document in it has an id; it is
    null for a document without words.
    """
    return _Coordinates(docs, id_col, text_col, carry).run().withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("group")
