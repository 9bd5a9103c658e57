"""Bounded samples of labelled documents, and byte n-grams of whole texts."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm.textops import SEPARATOR, Slice, slices

#: Bytes that the sampled texts of one class or language hold together, at most.
MOST_BYTES = 32 << 20


def first_rows(rows: DataFrame, by: str, size: str, order: list[Column], most: int, most_bytes: int) -> DataFrame:
    """Of each value of ``by`` the first ``most`` rows in the order given, as far as their texts hold ``most_bytes`` together.

    Texts of more than a sixteenth of ``most_bytes`` come after all others, so
    that they take no other's place.
    """
    line = Window.partitionBy(by).orderBy(F.col(size) > most_bytes // 16, *order)
    first = rows.withColumn("__n", F.row_number().over(line)).where(F.col("__n") <= most)
    held = F.sum(size).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("__held", held).where(F.col("__held") <= most_bytes).drop("__n", "__held")


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` distinct learning rows of each class, whose texts hold ``most_bytes`` a class together.

    Rows are taken in the order of a hash of their id and then of their text, so
    a sample does not depend on partitioning, and an id with many rows takes no
    more than its class's places.  Rows are ranked by numbers alone, of which a
    task passes on no more than the places of a class, however large the class;
    only those picked fetch their texts.  Of several labels of one document the
    largest counts.
    """
    picked = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    order = F.xxhash64("doc_id")
    both = None
    for y in (0, 1):
        one = picked.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        both = one if both is None else both.unionByName(one)
    # at most 2 * per_class rows of two numbers
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(both), "doc_id")
    numbers = rows.select("doc_id", "y", F.xxhash64("text").alias("t"), F.octet_length("text").cast("long").alias("size")).distinct()
    first = None
    for y in (0, 1):
        one = numbers.where(F.col("y") == y).orderBy(F.col("size") > most_bytes // 16, order, "doc_id", "t").limit(per_class)
        first = one if first is None else first.unionByName(one)
    first = first_rows(first, "y", "size", [order, F.col("doc_id"), F.col("t")], per_class, most_bytes).drop("size")
    texts = rows.withColumn("t", F.xxhash64("text")).join(F.broadcast(first), ["doc_id", "y", "t"])  # at most 2 * per_class rows of three numbers
    return texts.select("doc_id", "text", "y").distinct()


def fitted(rows: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """What ``fit`` makes of a bounded sample, in one task: the driver holds the model, never the texts."""
    schema = to_arrow_schema(rows.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.dumps(fit(pa.Table.from_batches(list(batches), schema)), protocol=5)
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit(schema.empty_table())


def texts_and_labels(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Texts and 0/1 labels of a sample, in an order of their own."""
    rows = rows.sort_by([("doc_id", "ascending"), ("y", "ascending"), ("text", "ascending")])
    return pa.array(rows["text"].to_pylist(), pa.string()), rows["y"].to_numpy().astype(np.int64)


def spaced(part: Slice, gap: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice with every separator a blank and ``gap`` blanks around each document."""
    lengths = np.diff(part.offsets)
    at = part.offsets[:-1] + gap * (1 + np.arange(len(part)))
    out = np.full(len(part.data) + gap * (len(part) + 1), 32, np.uint8)
    target = np.arange(len(part.data)) + np.repeat(at - part.offsets[:-1], lengths)
    out[target] = np.where(SEPARATOR[part.data], 32, part.data)
    return out, np.append(at, len(out) + 0) - gap // 2


def byte_ngrams(text: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the n-grams inside words (with a blank at either end or none) begin, and their buckets."""
    size = len(text) - n + 1
    if size <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = np.uint32 if n <= 4 else np.uint64
    value = text[:size].astype(kind)
    for k in range(1, n):
        value |= text[k : k + size].astype(kind) << kind(8 * k)
    blank = text == 32
    inner = blank[1 : 1 + size].copy()
    for k in range(2, n - 1):
        inner |= blank[k : k + size]
    inner |= blank[:size] & blank[n - 1 : n - 1 + size] if n > 2 else False
    at = np.flatnonzero(~inner)
    value = value[at].astype(np.uint64)
    value = (value + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return at, (value >> np.uint64(64 - bits)).astype(np.int64)


def owners(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For sorted positions, the document each lies in, as the first index of each document's run (n + 1)."""
    return np.searchsorted(at, starts)


def text_slices(texts: pa.Array, max_bytes: int = 2 << 20):
    return slices(texts, max_bytes)
