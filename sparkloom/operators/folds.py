"""Folds over the rows of a key in order, where what happens to a row depends on the rows before it.

Rows are dealt out by key and sorted within partitions by Spark; a task reads
them in Arrow batches and carries a key's state from one batch to the next.  So
time is linear in the rows and memory holds a batch and one state, also where a
single key has most of the rows (such a key is one task's, as its rows depend on
each other).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What a key begins with: a function from a row's inputs to its value, which keeps the state.
Step = Callable[..., object]


@dataclass(frozen=True)
class Fold:
    """A column ``name`` of type ``kind``, made of the columns ``inputs`` of each row in turn by what ``start`` returns for each key."""

    name: str
    kind: T.DataType
    inputs: tuple[str, ...]
    start: Callable[[], Step]


def _runs(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Where runs of rows of one key begin, and the end."""
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for c in by:
        codes = pc.dictionary_encode(batch[c], null_encoding="encode").indices.to_numpy()
        change |= codes[1:] != codes[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])


def folded(rows: DataFrame, by: list[str], order: list[str | Column], folds: list[Fold], together: bool = False) -> DataFrame:
    """Append the columns of folds over the rows of each key in the order given.

    With ``together`` the rows of a key lie in one partition already.  Null keys
    are keys like others; an empty table stays empty.
    """
    dealt = rows if together else rows.repartition(*by)
    dealt = dealt.sortWithinPartitions(*by, *order)
    schema = T.StructType(dealt.schema.fields + [T.StructField(f.name, f.kind) for f in folds])
    kinds = [f.type for f in to_arrow_schema(T.StructType(schema.fields[-len(folds) :]))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, steps = None, []
        for batch in batches:
            values: list[list] = [[] for _ in folds]
            inputs = [[batch[c].to_pylist() for c in f.inputs] for f in folds]
            edges = _runs(batch, by).tolist() if batch.num_rows else [0]
            for lo, hi in zip(edges, edges[1:], strict=False):
                key = tuple(batch[c][lo].as_py() for c in by)
                if key != last:
                    last, steps = key, [f.start() for f in folds]
                for out, step, columns in zip(values, steps, inputs, strict=True):
                    out.extend(map(step, *[c[lo:hi] for c in columns]))
            made = [pa.array(v, t) for v, t in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns + made, names=schema.names)

    return dealt.mapInArrow(run, schema)


def greedy(most_items: int, most_size: int) -> Callable[[], Step]:
    """Batch numbers of sizes: a new batch at ``most_items`` items or beyond ``most_size``."""

    def start() -> Step:
        batch, n, held = 0, 0, 0

        def step(size: int) -> int:
            nonlocal batch, n, held
            if n and (n >= most_items or held + size > most_size):
                batch, n, held = batch + 1, 0, 0
            n, held = n + 1, held + size
            return batch

        return step

    return start


class Admission:
    """Times of admissions still held, ``most`` at most: one more is admitted while fewer are within ``ttl``."""

    def __init__(self, ttl: int, most: int, held: list[int] | None = None):
        self.ttl, self.most, self.held = ttl, most, held or []

    def __call__(self, at: int) -> bool:
        self.held = [t for t in self.held if t > at - self.ttl]
        admitted = len(self.held) < self.most
        if admitted:
            self.held.append(at)
        return admitted
