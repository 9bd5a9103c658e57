"""Each query's closest points, found task by task in Arrow batches: a matrix product rules pairs out, what it leaves is scored exactly.

Scores are sums over the dimensions in their order, in double, so a score does
not depend on how points are dealt out.  A batch gives a query its k best at
most, and none that is worse than the k best before it in the same task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Points and queries of one matrix product at most.
POINTS, QUERIES = 4096, 256
#: Queries whose sums of gaps are made at a time, so that they stay in a core's cache.
ROWS = 8
#: Share by which a product of matrices may be off, far more than it is; and the largest number of a vector that it is trusted with.
SLACK, LARGEST = 1e-9, 1e70


def _fold(values: Iterable[float]) -> float:
    """Their sum in order; Python's own sum makes up for rounding."""
    return reduce(add, values, 0.0)


def plain_score(q: list | None, p: list | None, metric: str) -> float | None:
    """The score of vectors of which one may be null, hold nulls or numbers that are not finite, or be of another length."""
    if q is None or p is None:
        return None
    norm = lambda v: None if None in v else _fold(x * x for x in v)
    even = len(q) == len(p) and None not in q and None not in p
    if metric in ("cosine", "dot"):
        dot = _fold(x * y for x, y in zip(q, p, strict=True)) if even else None
        if metric == "dot":
            return dot
        a, b = norm(q), norm(p)
        if a is None or b is None:
            return None
        size = math.sqrt(a * b)
        return 0.0 if size == 0 else None if dot is None else dot / size
    if not even:
        return None
    gaps = [x - y for x, y in zip(q, p, strict=True)]
    return -_fold(map(abs, gaps)) if metric == "manhattan" else -math.sqrt(_fold(g * g for g in gaps))


class _Vectors:
    """A column of vectors: ``rows`` by length as (indices, matrix with a row for each dimension), and ``odd`` indices of those that make no matrix."""

    def __init__(self, column: pa.Array):
        self.column = column
        lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        good = np.zeros(len(lengths), bool)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(lengths[lengths >= 0]).tolist():
            at = np.flatnonzero(lengths == n)
            matrix = values[starts[at][:, None] + np.arange(n)]
            fine = (np.abs(matrix) <= LARGEST).all(axis=1)
            good[at[fine]] = True
            if fine.any():
                self.rows[n] = at[fine], np.ascontiguousarray(matrix[fine].T)
        self.odd = np.flatnonzero(~good)

    def __getitem__(self, i: int) -> list | None:
        return self.column[i].as_py()


def _squares(matrix: np.ndarray) -> np.ndarray:
    total = np.zeros(matrix.shape[1])
    for x in matrix:
        total = total + x * x
    return total


def _exact(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs of columns."""
    total = np.zeros(q.shape[1])
    if metric in ("cosine", "dot"):
        for x, y in zip(q, p, strict=True):
            total = total + x * y
        if metric == "dot":
            return total
        size = np.sqrt(_squares(q) * _squares(p))
        return np.where(size == 0, 0.0, np.clip(total / np.where(size == 0, 1.0, size), -1.0, 1.0))
    for x, y in zip(q, p, strict=True):
        total = total + (np.abs(x - y) if metric == "manhattan" else (x - y) * (x - y))
    return -total if metric == "manhattan" else -np.sqrt(total)


class _Bound:
    """Numbers that rank pairs as their scores do but for ``slack``: a product of matrices, or sums of gaps for ``manhattan``."""

    def __init__(self, q: np.ndarray, p: np.ndarray, metric: str):
        a, b = _squares(q), _squares(p)
        self.metric, unit = metric, lambda m, s: m / np.where(s == 0, 1.0, np.sqrt(s))
        if metric == "cosine":
            self.near, self.slack = unit(q, a).T @ unit(p, b), np.full(len(a), SLACK)
        elif metric == "dot":
            self.near, self.slack = q.T @ p, SLACK * np.sqrt(a * b.max(initial=0.0))
        elif metric == "manhattan":
            self.near = np.zeros((len(a), len(b)))
            for lo in range(0, len(a), ROWS):
                rows = self.near[lo : lo + ROWS]
                gaps = np.empty_like(rows)
                for x, y in zip(q[:, lo : lo + ROWS], p, strict=True):
                    np.subtract(x[:, None], y, out=gaps)
                    rows -= np.abs(gaps, out=gaps)
            self.slack = SLACK * (np.sqrt(a) + np.sqrt(b.max(initial=0.0))) * max(1.0, math.sqrt(len(q)))
        else:
            self.near = 2 * (q.T @ p) - a[:, None] - b
            self.slack = SLACK * (a + b.max(initial=0.0))

    def of(self, scores: np.ndarray) -> np.ndarray:
        """What ``near`` is for exact scores."""
        return -scores * scores if self.metric in ("euclid", "euclidean") else scores


class _Search:
    """The queries of a block, and what the k best of each score so far."""

    def __init__(self, vectors: pa.Array, k: int, metric: str):
        self.all, self.k, self.metric = _Vectors(vectors), k, metric
        self.best = np.full((len(vectors), k), -np.inf)

    def block(self, queries: np.ndarray, q: np.ndarray, points: np.ndarray, p: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, point, score) of the pairs of two matrices that may be among a query's k best; ``place`` is a point's place among equal scores."""
        bound, k = _Bound(q, p, self.metric), self.k
        least = self.best[queries, 0]
        limit = np.where(np.isinf(least), -np.inf, bound.of(least))
        if len(points) > k and np.isinf(limit).any():
            limit = np.maximum(limit, np.partition(bound.near, len(points) - k, axis=1)[:, len(points) - k] - bound.slack)
        i, j = np.nonzero(bound.near >= (limit - bound.slack)[:, None])
        score = _exact(q[:, i], p[:, j], self.metric)
        order = np.lexsort((place[points[j]], -score, i))
        i, j, score = i[order], j[order], score[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        kept = (nth < k) & (score >= least[i])
        i, j, score, nth = i[kept], j[kept], score[kept], nth[kept]
        fresh = np.full((len(queries), k), -np.inf)
        fresh[i, nth] = score
        self.best[queries] = np.sort(np.concatenate([self.best[queries], fresh], axis=1), axis=1)[:, k:]
        return queries[i], points[j], score

    def met(self, points: _Vectors, place: np.ndarray, some_queries: np.ndarray | None = None, some_points: np.ndarray | None = None) -> Iterator[tuple]:
        """(queries, points, scores) of a batch, narrowed to masks of either side."""
        within = lambda at, m, mask: (at, m) if mask is None else (at[mask[at]], m[:, mask[at]])
        for n, (at, matrix) in self.all.rows.items():
            if n not in points.rows:
                continue
            queries, q = within(at, matrix, some_queries)
            every, p = within(*points.rows[n], some_points)
            for lo in range(0, len(every), POINTS):
                for first in range(0, len(queries), QUERIES):
                    a, b = slice(first, first + QUERIES), slice(lo, lo + POINTS)
                    yield self.block(queries[a], q[:, a], every[b], p[:, b], place)
        yield from self._odd(points, place, some_queries, some_points)

    def _odd(self, points: _Vectors, place: np.ndarray, some_queries: np.ndarray | None, some_points: np.ndarray | None) -> Iterator[tuple]:
        """Pairs that make no matrix, one by one: nulls score last, what is no number first."""
        of = lambda side: {i: n for n, (at, _) in side.rows.items() for i in at.tolist()}
        if not (len(self.all.odd) or len(points.odd)) and set(self.all.rows) == set(points.rows) and len(points.rows) <= 1:
            return
        mine, theirs = of(self.all), of(points)
        for i in range(len(self.all.column)):
            if some_queries is not None and not some_queries[i]:
                continue
            pairs = [j for j in range(len(points.column)) if (some_points is None or some_points[j]) and not (i in mine and mine[i] == theirs.get(j))]
            if not pairs:
                continue
            q = self.all[i]
            scored = [(plain_score(q, points[j], self.metric), j) for j in pairs]
            rank = lambda x: (x[0] is None, x[0] is not None and not math.isnan(x[0]), 0.0 if x[0] is None or math.isnan(x[0]) else -x[0], place[x[1]])
            scored = sorted(scored, key=rank)[: self.k]
            yield np.full(len(scored), i), np.array([j for _, j in scored]), [s for s, _ in scored]


def candidates(points: DataFrame, queries: DataFrame, k: int, metric: str, own: bool = False) -> DataFrame:
    """(query_id, chunk_id, score): pairs of points (chunk_id, vector) and queries (query_id, query), among them each query's k best.

    With ``own`` both have a column of that name and meet only where it is equal.
    The queries, a block of a checked size, are sent to all tasks.
    """
    kind = lambda frame, name: frame.schema[name].dataType
    schema = T.StructType([T.StructField("query_id", kind(queries, "query_id")), T.StructField("chunk_id", kind(points, "chunk_id")), T.StructField("score", T.DoubleType())])
    sent = points.sparkSession.sparkContext.broadcast(queries.select("query_id", "query", *["own"] * own).toArrow().combine_chunks())
    k, metric = max(k, 1), metric.lower()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        if not asked.num_rows:
            return
        one = lambda c: pa.concat_arrays(asked[c].chunks)
        ids, search = one("query_id"), _Search(one("query"), k, metric)
        owners: dict[object, list[int]] = {}
        for i, owner in enumerate(one("own").to_pylist() if own else ()):
            owners.setdefault(owner, []).append(i)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, chunks = _Vectors(batch["vector"]), batch["chunk_id"]
            place = np.empty(batch.num_rows, np.int64)
            place[pc.array_sort_indices(chunks, order="ascending").to_numpy()] = np.arange(batch.num_rows)
            parts = [(None, None)]
            if own:
                codes = pc.dictionary_encode(batch["own"])
                at, parts = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False), []
                for code, owner in enumerate(codes.dictionary.to_pylist()):
                    if owner in owners:
                        mask = np.zeros(len(ids), bool)
                        mask[owners[owner]] = True
                        parts.append((mask, at == code))
            for some_queries, some_points in parts:
                for i, j, score in search.met(vectors, place, some_queries, some_points):
                    if len(i):
                        arrays = [ids.take(pa.array(i)), chunks.take(pa.array(j)), pa.array(score, pa.float64(), from_pandas=False)]
                        yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return points.select("chunk_id", "vector", *["own"] * own).mapInArrow(run, schema)
