"""An injected embedding function over batches, with a fallback to single items."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed value: items of one call.
BATCH = 128
Embedder = Callable[[list[str]], list[list[float]]]


def hash_embedding(dimensions: int = 8) -> Embedder:
    """A stand-in for a model: numbers between 0 and 1 from the text's MD5."""

    def embed(texts: list[str]) -> list[list[float]]:
        digests = [hashlib.md5(t.encode()).hexdigest() for t in texts]
        return [[int(d[4 * k : 4 * k + 4], 16) / 65535 for k in range(dimensions)] for d in digests]

    return embed


class Transient(Exception):
    """What an embedder raises when the same call may do later: a service that is busy or away for a while."""


def patient(embed: Embedder, retries: int, wait: float, longest: float = 30.0) -> Embedder:
    """An embedder that is called again after a transient failure, ``retries`` times at most, after waits that double up to ``longest`` seconds."""

    def called(texts: list[str]) -> list[list[float]]:
        for k in range(retries):
            try:
                return embed(texts)
            except Transient:
                time.sleep(min(longest, wait * 2**k))
        return embed(texts)

    return called


def embedded(
    chunks: DataFrame, embed: Embedder, dimensions: int, text: str = "text", batch: int = BATCH, retries: int = 0, wait: float = 1.0
) -> DataFrame:
    """Append ``vector`` and ``error``.

    Texts are embedded ``batch`` at a time.  A call that fails transiently is made
    again as it is, ``retries`` times; one that fails otherwise or for good, or
    gives another number of vectors or of dimensions, is made again item by item,
    so that one bad text costs no other its vector.
    """
    embed = patient(embed, retries, wait)
    schema = T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(schema)

    def called(texts: list[str]) -> list[list[float]]:
        vectors = embed(texts)
        if len(vectors) != len(texts) or any(len(v) != dimensions for v in vectors):
            raise ValueError("wrong number of vectors or dimensions")
        return vectors

    def one(value: str) -> tuple[list[float] | None, str | None]:
        try:
            return called([value])[0], None
        except Exception as error:  # the item's own fault is its result
            return None, f"{type(error).__name__}: {error}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                texts = [t or "" for t in part[text].to_pylist()]
                try:
                    results = [(v, None) for v in called(texts)]
                except Exception:  # any failure of the call is tried again item by item
                    results = [one(t) for t in texts]
                new = [pa.array([r[k] for r in results], f.type) for k, f in enumerate(list(arrow)[-2:])]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema=arrow)

    return chunks.mapInArrow(run, schema)
