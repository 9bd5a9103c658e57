"""Rows under which similar sets meet, made in Arrow batches out of hashed sets.

Similar sets differ in few tokens, a number that follows from their sizes.  A
large set is dealt out into parts by token, so that in some part the two differ
in no more than that part's share, and there share one of as many rarest tokens
and one.  Each row has the parity of its part's tokens over 128 bits: parities
differ in no more bits than the parts do in tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of a part, about; buckets that tokens are counted in; tokens that are sorted at a time, about.
PART, BUCKETS, TOKENS = 128, 1 << 20, 1 << 19
_MIX, _CLASS, _PIECE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def bucket_counts(sets: DataFrame, hashes: str = "hashes") -> np.ndarray:
    """How often each bucket's tokens occur: what orders tokens by rarity, in a table of fixed size."""
    found = sets.select(F.explode(hashes).alias("h")).groupBy(F.col("h").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).count().toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy()] = found["count"].to_numpy()
    return counts


def _edges(numerator: int, denominator: int) -> np.ndarray:
    """Least sizes of classes: similar sets are of one class or of two that follow each other."""
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(edges[-1] * denominator // numerator + 1)
    return np.array(edges)


def keyed(sets: DataFrame, larger: bool, counts, numerator: int, denominator: int, block: int) -> DataFrame:
    """(key, id, n, pos, parts, s0, s1, blocks) of sets (id, hashes), as the smaller or the larger of a pair; ``counts`` is a broadcast of ``bucket_counts``."""
    names = ("key long", "n int", "pos int", "parts int", "s0 long", "s1 long", "blocks int")
    schema = T.StructType([T.StructField("id", sets.schema["id"].dataType), *T.StructType.fromDDL(",".join(names)).fields])
    edges = _edges(numerator, denominator)

    def rows(tokens: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of sets of sizes n met in the classes ``kind``: (set, columns of a row)."""
        parts = np.maximum(1, np.round(edges[kind] / PART)).astype(np.int64)
        apart = 2 * n * (denominator - numerator) // (denominator + numerator) if larger else n * (denominator - numerator) // numerator
        most = apart // parts
        base = np.cumsum(parts) - parts
        at = np.repeat(np.arange(len(n)), n)
        mixed = tokens.view(np.uint64) * _MIX
        part = ((mixed >> np.uint64(20)) & np.uint64(0xFFFFF)).astype(np.int64) % parts[at]
        group = base[at] + part
        df = counts.value[tokens & (BUCKETS - 1)]
        order = np.lexsort((tokens, df, group))
        tokens, mixed, group, at, part, df = (x[order] for x in (tokens, mixed, group, at, part, df))
        total = int(parts.sum())
        size = np.bincount(group, minlength=total)
        start = np.cumsum(size) - size
        pos = np.arange(len(group)) - start[group]
        bit = mixed >> np.uint64(57)
        one = np.uint64(1) << (bit & np.uint64(63))
        sketch, full = np.zeros((2, total), np.uint64), size > 0
        for word in (0, 1):
            own = np.where(bit >> np.uint64(6) == word, one, np.uint64(0))
            if len(own):
                sketch[word, full] = np.bitwise_xor.reduceat(own, start[full])
        salt = lambda s, p: kind[s].astype(np.uint64) * _CLASS + p.astype(np.uint64) * _PIECE
        kept = pos <= most[at]
        # a part of so few tokens that it may share none meets all such parts
        owner = np.repeat(np.arange(len(n)), parts)
        few = np.flatnonzero(size <= 2 * most[owner])
        which = few - base[owner[few]]
        key = np.concatenate([(tokens.view(np.uint64)[kept] ^ salt(at[kept], part[kept])) * _MIX, salt(owner[few], which) + np.uint64(1)])
        s, g = np.concatenate([at[kept], owner[few]]), np.concatenate([group[kept], few])
        blocks = np.concatenate([1 + df[kept] // block, np.ones(len(few), np.int64)])
        return s, key.view(np.int64), n[s], np.concatenate([pos[kept], np.zeros(len(few), np.int64)]), parts[s], sketch[0, g].view(np.int64), sketch[1, g].view(np.int64), blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch["hashes"].value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(every)
            lo = 0
            while lo < len(every):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - every[lo] + TOKENS, side="right")))
                n, tokens = every[lo:hi], batch["hashes"].slice(lo, hi - lo).flatten().to_numpy()
                kind = np.searchsorted(edges, n, side="right") - 1
                # the larger of a pair is of the smaller one's class or of the next
                for met in (kind, kind - 1) if larger else (kind,):
                    fine = met >= 0
                    s, *columns = rows(tokens[np.repeat(fine, n)], n[fine], met[fine])
                    ids = batch["id"].slice(lo, hi - lo).take(pa.array(np.flatnonzero(fine)[s]))
                    made = [pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids, *made], names=schema.names)
                lo = hi

    kinds = [pa.field(f.name, pa.int64() if f.dataType == T.LongType() else pa.int32()) for f in schema.fields[1:]]
    return sets.select("id", "hashes").mapInArrow(run, schema)
