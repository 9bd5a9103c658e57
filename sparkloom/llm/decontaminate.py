"""Benchmark decontamination by q-gram lemma filtering.

Two strings of m bytes within e edits share at least m + 1 - q (e + 1) q-grams,
and the diagonals of those q-grams differ by at most e.  So all documents are
scanned for q-grams of the benchmark; hits are counted in overlapping diagonal
bands (each diagonal lies in two bands of width 2 (e + 1)), regions of m + e
bytes with enough hits in a band are retained, and every retained region is
verified by banded alignment: as a whole, and if that fails by every placement
of a piece of ``WINDOW`` bytes of the item over its hits.

Texts are compared with A-Z lower-cased and every separator as a blank.  A match
is a passage of at least ``WINDOW`` bytes of an item (all of a shorter item)
within ``EDITS`` edits for each ``WINDOW`` bytes.  Every piece of ``WINDOW`` bytes
within ``EDITS`` edits is found; longer passages with as many edits in proportion,
but in none of their pieces, count where their hits' region is one.  Items of 20
to 23 bytes match without edits only, for one edit may leave them no q-gram.

Runs that repeat a period of up to ``MOST_PERIOD`` bytes (rules of dashes, blank
fields) give the same q-grams over and over and say nothing of a passage, so those
q-grams are left out on both sides, and what a window lacks for them is taken off
the count that it needs.  A window made of nothing else is no passage; one that
has few others is found if one of them is whole.

The q-gram index of the benchmark goes to every task.  Its size is checked: a
benchmark of more than ``BLOCK_BYTES`` is split into blocks of items, and the
documents are scanned once for each block.

Defined results: a row for each document row and item that it contains, with the
longest verified region in code points.  Null and empty texts match nothing, nor
do items of fewer than ``Q`` bytes.  Rows that repeat match for each row, as do
items.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import BATCH_ROWS, append_columns, documents, free_name, table
from sparkloom.llm.textops import LOWER_ASCII, SEPARATOR, Slice, slices

Q = 12
WINDOW = 80
EDITS = 4
BLOCK_BYTES = 16 << 20
#: Longest period of a run whose q-grams are left out.
MOST_PERIOD = 6

_FOLD = np.where(SEPARATOR, 32, LOWER_ASCII).astype(np.uint8)
_FILTER_BITS = 22


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the Q bytes from each position."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))
    eight = np.ascontiguousarray(word).view("<u8").ravel()
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= (eight[Q - 8 : Q - 8 + n] ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def _periodic(data: np.ndarray) -> np.ndarray:
    """Whether the Q bytes from each position repeat a period of at most ``MOST_PERIOD`` bytes."""
    n = max(0, len(data) - Q + 1)
    out = np.zeros(n, bool)
    for period in range(1, MOST_PERIOD + 1):
        same = np.concatenate([[0], np.cumsum(data[period:] == data[:-period], dtype=np.int64)])
        if n:
            out |= same[Q - period :][:n] - same[: n] == Q - period
    return out


@dataclass
class Index:
    """Grams of all items of a block end to end, and per item its place and thresholds."""

    ids: list
    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each hash in positions
    positions: np.ndarray
    present: np.ndarray
    window: np.ndarray
    edits: np.ndarray
    needed: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Index:
        raw = [_FOLD[np.frombuffer(t.encode(), np.uint8)] for t in texts]
        lengths = np.array([len(r) for r in raw], np.int64)
        data = np.concatenate(raw) if raw else np.empty(0, np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        h = _grams(data)
        at = np.arange(len(h))
        item = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[item + 1] if len(h) else np.empty(0, bool)
        plain = ~_periodic(data)
        window = np.minimum(lengths, WINDOW)
        edits = np.minimum(window * EDITS // WINDOW, np.maximum(0, window // Q - 1))
        needed = np.maximum(1, window + 1 - Q * (edits + 1) - _most_lacking(~plain, offsets, window))
        h, at = h[inside & plain], at[inside & plain]
        order = np.argsort(h, kind="stable")
        hashes, first = np.unique(h[order], return_index=True)
        present = np.zeros(1 << _FILTER_BITS, bool)
        present[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        return cls(ids, data, offsets, hashes, np.append(first, len(order)), at[order], present, window, edits, needed)


def _most_lacking(periodic: np.ndarray, offsets: np.ndarray, window: np.ndarray) -> np.ndarray:
    """For each item the most q-grams that any of its windows lacks because they are periodic."""
    run = np.concatenate([[0], np.cumsum(periodic)])
    out = np.zeros(len(window), np.int64)
    for i, (lo, hi, size) in enumerate(zip(offsets[:-1], offsets[1:], window, strict=True)):
        if size >= Q:
            begin = np.arange(lo, hi - size + 1)
            out[i] = (run[begin + size - Q + 1] - run[begin]).max()
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance of two byte strings, or limit + 1 if it is larger: alignment within a band of the diagonal."""
    if len(a) == len(b) and np.array_equal(a, b):
        return 0
    n = min(len(a), len(b))
    differs = a[:n] != b[:n]
    lo = int(differs.argmax()) if differs.any() else n
    a, b = a[lo:], b[lo:]
    n = min(len(a), len(b))
    differs = a[len(a) - n :][::-1] != b[len(b) - n :][::-1]
    hi = int(differs.argmax()) if differs.any() else n
    a, b = a[: len(a) - hi].tolist(), b[: len(b) - hi].tolist()
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    row = {j: j for j in range(min(len(b), limit) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - limit), min(len(b), i + limit) + 1):
            best = row.get(j, limit) + 1
            if j:
                best = min(best, new.get(j - 1, limit) + 1, row.get(j - 1, limit + 1) + (x != b[j - 1]))
            new[j] = best
        row = new
        if min(row.values()) > limit:
            return limit + 1
    return min(row.get(len(b), limit + 1), limit + 1)


def matches(part: Slice, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(document, item, start byte, end byte, edits) of verified regions of a slice, the longest of each pair."""
    data = _FOLD[part.data]
    h = _grams(data)
    at = np.flatnonzero(index.present[h >> np.uint64(64 - _FILTER_BITS)])
    if not len(at) or not len(index.hashes):
        return []
    place = np.searchsorted(index.hashes, h[at])
    place[place == len(index.hashes)] = 0
    doc = np.searchsorted(part.offsets, at, "right") - 1
    exact = (index.hashes[place] == h[at]) & (at + Q <= part.offsets[doc + 1])
    at, place, doc = at[exact], place[exact], doc[exact]
    counts = index.first[place + 1] - index.first[place]
    if not counts.sum():
        return []
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    g = index.positions[np.repeat(index.first[place], counts) + within]
    p, doc = np.repeat(at, counts), np.repeat(doc, counts)
    item = np.searchsorted(index.offsets, g, "right") - 1
    step = EDITS + 1
    band = (p - g) // step
    item, doc, p, g = (np.concatenate([x, x]) for x in (item, doc, p, g))
    band = np.concatenate([band, band - 1])
    order = np.lexsort((g, p, band, item, doc))
    doc, item, band, p, g = (x[order] for x in (doc, item, band, p, g))
    same = np.ones(len(p), bool)
    same[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
    group = np.cumsum(same) - 1
    need = index.needed[item]
    last = np.arange(len(p)) + need - 1
    fits = last < len(p)
    last[~fits] = 0
    fits &= group[last] == group
    fits &= p[last] - p <= index.window[item] + index.edits[item] - Q
    windows = np.flatnonzero(fits)
    best: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
    if not len(windows):
        return []
    # windows that overlap in one group make one region
    apart = np.flatnonzero((group[windows[1:]] != group[windows[:-1]]) | (windows[1:] > last[windows[:-1]])) + 1
    for at, end in zip(windows[np.append(0, apart)], last[windows[np.append(apart, len(windows)) - 1]], strict=True):
        i = int(item[at])
        held = best.get((int(doc[at]), i))
        if held and held[3] - held[2] >= index.offsets[i + 1] - index.offsets[i]:
            continue  # the whole item is found already
        found = _verify(data, index, doc, item, p, g, at, end, part)
        if found is None:
            found = _placed(data, index, doc, item, band, g, at, end, part)
        if found is not None and (held is None or held[3] - held[2] < found[3] - found[2]):
            best[found[:2]] = found
    return sorted(best.values())


def _verify(data, index: Index, doc, item, p, g, lo: int, hi: int, part: Slice):
    """Align the region between two hits of a band, widened to the least window."""
    d, i = int(doc[lo]), int(item[lo])
    low, high = int(index.offsets[i]), int(index.offsets[i + 1])
    begin, end = int(part.offsets[d]), int(part.offsets[d + 1])
    least, allowed = int(index.window[i]), int(index.edits[i])
    a0, b0 = int(p[lo]), int(g[lo])
    a1, b1 = int(p[hi]) + Q, int(g[hi]) + Q
    if b1 <= b0:
        return None
    # extend over equal bytes on both sides
    while a0 > begin and b0 > low and data[a0 - 1] == index.data[b0 - 1]:
        a0, b0 = a0 - 1, b0 - 1
    while a1 < end and b1 < high and data[a1] == index.data[b1]:
        a1, b1 = a1 + 1, b1 + 1
    short = least - (b1 - b0)
    if short > 0:
        right = min(short, high - b1, end - a1)
        left = min(short - right, b0 - low, a0 - begin)
        a0, b0, a1, b1 = a0 - left, b0 - left, a1 + right, b1 + right
    size = b1 - b0
    if size < least - allowed or a1 <= a0:
        return None
    limit = max(allowed, allowed * size // max(1, least)) - max(0, least - size)
    edits = edit_distance(index.data[b0:b1], data[a0:a1], limit)
    return (d, i, a0 - begin, a1 - begin, edits) if edits <= limit else None


def _placed(data, index: Index, doc, item, band, g, lo: int, hi: int, part: Slice):
    """The longest run of least windows of the item, each within the allowed edits of a passage at the hits' diagonals."""
    d, i = int(doc[lo]), int(item[lo])
    low, high = int(index.offsets[i]), int(index.offsets[i + 1])
    begin, end = int(part.offsets[d]), int(part.offsets[d + 1])
    least, allowed = int(index.window[i]), int(index.edits[i])
    hits = np.sort(g[lo : hi + 1])
    at = np.arange(max(low, int(hits[0]) + Q - least), min(high - least, int(hits[-1])) + 1)
    inside = np.searchsorted(hits, at + least - Q, "right") - np.searchsorted(hits, at)
    at = at[inside >= index.needed[i]]
    if not len(at):
        return None
    # an alignment leaves the diagonals of its hits by its edits at most; cells hold edits and the diagonal it began on
    step = EDITS + 1
    diagonal = np.arange(step * int(band[lo]) - EDITS, step * (int(band[lo]) + 2) + EDITS)
    width = len(diagonal)
    one, never = 2 * width, 2 * width * (least + 1)
    along = one * np.arange(width)
    place = at[:, None] + diagonal
    cost = np.where((place >= begin) & (place <= end), np.arange(width), never)
    for t in range(least):
        there = (place >= begin) & (place < end)
        differs = index.data[at + t][:, None] != data[np.where(there, place, begin)]
        new = np.where(there, cost + one * differs, never)
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + one)
        place = place + 1
        new = np.minimum.accumulate(new - along, axis=1) + along
        cost = np.where((place >= begin) & (place <= end), new, never)
        if t % 8 == 7 and cost.min() >= one * (allowed + 1):
            return None
    edits = cost.min(axis=1) // one
    good = np.flatnonzero(edits <= allowed)
    if not len(good):
        return None
    runs = np.split(good, np.flatnonzero(np.diff(at[good]) > 1) + 1)
    run = max(runs, key=len)
    b0, b1 = int(at[run[0]]), int(at[run[-1]]) + least
    a0 = b0 + int(diagonal[cost[run[0]].min() % one])
    a1 = b1 + int(diagonal[cost[run[-1]].argmin()])
    limit = allowed
    while (total := edit_distance(index.data[b0:b1], data[a0:a1], limit)) > limit:
        limit = 2 * limit + 1
    return (d, i, a0 - begin, a1 - begin, total)


def _blocks(benchmark: DataFrame, item_col: str) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of the items, block after block of about ``BLOCK_BYTES`` at most."""
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        got = some.toArrow().sort_by([("item", "ascending"), ("text", "ascending")])
        yield got["item"].combine_chunks(), got["text"].to_pylist()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """A row for each document and benchmark item that it contains."""
    fields = [docs.schema[id_col], T.StructField(item_col, benchmark.schema[item_col].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "end", "edits")]
    schema = T.StructType(fields)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    out = None
    for block in _blocks(benchmark, item_col):
        found = rows.mapInArrow(_scanner(docs.sparkSession.sparkContext.broadcast(block), schema), schema)
        out = found if out is None else out.unionByName(found)
    return out


def count_items(docs: DataFrame, benchmark: DataFrame, count_col: str, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Append how many benchmark items each row's text contains: rows are judged where they lie, without a shuffle or an id."""

    def counter(shared):
        def make():
            _, texts = shared.value
            index = Index.of(list(range(len(texts))), texts)
            return lambda part: [np.bincount([m[0] for m in matches(part, index)], minlength=len(part))]

        return make

    total, names = F.lit(0).cast("long"), []
    for block in _blocks(benchmark, item_col):
        name = free_name(docs, f"{count_col}_of_block")
        names.append(name)
        docs = append_columns(docs, text_col, [T.StructField(name, T.LongType())], counter(docs.sparkSession.sparkContext.broadcast(block)))
        total += F.col(name)
    return docs.withColumn(count_col, total).drop(*names)


def _scanner(shared, schema: T.StructType):
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        index = Index.of(list(range(len(texts))), texts)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(lo, BATCH_ROWS)
                source, item, start, end, edits = [], [], [], [], []
                for part in slices(rows.column(1)):
                    for d, i, a, b, e in matches(part, index):
                        raw = part.raw(d)
                        source.append(part.first + d)
                        item.append(i)
                        start.append(len(raw[:a].decode("utf-8", "ignore")))
                        end.append(len(raw[:b].decode("utf-8", "ignore")))
                        edits.append(e)
                if source:
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).take(pa.array(source)), ids.take(pa.array(item))]
                        + [pa.array(x, pa.int64()) for x in (start, end, edits)],
                        names=names,
                    )

    return run


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
