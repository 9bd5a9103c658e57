"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere are removed.

Suffixes matter only up to their first ``LENGTH`` bytes, their factors: in the
order of suffixes, those of equal factors are neighbours, sorted by position.
A suffix's previous and next smaller positions in that order give its longest
previous factor, which reaches ``LENGTH`` exactly if one of them has an equal
factor; the same with larger positions tells of later copies.  ``keep="first"``
removes what has an earlier copy, ``keep="none"`` all copies.

The corpus has a suffix for each byte, too many to sort at once, so the order is
built in two steps that lose no factor:

1. Every factor has an anchor, the least hash of its ``GRAM``-byte grams, so
   equal factors have equal anchors at equal places.  Consecutive factors with
   one anchor form a segment, and segments are put in order by (anchor, content):
   a segment with an earlier equal one is a later copy as a whole.
2. Only where different segments share an anchor, the factors of each one's
   first copy are put in order themselves.

Documents are packed into chunks of about ``CHUNK_BYTES``.  A chunk sends each
distinct segment or factor once, to the task that its hash names, and gets back
a byte that says whether there is an earlier or a later one.  So a passage that
a third of all documents share costs each chunk one entry, and no task sees more
than the chunks' distinct factors that hash to it.  Equal means equal 64-bit
hashes of the bytes.

The same is done with words in the place of bytes and ``PASSAGE`` in the place of
``LENGTH``, but only copies in other documents count: ``n_repeat_words`` says how
many words of a document lie in a passage of that many words or more that another
document has too.

Positions are ordered as the rows of the input are.  Defined results: a null
text is an empty one; texts shorter than ``LENGTH`` lose nothing; repeated rows
are copies of each other.  A new column replaces one of its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm.common import checkpoint, checkpoint_dealt, documents, partitions, release
from sparkloom.llm.textops import SEPARATOR, PrefixHash, Slice, slices

LENGTH = 400
GRAM = 128
#: Words of a passage, and of the grams that anchor it.
PASSAGE, PASSAGE_GRAM = 51, 17
CHUNK_BYTES = 4 << 20
#: A longer document is cut into overlapping blocks of as many factors.
BLOCK = 4 << 20
_PLACE = np.uint64((1 << 23) - 1)

EARLIER, LATER, APART = 1, 2, 4


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


_SEGMENT = np.dtype([("first", "<u4"), ("last", "<u4"), ("doc", "<u4"), ("anchor", "<u8"), ("content", "<u8")])


@dataclass(frozen=True)
class Unit:
    """What factors are made of, how many make one, and how many a gram of theirs."""

    words: bool
    length: int
    gram: int

    def of(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The units of a slice's documents end to end, and where each document's begin (n + 1)."""
        return _word_hashes(part) if self.words else (part.data, part.offsets)


def _word_hashes(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    if len(part.data) <= BLOCK:
        starts, ends, first = part.words()
        return PrefixHash(part.data).of(starts, ends) if len(starts) else np.empty(0, np.uint64), first
    # one long document, in blocks that end where a word does
    out, lo, n = [], 0, len(part.data)
    while lo < n:
        hi = min(n, lo + BLOCK)
        if hi < n:
            gaps = np.flatnonzero(SEPARATOR[part.data[lo:hi]])
            later = np.flatnonzero(SEPARATOR[part.data[hi:]][: 1 if len(gaps) else None])
            hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi + int(later[0]) + 1 if len(later) else n
        block = Slice(0, part.data[lo:hi], np.array([0, hi - lo]))
        starts, ends, _ = block.words()
        if len(starts):
            out.append(PrefixHash(block.data).of(starts, ends))
        lo = hi
    hashes = np.concatenate(out) if out else np.empty(0, np.uint64)
    return hashes, np.array([0, len(hashes)])


def _block_segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> np.ndarray:
    n = len(data)
    if n < length:
        return np.empty(0, _SEGMENT)
    hashed = PrefixHash(data)
    grams = hashed.rolling(gram)
    key = grams & ~_PLACE
    key |= np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(key, length - gram + 1) & _PLACE).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= length)
    inside[offsets[long]] = 1
    np.add.at(inside, offsets[long + 1] - length + 1, -1)
    valid = np.cumsum(inside[: len(anchor)], dtype=np.int8).astype(bool)
    anchor[~valid] = -1
    edge = np.ones(len(anchor), bool)
    edge[1:] = anchor[1:] != anchor[:-1]
    edge[offsets[long]] = True
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(anchor)) - 1
    own = anchor[first] >= 0
    first, last = first[own], last[own]
    out = np.empty(len(first), _SEGMENT)
    out["first"], out["last"] = first, last
    out["anchor"] = grams[anchor[first]]
    out["content"] = hashed.of(first, last + length)
    return out


def segments(texts: pa.Array, unit: Unit) -> np.ndarray:
    """Segments of the factors of some documents; places count units from the first document's start."""
    out, base, length = [np.empty(0, _SEGMENT)], 0, unit.length
    for part in slices(texts):
        values, offsets = unit.of(part)
        for lo in range(0, max(1, len(values)), BLOCK):
            cut = len(values) > BLOCK
            data = values[lo : lo + BLOCK + length - 1] if cut else values
            got = _block_segments(data, np.array([0, len(data)]) if cut else offsets, length, unit.gram)
            got["doc"] = part.first + (0 if cut else np.searchsorted(offsets, got["first"], "right") - 1)
            got["first"] += base + lo
            got["last"] += base + lo
            out.append(got)
            if not cut:
                break
        base += len(values)
    return np.concatenate(out)


def previous_factors(factor: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of suffixes by factor and position, and which of them, in it, have an earlier or a later equal.

    Equal factors lie side by side with rising positions, so a suffix's previous
    smaller position, if its factor is equal, is that of its left neighbour, and
    the next larger one that of its right.
    """
    order = np.lexsort((position, factor))
    same = factor[order][1:] == factor[order][:-1]
    earlier, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    earlier[1:], later[:-1] = same, same
    return order, earlier, later


# ---------------------------------------------------------------- chunks

_CHUNK = T.StructType(
    [T.StructField("chunk", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("rows", "segments", "word_segments")]]
)
_ENTRIES = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("entries", T.BinaryType())]
)
_ANSWERS = T.StructType(
    [
        T.StructField("chunk", T.LongType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("bits", T.BinaryType()),
    ]
)
_ZSTD = pa.Codec("zstd", 1) if pa.Codec.is_available("zstd") else pa.Codec("lz4")


def _write_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_ZSTD)) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read_rows(raw: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(raw)) as reader:
        return reader.read_next_batch()


def _packer(text_col: str, units: tuple[Unit, Unit], chunk_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch[text_col], chunk_bytes):
                rows = batch.slice(part.first, len(part))
                blobs = [_write_rows(rows)] + [segments(rows[text_col], u).tobytes() for u in units]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *[pa.array([x], pa.binary()) for x in blobs]], names=_CHUNK.names)
                chunk += 1

    return run


def _dealt(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries ordered by bucket (stable), and where each bucket begins."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _send(chunk: int, key: np.ndarray, buckets: int, words: bool, *columns: np.ndarray) -> pa.RecordBatch:
    """Entries by bucket; those of words have the buckets behind those of bytes."""
    order, edges = _dealt(key, buckets)
    there = np.flatnonzero(np.diff(edges))
    blobs = [b"".join(c[order[edges[b] : edges[b + 1]]].tobytes() for c in columns) for b in there]
    return pa.RecordBatch.from_arrays(
        [pa.array(there + buckets * words, pa.int32()), pa.array(np.full(len(there), chunk), pa.int64()), pa.array(blobs, pa.binary())],
        names=_ENTRIES.names,
    )


class Chunk:
    """Segments of a chunk: the distinct ones, sorted by content, and each one's first and last copy here."""

    def __init__(self, raw: bytes, unit: Unit):
        self.unit = unit
        self.all = np.frombuffer(raw, _SEGMENT)
        self.content, self.head, self.which = np.unique(self.all["content"], return_index=True, return_inverse=True)
        self.anchor = self.all["anchor"][self.head]

    def local(self) -> np.ndarray:
        """Bits of earlier and later copies within the chunk; of words only those in other documents count."""
        return _local(self.which, len(self.content), self.all["doc"] if self.unit.words else None)

    def apart(self, bits: np.ndarray) -> np.ndarray:
        """The segments whose factors are compared one by one: those that the first step set apart, of bytes the first copies only."""
        hit = (bits & APART) > 0
        return self.all[hit[self.which]] if self.unit.words else self.all[np.sort(self.head[hit])]


def _local(which: np.ndarray, n: int, doc: np.ndarray | None) -> np.ndarray:
    at = np.arange(len(which)) if doc is None else doc.astype(np.int64)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(first, which, at)
    np.maximum.at(last, which, at)
    return ((at > first[which]) * EARLIER | (at < last[which]) * LATER).astype(np.uint8)


def _bits(answers: pa.Table, step: int, key: np.ndarray, buckets: int) -> np.ndarray:
    """What the tasks of a step said about the distinct entries of a chunk."""
    order, edges = _dealt(key, buckets)
    out = np.zeros(len(key), np.uint8)
    steps = answers["step"].to_numpy() == step
    for k in np.flatnonzero(steps):
        bucket = answers["bucket"][k].as_py()
        out[order[edges[bucket] : edges[bucket + 1]]] = np.frombuffer(answers["bits"][k].as_py(), np.uint8)
    return out


def _chunks(chunks: pa.RecordBatch | pa.Table, units: tuple[Unit, Unit]) -> Iterator[tuple[int, bytes, list[Chunk]]]:
    for chunk, rows, *raw in zip(*(chunks[c].to_pylist() for c in _CHUNK.names), strict=True):
        yield chunk, rows, [Chunk(x, u) for x, u in zip(raw, units, strict=True)]


def _segment_entries(units: tuple[Unit, Unit], buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, _, both in _chunks(batch, units):
                for own in both:
                    yield _send(chunk, own.anchor, buckets, own.unit.words, own.anchor, own.content)

    return run


def _ordered(step: int, buckets: int):
    """Answers for the entries of one task: bits of an earlier and a later equal; APART for a segment's first copy
    whose anchor other segments have too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for bucket, chunk, raw in zip(*(batch[c].to_pylist() for c in _ENTRIES.names), strict=True):
                held.setdefault(bucket, []).append((chunk, raw))
        width = 16 if step == 1 else 8
        for bucket in list(held):
            rows = held.pop(bucket)
            sizes = [len(raw) // width for _, raw in rows]
            position = np.repeat(np.array([chunk for chunk, _ in rows], np.int64), sizes)
            if step == 1:
                anchor = np.concatenate([np.frombuffer(raw, np.uint64, n) for (_, raw), n in zip(rows, sizes, strict=True)])
                factor = np.concatenate([np.frombuffer(raw, np.uint64, n, 8 * n) for (_, raw), n in zip(rows, sizes, strict=True)])
            else:
                factor = np.concatenate([np.frombuffer(raw, np.uint64) for _, raw in rows])
            order, earlier, later = previous_factors(factor, position)
            said = earlier * EARLIER | later * LATER
            bits = np.empty(len(order), np.uint8)
            bits[order] = said
            if step == 1:
                # of each content's first copies, those whose anchor is not theirs alone
                firsts = order[~earlier]
                by = firsts[np.argsort(anchor[firsts], kind="stable")]
                same = anchor[by][1:] == anchor[by][:-1]
                shared = np.zeros(len(by), bool)
                shared[1:] |= same
                shared[:-1] |= same
                bits[by[shared]] |= APART
            edges = np.concatenate([[0], np.cumsum(sizes)])
            kept = [k for k in range(len(rows)) if bits[edges[k] : edges[k + 1]].any()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][0] for k in kept], pa.int64()),
                    pa.array(np.full(len(kept), step + 2 * (bucket >= buckets)), pa.int32()),
                    pa.array(np.full(len(kept), bucket % buckets), pa.int32()),
                    pa.array([bits[edges[k] : edges[k + 1]].tobytes() for k in kept], pa.binary()),
                ],
                names=_ANSWERS.names,
            )

    return run


def _factors(rows: pa.RecordBatch, text_col: str, chosen: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and documents of the factors of the chosen segments."""
    places, hashes, base, length = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0, unit.length
    first, last = chosen["first"].astype(np.int64), chosen["last"].astype(np.int64)
    for part in slices(rows[text_col]):
        values, _ = unit.of(part)
        for lo in range(0, max(1, len(values)), BLOCK):
            cut = len(values) > BLOCK
            a, b = np.searchsorted(first, [base + lo, base + min(len(values), lo + BLOCK) if cut else base + len(values)])
            if b > a:
                n = last[a:b] - first[a:b] + 1
                place = np.arange(n.sum()) + np.repeat(first[a:b] - (np.cumsum(n) - n), n)
                local = place - (base + lo)
                places.append(place)
                hashes.append(PrefixHash(values[lo : lo + BLOCK + length - 1] if cut else values).of(local, local + length))
            if not cut:
                break
        base += len(values)
    return np.concatenate(places), np.concatenate(hashes), np.repeat(chosen["doc"], last - first + 1)


def _factor_entries(text_col: str, units: tuple[Unit, Unit], buckets: int):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for chunk, raw, both in _chunks(chunks, units):
            rows = None
            for own in both:
                chosen = own.apart(_bits(answers, 1 + 2 * own.unit.words, own.anchor, buckets))
                if len(chosen):
                    rows = rows or _read_rows(raw)
                    factor = np.unique(_factors(rows, text_col, chosen, own.unit)[1])
                    out.append(_send(chunk, factor, buckets, own.unit.words, factor))
        return pa.Table.from_batches(out, to_arrow_schema(_ENTRIES))

    return run


def covered(own: Chunk, rows: pa.RecordBatch, text_col: str, answers: pa.Table, buckets: int, n: int, wanted: int) -> np.ndarray:
    """Which of the n units of a chunk lie under a factor that has one of the wanted bits."""
    step, length = 1 + 2 * own.unit.words, own.unit.length
    bits = _bits(answers, step, own.anchor, buckets)
    edge = np.zeros(n + 1, np.int64)
    every = own.all[((own.local() | bits[own.which]) & wanted) > 0]
    runs = [(every["first"].astype(np.int64), every["last"].astype(np.int64) + length)]
    chosen = own.apart(bits)
    if len(chosen):
        place, factor, doc = _factors(rows, text_col, chosen, own.unit)
        distinct, which = np.unique(factor, return_inverse=True)
        said = _local(which, len(distinct), doc if own.unit.words else None) | _bits(answers, step + 1, distinct, buckets)[which]
        one = place[(said & wanted) > 0]
        runs.append((one, one + length))
    for begin, end in runs:
        edge += np.bincount(begin, minlength=n + 1)
        edge -= np.bincount(end, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def _remover(text_col: str, units: tuple[Unit, Unit], buckets: int, wanted: int, names: list[str], clean_col: str | None, schema: pa.Schema):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for _, raw, (own, own_words) in _chunks(chunks, units):
            rows = _read_rows(raw)
            (part,) = list(slices(rows[text_col], 1 << 62))
            gone = covered(own, rows, text_col, answers, buckets, len(part.data), wanted)
            total = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edges = part.offsets[:-1][np.diff(part.offsets) > 0]
            begins[edges] = gone[edges]
            runs = np.concatenate([[0], np.cumsum(begins)])
            removed = np.diff(total[part.offsets])
            kept = [
                part.raw(i) if not removed[i] else part.data[lo:hi][~gone[lo:hi]].tobytes()
                for i, (lo, hi) in enumerate(zip(part.offsets[:-1], part.offsets[1:], strict=True))
            ]
            first = np.concatenate([[0], np.cumsum([n for p in slices(rows[text_col]) for n in np.diff(own_words.unit.of(p)[1])])]).astype(np.int64)
            repeated = np.concatenate([[0], np.cumsum(covered(own_words, rows, text_col, answers, buckets, first[-1], EARLIER | LATER))])
            new = [np.diff(part.offsets), removed, np.diff(runs[part.offsets]), [hashlib.sha256(x).hexdigest() for x in kept], np.diff(repeated[first])]
            if clean_col:
                new.append([x.decode("utf-8", "ignore") for x in kept])
            columns = [rows[c] for c in names] + [pa.array(x) for x in new]
            out.append(pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def suffix_dedup(
    docs: DataFrame,
    text_col: str = "text",
    keep: str = "first",
    clean_col: str | None = "clean_text",
    length: int = LENGTH,
    gram: int = GRAM,
    chunk_bytes: int = CHUNK_BYTES,
    passage: int = PASSAGE,
) -> DataFrame:
    """Append n_bytes, n_removed, n_spans, kept_sha256 of the remaining bytes and n_repeat_words; with ``clean_col`` also the remaining text.

    ``keep``: "first" leaves the first copy of what repeats, "none" leaves none.
    """
    if keep not in ("first", "none"):
        raise ValueError(f"keep is 'first' or 'none', not {keep!r}")
    wanted = EARLIER if keep == "first" else EARLIER | LATER
    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    fields += [T.StructField("kept_sha256", T.StringType()), T.StructField("n_repeat_words", T.LongType())]
    if clean_col:
        fields.append(T.StructField(clean_col, T.StringType()))
    fresh = {f.name.lower() for f in fields}
    names = [c for c in docs.columns if c.lower() not in fresh]
    schema = T.StructType([docs.schema[c] for c in names if c != text_col] + fields)
    carried = [c for c in names if c != text_col]
    docs = docs.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col))
    n = partitions(docs.sparkSession)
    units = (Unit(False, length, gram), Unit(True, passage, min(passage, PASSAGE_GRAM)))
    chunks = checkpoint_dealt(docs.mapInArrow(_packer(text_col, units, chunk_bytes), _CHUNK).repartition(n, "chunk"))
    release(docs.sparkSession)
    sent = chunks.mapInArrow(_segment_entries(units, n), _ENTRIES)
    first = checkpoint(sent.repartitionById(n, F.col("bucket") % n).mapInArrow(_ordered(1, n), _ANSWERS))
    del sent
    release(docs.sparkSession)
    by_chunk = chunks.groupBy("chunk")
    sent = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(_factor_entries(text_col, units, n), _ENTRIES)
    second = checkpoint(sent.repartitionById(n, F.col("bucket") % n).mapInArrow(_ordered(2, n), _ANSWERS))
    del sent
    release(docs.sparkSession)
    remove = _remover(text_col, units, n, wanted, carried, clean_col, to_arrow_schema(schema))
    return by_chunk.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(remove, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return suffix_dedup(docs, keep="none", clean_col=None)
