"""Alignment of two tokenizers' tokens through a dictionary of groups.

Both tokenizers cut the same bytes: those of a space and the text.  Where tokens
of both end, the text falls into groups, runs of A ids facing runs of B ids.
Texts repeat few groups very often, so each distinct group is interned once:

1. A task encodes its documents and gathers them into chunks of bounded size.  A
   chunk holds, for each document, the chunk's groups that it has and how often;
   next to it goes one row for each distinct group of the chunk.
2. Rows of one group are summed over all chunks: the dictionary, with the
   frequency of each group and the number of documents that have it.
3. Each distinct group is expanded once into its links, the pairs of an A and a
   B token whose byte ranges end together.  A pair's count is the sum of its
   groups' frequencies (or of their documents); each group gets the sum of its
   links' counts and the number of links that are the best of their B id.
4. These go back to the chunks by group key, and documents sum them up.

So what is shuffled grows with the distinct groups of chunks, not with tokens.

Neither tokenizer here has a token in which a space follows another character,
so what stands between one such place and the next, a unit, is encoded the same
way in any text.  A worker keeps the units that it has met (at most ``UNITS``
when a chunk begins, found by 64-bit hashes, which are taken for equality) and
encodes only new ones.  A pair of tokenizers without that property is refused.

Defined results: a text that is null, empty, or not given back by both
tokenizers byte for byte has no tokens: zeros, and an empty digest.  Repeated
rows give a row each and count as often as they stand; an empty table gives
none.  A text of any length is one document of one chunk; a pair of equal count
with another is best like it.  Only id and text are read, so other columns don't
matter, whatever their names; a null id stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import checkpoint, documents
from sparkloom.llm.packing import spans
from sparkloom.llm.textops import PrefixHash, Slice, mix, slices

#: Text bytes of a chunk, about; a longer document has a chunk of its own.
CHUNK_BYTES = 8 << 20
UNITS = 500_000
#: Bytes of units that are encoded with one call.
CALL_BYTES = 16_384

_SPACE = 0x20


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- tokenizers


class Bytes:
    """The bytes of every id of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.n = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spans(self.at[ids], self.n[ids])]


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteLevel:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # special tokens' strings are plain text
        letter = byte_letters()
        tokens = [b""] * self.model.get_vocab_size()
        for token, i in self.model.get_vocab().items():
            tokens[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        self.bytes = Bytes(tokens)
        self.inner_space = any(re.search(rb"[^ \s\xc2\xa0] ", t) for t in tokens)

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        tokens = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes = Bytes(tokens)
        self.space = self.model.piece_to_id("▁")
        self.inner_space = any(re.search("[^▁]▁", p) for p in pieces)

    def __call__(self, text: str) -> np.ndarray:
        """Ids of a text that begins with a space, which the model adds by itself to all but an empty text."""
        return np.array(self.model.encode(text[1:]) if len(text) > 1 else [self.space], np.int64)


# ---------------------------------------------------------------- units and groups


class Interned:
    """64-bit keys, numbered in the order in which they came."""

    def __init__(self):
        self.keys, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers, -1 for an unknown key."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.number[at], -1)

    def add(self, keys: np.ndarray) -> None:
        """Keys not there yet, each once."""
        number = np.concatenate([self.number, len(self.keys) + np.arange(len(keys))])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.number = keys[order], number[order]


class Lists:
    """Lists of numbers end to end, to which more are added."""

    def __init__(self, kind):
        self.n, self.at, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind)

    def add(self, n: np.ndarray, flat: np.ndarray) -> None:
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])

    def of(self, which: np.ndarray) -> np.ndarray:
        return self.flat[spans(self.at[which], self.n[which])]


def maybe_white(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character that ends there may be white space: surely if it is, and for some others."""
    one, two, three = (np.where(ends > k, data[np.maximum(ends - 1 - k, 0)], 0) for k in range(3))
    odd = one <= _SPACE
    odd |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    # characters of U+1680 to U+16BF, U+2000 to U+207F and U+3000 to U+307F, among which the other white space is
    return odd | (three >= 0xE1) & (three <= 0xE3) & (((two & 0xFE) == 0x80) | (two == 0x9A))


def units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: at each document, and at each space behind a character that is no white space."""
    space = np.flatnonzero(data == _SPACE)
    begin = np.zeros(len(data), bool)
    begin[space[~maybe_white(data, space)]] = True
    begin[offsets[:-1]] = True
    return np.flatnonzero(begin)


@dataclass
class Encoded:
    """A slice's documents: counts of tokens and groups, digests, and of each document its distinct groups and how often it has them."""

    numbers: np.ndarray
    digests: list[str]
    doc: np.ndarray
    group: np.ndarray
    times: np.ndarray


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        if self.a.inner_space or self.b.inner_space:
            raise ValueError("a token holds a space behind another character, so texts can't be cut at spaces")
        self.clear()

    def clear(self) -> None:
        self.units, self.groups = Interned(), Interned()
        self.a_ids, self.b_ids = Lists("<i4"), Lists("<i4")  # of groups
        self.unit_groups, self.unit_text = Lists(np.int64), Lists(np.uint8)
        self.unit_counts = np.empty((0, 3), np.int64)  # A tokens, B tokens, and whether both give the unit's bytes back

    def _both(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers, if both give the bytes back."""
        a, b = self.a(text.decode()), self.b(text.decode())
        same = all(x.bytes.of(ids).tobytes() == text for x, ids in ((self.a, a), (self.b, b)))
        return (a, b) if same else None

    def _encode(self, raw: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of units end to end, and of which units they are; the units that don't come back are left out."""
        a_ids, b_ids, good = [], [], np.zeros(len(raw), bool)
        white = maybe_white(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(u) for u in raw])).tolist()
        calls, one, size = [], [], 0
        for k, u in enumerate(raw):
            if b"\xe2\x96\x81" in u:
                continue  # that character and a space are one to B
            if white[k]:
                calls.append([k])  # behind white space a space is no place to cut
                continue
            one.append(k)
            size += len(u)
            if size >= CALL_BYTES:
                calls.append(one)
                one, size = [], 0
        if one:
            calls.append(one)
        pending = [(c, len(c) > 1) for c in calls]
        for call, many in pending:
            got = self._both(b"".join([raw[k] for k in call]))
            if got is None:
                if many:
                    pending += [([k], False) for k in call]
                continue
            good[call] = True
            a_ids.append((call, got[0]))
            b_ids.append((call, got[1]))
        return a_ids, b_ids, good

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        found_a, found_b, good = self._encode(raw)
        # units in the order of calls, those that don't come back last, without tokens
        order = np.array([k for call, _ in found_a for k in call] + np.flatnonzero(~good).tolist(), np.int64)
        sizes = np.where(good, [len(u) for u in raw], 0)[order]
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        a, b = (np.concatenate([np.empty(0, np.int64), *[ids for _, ids in found]]) for found in (found_a, found_b))
        a_end, b_end = np.cumsum(self.a.bytes.n[a]), np.cumsum(self.b.bytes.n[b])
        mark = np.zeros(total + 1, np.uint8)
        mark[a_end] |= 1
        mark[b_end] |= 2
        cut = np.flatnonzero(mark == 3)  # where groups end
        a_n, b_n = (np.diff(np.searchsorted(e, cut, "right"), prepend=0) for e in (a_end, b_end))
        a_first, b_first = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
        a_hash, b_hash = (PrefixHash(mix(x.astype(np.uint64) + np.uint64(1))).of(f, f + n) for x, f, n in ((a, a_first, a_n), (b, b_first, b_n)))
        key = mix(a_hash + mix(b_hash))
        distinct, head, which = np.unique(key, return_index=True, return_inverse=True)
        number = self.groups.find(distinct)
        new = number < 0
        at = head[new]
        self.groups.add(distinct[new])
        self.a_ids.add(a_n[at], a[spans(a_first[at], a_n[at])])
        self.b_ids.add(b_n[at], b[spans(b_first[at], b_n[at])])
        number = self.groups.find(distinct)[which]
        of_unit = np.diff(np.searchsorted(cut, ends, "right"), prepend=0)
        self.units.add(keys[order])
        self.unit_groups.add(of_unit, number)
        counts = [np.diff(np.searchsorted(e, ends, "right"), prepend=0) for e in (a_end, b_end)]
        self.unit_counts = np.concatenate([self.unit_counts, np.stack([*counts, good[order]], 1)])
        text = [self._text(a[i : i + m], b[j : j + n]) for i, m, j, n in zip(a_first.tolist(), a_n.tolist(), b_first.tolist(), b_n.tolist(), strict=True)]
        length = np.cumsum([0, *map(len, text)])
        edge = np.cumsum([0, *of_unit.tolist()])
        self.unit_text.add(np.diff(length[edge]), np.frombuffer(b"".join(text), np.uint8))

    @staticmethod
    def _text(a: np.ndarray, b: np.ndarray) -> bytes:
        return f"{','.join(map(str, a.tolist()))}|{','.join(map(str, b.tolist()))};".encode()

    def encode(self, part: Slice) -> Encoded:
        n_docs, lengths = len(part), np.diff(part.offsets)
        # a space before each document
        offsets = part.offsets + np.arange(n_docs + 1)
        data = np.full(len(part.data) + n_docs, _SPACE, np.uint8)
        data[np.arange(len(part.data)) + np.repeat(np.arange(1, n_docs + 1), lengths)] = part.data
        starts = units(data, offsets)
        ends = np.append(starts[1:], len(data))
        doc = np.searchsorted(offsets, starts, "right") - 1
        keep = lengths[doc] > 0
        starts, ends, doc = starts[keep], ends[keep], doc[keep]
        numbers = np.zeros((n_docs, 3), np.int64)
        if not len(starts):
            return Encoded(numbers, [""] * n_docs, *[np.empty(0, np.int64)] * 3)
        keys, head, which = np.unique(PrefixHash(data).of(starts, ends), return_index=True, return_inverse=True)
        number = self.units.find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            raw = data.tobytes()
            self._learn(keys[new], [raw[i:j] for i, j in zip(starts[head[new]].tolist(), ends[head[new]].tolist(), strict=True)])
            number = self.units.find(keys)
        unit = number[which]
        bad = np.zeros(n_docs, bool)
        bad[doc[self.unit_counts[unit, 2] == 0]] = True
        unit, doc = unit[~bad[doc]], doc[~bad[doc]]
        for c, values in enumerate((self.unit_counts[:, 0], self.unit_counts[:, 1], self.unit_groups.n)):
            numbers[:, c] = np.bincount(doc, values[unit], n_docs)
        text = memoryview(self.unit_text.of(unit).tobytes())
        edge = np.concatenate([[0], np.cumsum(np.bincount(doc, self.unit_text.n[unit], n_docs).astype(np.int64))]).tolist()
        digests = [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(edge, edge[1:], strict=False)]
        # units that a document repeats are taken together first
        pairs, times = np.unique(doc * len(self.units) + unit, return_counts=True)
        doc, unit = np.divmod(pairs, len(self.units))
        n = self.unit_groups.n[unit]
        group, doc, times = self.unit_groups.of(unit), np.repeat(doc, n), np.repeat(times, n)
        pairs, back = np.unique(doc * len(self.groups) + group, return_inverse=True)
        doc, group = np.divmod(pairs, len(self.groups))
        return Encoded(numbers, digests, doc, group, np.bincount(back, times, len(pairs)).astype(np.int64))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for all tasks of a worker process."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


# ---------------------------------------------------------------- chunks

#: A chunk's row has docs to times, the row of one of its groups the rest.
_CHUNKS = T.StructType(
    [
        T.StructField("chunk", T.LongType()),
        T.StructField("docs", T.ArrayType(T.LongType())),
        T.StructField("numbers", T.BinaryType()),
        T.StructField("digests", T.ArrayType(T.StringType())),
        T.StructField("edges", T.BinaryType()),
        T.StructField("places", T.BinaryType()),
        T.StructField("times", T.BinaryType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("group_key", T.LongType()),
        T.StructField("a_ids", T.BinaryType()),
        T.StructField("b_ids", T.BinaryType()),
        T.StructField("occurrences", T.LongType()),
        T.StructField("documents", T.LongType()),
    ]
)


def _zipped(x: np.ndarray) -> pa.Array:
    raw = x.tobytes()
    return pa.array([len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)], pa.binary())


def _unzipped(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True), kind)


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _binary(lists: Lists, which: np.ndarray) -> pa.Array:
    flat = lists.of(which).astype("<i4")
    offsets = np.concatenate([[0], np.cumsum(4 * lists.n[which])]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def _chunks(a_path: str, b_path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = aligner(a_path, b_path)
        task = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        held: list[Encoded] = []
        size = number = 0

        def chunk() -> Iterator[pa.RecordBatch]:
            rows = np.cumsum([0, *[len(e.digests) for e in held]])
            doc = np.concatenate([e.doc + r for e, r in zip(held, rows, strict=False)])
            group, times = (np.concatenate([getattr(e, c) for e in held]) for c in ("group", "times"))
            distinct, place = np.unique(group, return_inverse=True)
            blank = lambda c, n: pa.nulls(n, _TYPES[c])
            name = pa.array([task + number])
            columns = [name, _one(pa.concat_arrays(ids)), _zipped(np.concatenate([e.numbers for e in held]))]
            columns += [_one(pa.array([d for e in held for d in e.digests], pa.string()))]
            edges = np.searchsorted(doc, np.arange(rows[-1] + 1))
            columns += [_zipped(x.astype("<i4")) for x in (edges, place, times)]
            yield pa.RecordBatch.from_arrays(columns + [blank(c, 1) for c in _CHUNKS.names[7:]], names=_CHUNKS.names)
            n = len(distinct)
            keys = np.empty(len(coder.groups), np.uint64)
            keys[coder.groups.number] = coder.groups.keys
            columns = [pa.array(np.full(n, task + number)), *[blank(c, n) for c in _CHUNKS.names[1:7]]]
            columns += [pa.array(np.arange(n), pa.int32()), pa.array(keys[distinct].view(np.int64))]
            columns += [_binary(coder.a_ids, distinct), _binary(coder.b_ids, distinct)]
            columns += [pa.array(np.bincount(place, w, n).astype(np.int64)) for w in (times, None)]
            yield pa.RecordBatch.from_arrays(columns, names=_CHUNKS.names)

        for batch in batches:
            for part in slices(batch.column(1)):
                if not held and len(coder.units) > UNITS:
                    coder.clear()  # group numbers hold within a chunk
                held.append(coder.encode(part))
                ids.append(batch.column(0).slice(part.first, len(part)))
                size += len(part.data)
                if size >= CHUNK_BYTES:
                    yield from chunk()
                    ids, held, size, number = [], [], 0, number + 1
        if held:
            yield from chunk()

    return run


_TYPES = {f.name: t for f, t in zip(_CHUNKS.fields, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 3, pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)}


# ---------------------------------------------------------------- links of groups

_LINKS = T.StructType(
    [T.StructField("group_key", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("a_id", T.IntegerType()), T.StructField("b_id", T.IntegerType())]
)


def linked(a_n: np.ndarray, a_size: np.ndarray, b_n: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens of groups (end to end, a_n and b_n in each group) whose byte ranges end together."""
    ends = []
    for n, size in ((a_n, a_size), (b_n, b_size)):
        run = np.cumsum(size)
        before = np.concatenate([[0], run])[np.cumsum(n) - n]
        ends.append((np.repeat(np.arange(len(n)), n) << 40) + run - np.repeat(before, n))
    lo, hi = (np.searchsorted(ends[1], ends[0], side) for side in ("left", "right"))
    return np.repeat(np.arange(len(ends[0])), hi - lo), spans(lo, hi - lo)


def _links(a_path: str, b_path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = aligner(a_path, b_path)
        for batch in batches:
            ids, n = [], []
            for c in ("a_ids", "b_ids"):
                raw = batch[c].to_pylist()
                n.append(np.array([len(x) // 4 for x in raw], np.int64))
                ids.append(np.frombuffer(b"".join(raw), "<i4"))
            a, b = linked(n[0], coder.a.bytes.n[ids[0]], n[1], coder.b.bytes.n[ids[1]])
            group = np.repeat(np.arange(len(n[0])), n[0])[a]
            columns = [batch["group_key"].take(pa.array(group)), batch["weight"].take(pa.array(group)), pa.array(ids[0][a]), pa.array(ids[1][b])]
            yield pa.RecordBatch.from_arrays(columns, names=_LINKS.names)

    return run


_IDS = T.ArrayType(T.IntegerType())
_GROUPS = T.StructType(
    [T.StructField("group_key", T.LongType()), T.StructField("a_ids", _IDS), T.StructField("b_ids", _IDS)] + [T.StructField(c, T.LongType()) for c in ("occurrences", "documents")]
)


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids as arrays."""
    for batch in batches:
        ids = [pa.array([np.frombuffer(x, "<i4") for x in batch[c].to_pylist()], pa.list_(pa.int32())) for c in ("a_ids", "b_ids")]
        yield pa.RecordBatch.from_arrays([batch["group_key"], *ids, batch["occurrences"], batch["documents"]], names=_GROUPS.names)


_DOCUMENT = T.StructType([T.StructField(c, T.StringType() if c == "groups_sha256" else T.LongType()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])
_VALUES = ("n_links", "n_best", "count_sum")


def _summed(chunk: pa.Table, values: pa.Table) -> pa.Table:
    """The documents of a chunk with the sums of what its groups are worth."""
    docs = chunk["docs"][0].values
    numbers = _unzipped(chunk["numbers"][0].as_py(), "<i8").reshape(-1, 3)
    edges, places, times = (_unzipped(chunk[c][0].as_py(), "<i4") for c in ("edges", "places", "times"))
    doc = np.repeat(np.arange(len(docs)), np.diff(edges))
    out = [docs, *[pa.array(numbers[:, c]) for c in range(3)]]
    for c in _VALUES:
        worth = np.zeros(len(values), np.int64)
        worth[values["place"].to_numpy()] = values[c].to_numpy()
        total = np.concatenate([[0], np.cumsum(worth[places] * times)])
        out.append(pa.array(total[edges[1:]] - total[edges[:-1]]))
    return pa.Table.from_arrays([*out, chunk["digests"][0].values], names=_DOCUMENT.names)


@dataclass
class Alignment:
    """``documents``: a row for each document.  ``groups``: group_key, a_ids, b_ids (arrays), occurrences, documents.
    ``links``: a_id, b_id, count and whether it is the highest of its b_id."""

    documents: DataFrame
    groups: DataFrame
    links: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", weight: str = "occurrences") -> Alignment:
    """Align all documents.  With ``weight="documents"`` a pair's count sums the numbers of documents that have each of its groups."""
    if weight not in ("occurrences", "documents"):
        raise ValueError("weight is occurrences or documents")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = checkpoint(rows.mapInArrow(_chunks(a_path, b_path), _CHUNKS))
    chunks = encoded.where("place is null").select(*_CHUNKS.names[:7])
    entries = encoded.where("place is not null").select("chunk", *_CHUNKS.names[7:])
    groups = checkpoint(
        entries.groupBy("group_key").agg(*[F.first(c).alias(c) for c in ("a_ids", "b_ids")], *[F.sum(c).alias(c) for c in ("occurrences", "documents")])
    )
    links = groups.select("group_key", F.col(weight).alias("weight"), "a_ids", "b_ids").mapInArrow(_links(a_path, b_path), _LINKS)
    pairs = links.groupBy("a_id", "b_id").agg(F.sum("weight").alias("count"))
    # a row for each B id at most, so it is no larger than B's vocabulary
    highest = pairs.groupBy("b_id").agg(F.max("count").alias("highest"))
    pairs = checkpoint(pairs.join(F.broadcast(highest), "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("highest")).alias("best")))
    worth = links.join(pairs, ["a_id", "b_id"]).groupBy("group_key")
    worth = worth.agg(F.count("*").alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    values = entries.select("chunk", "place", "group_key").join(worth, "group_key").select(F.col("chunk").alias("of"), "place", *_VALUES)
    done = chunks.groupBy("chunk").cogroup(values.groupBy("of")).applyInArrow(_summed, _DOCUMENT)
    return Alignment(done, groups.mapInArrow(_listed, _GROUPS), pairs)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), *default_tokenizers()).documents
