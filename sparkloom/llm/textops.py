"""Vectorised word, line and shingle arithmetic over Arrow batches of text.

Everything here works on the UTF-8 bytes of many documents at once: the value
buffer of an Arrow string column is viewed as one ``uint8`` array and words,
hashes and shingles of all its documents come out of a few numpy passes.  The
separators of a word (``[\\x20\\x09-\\x0D]``) are single bytes, so byte and code
point views agree on where a word begins and ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_WEIGHT = np.random.RandomState(20240229).randint(1, 1 << 62, 256).astype(_U)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i mod 2**64`` for i < n, kept for the usual slice length."""
    size = SLICE_BYTES * 2
    while size < n:
        size *= 2
    table = _powers(base, size) if size == SLICE_BYTES * 2 else _powers.__wrapped__(base, size)
    return table[:n]


class PrefixHash:
    """Position-independent 64-bit hash of any run of an array of bytes, or of 64-bit hashes (of words, say)."""

    def __init__(self, data: np.ndarray):
        self.prefix = np.empty(len(data) + 1, _U)
        self.prefix[0] = 0
        weight = _BYTE_WEIGHT[data] if data.dtype == np.uint8 else data
        np.cumsum(weight * powers(_BASE, len(data) + 1)[:-1], out=self.prefix[1:])
        self.inverse = powers(_BASE_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def rolling(self, width: int) -> np.ndarray:
        """``of`` for the ``width`` bytes from every position."""
        n = len(self.prefix) - width
        if n <= 0:
            return np.empty(0, _U)
        raw = self.prefix[width:] - self.prefix[:n]
        raw *= self.inverse[:n]
        raw += _U(width * 0xD6E8FEB86659FD93 % (1 << 64))
        return mix(raw)


class Slice:
    """Some consecutive rows of a batch: ``data`` holds their bytes end to end."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8")

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, data: np.ndarray | None = None, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each document its first word (n + 1 entries)."""
        data = self.data if data is None else data
        n = len(data)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(self) + 1, np.int64)
        inside = ~separator[data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        finishes = inside
        finishes = finishes.copy()
        finishes[:-1] &= ~inside[1:] | edge[1:-1]
        starts = np.flatnonzero(begins)
        ends = np.flatnonzero(finishes) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string or binary column into runs of rows of about max_bytes (a longer row is its own run).

    Null values count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def shingle_sets(part: Slice, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word shingles of a slice, and where each document's begin.

    A document of fewer than ``width`` words has its whole word sequence as one
    shingle, one without words has none.  Returns (hashes, first, counts) with
    repeats still present: document i owns hashes[first[i] : first[i] + counts[i]].
    """
    data = LOWER_ASCII[part.data]
    starts, ends, first = part.words(data)
    n_words = np.diff(first)
    if not len(starts):
        return np.empty(0, _U), first[:-1], n_words
    hashed = PrefixHash(data).of(starts, ends)
    padded = np.concatenate([hashed, np.zeros(width - 1, _U)])
    total = np.zeros(len(hashed), _U)
    # no factor may be a plain function of its place: with a progression "a b b a" and "b a a b" would be the same
    factor = mix((np.arange(width) + 1).astype(_U) * _U(0xA24BAED4963EE407)) | _U(1)
    for k in range(width):
        total += padded[k : k + len(hashed)] * factor[k]
    for i in np.flatnonzero((n_words > 0) & (n_words < width)):
        lo, hi = first[i], first[i + 1]
        seed = np.array([hi - lo]).astype(_U)
        for k in range(lo, hi):
            seed = mix(seed * _U(0xC2B2AE3D27D4EB4F) + hashed[k : k + 1])
        total[lo] = seed[0]
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    return mix(total), first[:-1], counts
