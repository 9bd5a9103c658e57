"""N-gram Jaccard self join: a size-aware heavy-light join on word shingles.

Documents whose sets of distinct word shingles have a Jaccard similarity of at
least 3/4 link; the result is the component of every document.  Equal sets are
one set from the start, so copies never multiply.

* Light sets, smaller than a boundary, are joined by enumerating fixed-size
  subsets: sets of sizes n and m are similar exactly if they share a subset of
  ceil(3 (n + m) / 7) shingles, so those subsets are join keys.
* Heavy sets scan inverted lists of a prefix of each set in a global order that
  puts frequent shingles last: two similar sets share a shingle of their
  prefixes.
* The boundary is the smallest size at which subsets cost more than lists, with
  costs from counts over the whole corpus.

A list of k sets isn't expanded to its pairs.  First every member is paired with
the list's smallest; verified links give components.  Then only pairs of
different components within a list remain; those whose parity sketches (exact
lower bounds of the symmetric difference) allow similarity are verified too:
members outside the list's largest component probe it, in blocks, so a list of
any length is spread over tasks.  No pair in a list is lost: it is within one
component, or pruned by an exact bound, or verified.

Keys of lists are whole 64-bit hashes, which are taken for equality: a list of
subsets is only joined to its smallest sets, so an unrelated one in it would
cost links.

Defined results: null and empty texts have the empty set and link with nothing.
Rows that repeat give a row each.  A document without an id is linked like any
other; its component is the least id in it, or null.  Only id, text and columns to carry are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm.common import BATCH_ROWS, checkpoint, documents, partitions, release
from sparkloom.llm.components import components
from sparkloom.llm.textops import mix, shingle_sets, slices

WIDTH = 5
#: Largest size that subsets are ever enumerated for.
MOST_LIGHT = 14
#: Shingles counted in a task before it reports the frequent ones; reports below the least count are dropped.
CHUNK_TOKENS = 2 << 20
REPORT_LEAST = 4
#: The order puts this many of the most frequent shingles last; it is a matter of cost, not of results.
HOT_TOKENS = 1 << 16
#: Bits of a sketch: four for each shingle, within these bounds; a small sketch has one for each.
LEAST_BITS, MOST_BITS = 64, 1 << 20
#: Members of a list that one task compares with as many others.
BLOCK = 1024
PROBE, MEMBER = 1, 2
#: Words of sketches compared at once.
CELLS = 1 << 20
#: Most bits of the filter of documents whose shingles are needed (32 MB); it has 64 for each set below that.
MOST_FILTER_BITS = 1 << 28
#: Bytes of shingles that one cell of the verification holds, about.
CELL_BYTES = 64 << 20
#: Bytes of entries of one bucket of lists, about.
BUCKET_BYTES = 16 << 20
#: Groups of copies whose component is sent to all tasks; of the rest none holds more than one part in as many.
HEAVY_KEYS = 1024


def overlap_needed(n, m):
    """Least intersection of similar sets of these sizes: |a & b| >= 3/4 |a | b|."""
    return -(-3 * (n + m) // 7)


def prefix_length(n: int) -> int:
    return n - (-(-3 * n // 4)) + 1


def partner_sizes(n: int) -> range:
    return range(-(-3 * n // 4), 4 * n // 3 + 1)


def _sets(batch: pa.RecordBatch, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of rows whose second column is the text."""
    for part in slices(batch.column(1)):
        hashes, first, counts = shingle_sets(part, width)
        for i in range(len(part)):
            yield part.first + i, np.unique(hashes[first[i] : first[i] + counts[i]])


def set_key(tokens: np.ndarray) -> int:
    """Identity of a set: a 64-bit hash, as a signed number."""
    total = mix(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens) * 0x9E3779B97F4A7C15 % (1 << 64))
    return int(mix(total).view(np.int64)[0])


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of 2**k classes."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 4 * len(tokens)):
        bits *= 2
    odd = np.bincount((mix(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def small_sketch(full: bytes, n: int) -> bytes:
    bits = LEAST_BITS
    while bits < n:
        bits *= 2
    return fold(np.frombuffer(full, np.uint64)[None], bits // 64).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of uint64) cut to ``size`` words: parities of halves add up."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


# ---------------------------------------------------------------- pass 1: sets and frequent shingles

#: Columns of pass 1 behind the id and what is carried along with it.
_SCAN = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("sketch", T.BinaryType()),
        T.StructField("small", T.BinaryType()),
        T.StructField("signature", T.BinaryType()),
        T.StructField("token", T.LongType()),
        T.StructField("count", T.LongType()),
    ]
)


def _scan(fields: T.StructType, first: int, width: int, sketch: Callable[[np.ndarray], tuple[np.ndarray, dict[str, bytes]]]):
    """Rows (id, what is carried, set) of documents (id, text, what is carried), and reports of frequent tokens; ``first`` is the number of columns before the set's."""
    schema = to_arrow_schema(fields)
    columns = schema.names[first:]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def out(known: list[pa.Array], values: dict[str, list | np.ndarray], n: int) -> pa.RecordBatch:
            """A batch of the columns known and given; the others are null."""
            arrays = known or [pa.nulls(n, t) for t in schema.types[:first]]
            arrays = [x.cast(t) for x, t in zip(arrays, schema.types[:first], strict=True)]
            arrays += [pa.array(values[c], t) if c in values else pa.nulls(n, t) for c, t in zip(columns, schema.types[first:], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        def report() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= REPORT_LEAST
            return out([], {"token": tokens[keep].view(np.int64), "count": counts[keep]}, int(keep.sum()))

        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(lo, BATCH_ROWS)
                values: dict[str, list] = {c: [] for c in columns if c not in ("token", "count")}
                for _, shingles in _sets(rows, width):
                    key, tokens, made = None, shingles, {}
                    if len(shingles):
                        key = set_key(shingles)
                        tokens, made = sketch(shingles)
                    for c, v in ({"n": len(shingles), "key": key} | {c: made.get(c) for c in values if c not in ("n", "key")}).items():
                        values[c].append(v)
                    if key is not None and key not in seen:
                        seen.add(key)
                        held.append(tokens)
                        size += len(tokens)
                yield out([rows.column(0), *rows.columns[2:]], values, rows.num_rows)
                if size >= CHUNK_TOKENS:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    return run


# ---------------------------------------------------------------- pass 2: keys of lists


@lru_cache(maxsize=None)
def _subsets(n: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)


def subset_cost(n: int) -> int:
    return sum(comb(n, overlap_needed(n, m)) for m in partner_sizes(n) if m)


class Order:
    """The global order of shingles: by hash, frequent ones after all others by count."""

    def __init__(self, hot: np.ndarray, counts: np.ndarray):
        rank = np.lexsort((hot, counts))
        by_hash = np.argsort(hot)
        self.hot = hot[by_hash]
        place = np.empty(len(hot), np.int64)
        place[rank] = np.arange(len(hot))
        self.rank = place[by_hash]

    def prefix(self, tokens: np.ndarray, need: int) -> np.ndarray:
        if not len(self.hot):
            return tokens[:need]
        at = np.searchsorted(self.hot, tokens)
        at[at == len(self.hot)] = 0
        hot = self.hot[at] == tokens
        plain = tokens[~hot]
        if len(plain) >= need:
            return plain[:need]
        late = tokens[hot][np.argsort(self.rank[at[hot]])]
        return np.concatenate([plain, late])[:need]


_ENTRIES = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("entries", T.BinaryType())])
_ENTRY = np.dtype([("token", "<u8"), ("key", "<i8"), ("side", "u1")])


def list_keys(tokens: np.ndarray, order: Order, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all lists that a set belongs to, and its side in each (2 for inverted lists)."""
    n = len(tokens)
    keys, sides = [], []
    if n < boundary:
        mixed = mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
        for m in partner_sizes(n):
            if not 0 < m < boundary:
                continue
            chosen = mixed[_subsets(n, overlap_needed(n, m))].sum(axis=1, dtype=np.uint64)
            keys.append(mix(chosen + np.uint64(min(n, m) * 1000003 + max(n, m) * 7919)))
            sides.append(np.full(len(chosen), int(n > m), np.uint8))
    if n >= boundary or 4 * n >= 3 * boundary:
        prefix = order.prefix(tokens, prefix_length(n))
        keys.append(mix(prefix))
        sides.append(np.full(len(prefix), 2, np.uint8))
    return np.concatenate(keys), np.concatenate(sides)


def blobs(tokens: np.ndarray, keys: np.ndarray, sides: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries of lists (token, set, side) by bucket of the token."""
    entry = np.empty(len(tokens), _ENTRY)
    entry["token"], entry["key"], entry["side"] = tokens, keys, sides
    bucket = ((tokens & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
    there = np.flatnonzero(np.diff(edges))
    packed = [_pack(entry[by[edges[b] : edges[b + 1]]]) for b in there]
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(packed, pa.binary())], names=_ENTRIES.names)


def _index(shared, boundary: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*shared.value)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, sides = (np.concatenate([h[c] for h in held]) for c in (0, 2))
            return blobs(keys, np.repeat(np.array([h[1] for h in held], np.int64), [len(h[0]) for h in held]), sides, buckets)

        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                for _, tokens in _sets(batch.slice(lo, BATCH_ROWS)):
                    if not len(tokens):
                        continue
                    key = set_key(tokens)
                    if key in seen:
                        continue
                    seen.add(key)
                    keys, sides = list_keys(tokens, order, boundary)
                    held.append((keys, key, sides))
                    size += len(keys)
                if size >= CHUNK_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _pack(entry: np.ndarray) -> bytes:
    """Column after column, sorted by token: close to incompressible parts stay apart from the rest."""
    entry = entry[np.argsort(entry["token"], kind="stable")]
    return b"".join(np.ascontiguousarray(entry[c]).tobytes() for c in ("token", "key", "side"))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // _ENTRY.itemsize
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "u1", n, 16 * n)


# ---------------------------------------------------------------- lists: star pairs, and what is left to compare

_LISTS = T.StructType([T.StructField("list", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of one bucket after the other."""
    last, held = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            bucket = batch.column(0)[k].as_py()
            if held and bucket != last:
                yield held
                held = []
            last = bucket
            held.append(batch.column(1)[k].as_py())
    if held:
        yield held


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star pairs (list null) and the members (b null) of lists of three or more sets; rows come sorted by bucket."""
    for held in _by_bucket(batches):
        token, key, side = (np.concatenate(x) for x in zip(*map(_unpack, held), strict=True))
        order = np.lexsort((key, token))
        token, key, side = token[order], key[order], side[order]
        again = np.zeros(len(token), bool)
        again[1:] = (token[1:] == token[:-1]) & (key[1:] == key[:-1])
        token, key, side = token[~again], key[~again], side[~again]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(first, len(token)))
        shared = np.repeat(count >= 2, count)
        token, key, side = token[shared], key[shared], side[shared]
        if not len(token):
            continue
        count = count[count >= 2]
        first = np.cumsum(count) - count
        center = np.repeat(key[first], count)
        # lists of subsets: the sizes on either side meet each other, so the other side's smallest is a second centre
        pairs = [np.stack([center, key], 1)]
        light = side < 2
        if light.any():
            group = np.repeat(np.arange(len(first)), count)
            for s in (0, 1):
                own = np.flatnonzero(side == s)
                heads, where = np.unique(group[own], return_index=True)
                lead = np.zeros(len(first), np.int64)
                has = np.zeros(len(first), bool)
                lead[heads], has[heads] = key[own[where]], True
                other = np.flatnonzero((side == 1 - s) & has[group])
                pairs.append(np.stack([lead[group[other]], key[other]], 1))
        both = np.concatenate(pairs)
        both = both[both[:, 0] != both[:, 1]]
        both = np.unique(np.sort(both, axis=1), axis=0)
        none = pa.nulls(len(both), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(both[:, 0]), pa.array(both[:, 1])], names=_LISTS.names)
        # inverted lists of three or more, one of several with the same members
        heavy = np.repeat((count >= 3) & (np.maximum.reduceat(side, first) == 2), count)
        if not heavy.any():
            continue
        big = np.flatnonzero((count >= 3) & (np.maximum.reduceat(side, first) == 2))
        digest = np.add.reduceat(mix(key.view(np.uint64)), first)[big]
        _, one = np.unique(digest, return_index=True)
        keep = big[one]
        rows = np.concatenate([np.arange(first[k], first[k] + count[k]) for k in keep])
        name = np.repeat(digest[one].view(np.int64), count[keep])
        yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(key[rows]), pa.nulls(len(rows), pa.int64())], names=_LISTS.names)


@dataclass(frozen=True)
class Similarity:
    """When sets are similar, and by what their sketches tell that they aren't.

    A sketch is a parity sketch behind ``head`` bytes, of which ``alike`` says
    which rows of a matrix (many, one or row by row) can belong to similar sets.
    """

    percent: int = 75
    head: int = 0
    alike: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def needed(self, n, m):
        """Least intersection of similar sets of these sizes."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def sizes_allow(self, n, m):
        return 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)

    def heads(self, raw: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join([x[: self.head] for x in raw]), np.uint8).reshape(len(raw), self.head)

    def plausible(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that their sizes and sketches allow to be similar; columns a, b, na, nb, sa, sb."""
        for batch in batches:
            na, nb = (batch[c].to_numpy() for c in ("na", "nb"))
            limit = na + nb - 2 * self.needed(na, nb)
            at = np.flatnonzero(self.sizes_allow(na, nb))
            sa, sb = batch["sa"].to_pylist(), batch["sb"].to_pylist()
            if self.alike:
                at = at[self.alike(self.heads([sa[i] for i in at]), self.heads([sb[i] for i in at]))]
            keep = np.zeros(len(na), bool)
            for i in at.tolist():
                x, y = (np.frombuffer(s[i], np.uint64, offset=self.head)[None] for s in (sa, sb))
                size = min(x.shape[1], y.shape[1])
                keep[i] = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= limit[i]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def cross(self, best: bool):
        """Plausible pairs of different components between a block of probes of a list and a block of its members.

        A pair of probes is met twice and kept where the smaller one probes.  The
        distance of a pair is by how much its sketches differ beyond what they may.
        """

        def run(rows: pa.Table) -> pa.Table:
            key, comp, n, role, other = (rows[c].to_numpy() for c in ("key", "component", "n", "role", "other"))
            raw = rows["sketch"].to_pylist()
            words = np.array([(len(s) - self.head) // 8 for s in raw])
            heads = self.heads(raw) if self.alike else None
            probes, members = np.flatnonzero(role & PROBE), np.flatnonzero(role & MEMBER)
            found = [np.empty((0, 3), np.int64)]
            for size in np.unique(words[probes]):
                own = probes[words[probes] == size]
                for wide in (size // 2, size, 2 * size):
                    near = members[words[members] == wide]
                    if not wide or not len(near):
                        continue
                    least = min(size, wide)
                    bits = fold(np.frombuffer(b"".join([raw[k][self.head :] for k in near]), np.uint64).reshape(-1, wide), least)
                    for k in own.tolist():
                        ok = (comp[near] != comp[k]) & (~other[near] | (key[near] > key[k])) & self.sizes_allow(n[near], n[k])
                        at = np.flatnonzero(ok)
                        if self.alike:
                            at = at[self.alike(heads[near[at]], heads[k])]
                        mine = fold(np.frombuffer(raw[k], np.uint64, offset=self.head)[None], least)
                        for lo in range(0, len(at), CELLS // least + 1):
                            some = at[lo : lo + CELLS // least + 1]
                            differ = np.bitwise_count(bits[some] ^ mine).sum(axis=1, dtype=np.int64)
                            some = near[some]
                            margin = differ - (n[some] + n[k] - 2 * self.needed(n[some], n[k]))
                            hit = margin <= 0
                            found.append(np.stack([np.full(hit.sum(), k), some[hit], margin[hit]], 1))
            return chosen(np.concatenate(found), rows, best)

        return run


def _similar(needed: Callable[[int, int], int]):
    """The pairs of a cell whose sets have the intersection that their sizes need."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        tokens = dict(zip(sets["key"].to_pylist(), sets["tokens"].to_pylist(), strict=True))
        keep = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            x, y = np.frombuffer(tokens[a], np.uint64), np.frombuffer(tokens[b], np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            keep.append(int((both[1:] == both[:-1]).sum()) >= needed(len(x), len(y)))
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


_CROSS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _joining(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first pairs of components that join ones not joined before."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    keep = []
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            keep.append(k)
    return np.array(keep, np.int64)


_FOUND = T.StructType([T.StructField("list", T.LongType()), *_CROSS.fields])


def chosen(pairs: np.ndarray, rows: pa.Table, best: bool) -> pa.Table:
    """Pairs (probe, member, distance) of a block as rows of ``_FOUND``.

    With ``best`` only each probe's nearest one for each component, of those the
    ones that join components not joined before, and the keys of the others in
    rows of their own under the list's name.
    """
    key, comp = rows["key"].to_numpy(), rows["component"].to_numpy()
    left = np.empty(0, np.int64)
    if best and len(pairs):
        order = np.lexsort((key[pairs[:, 1]], pairs[:, 2], comp[pairs[:, 1]], pairs[:, 0]))
        pairs = pairs[order]
        head = np.ones(len(pairs), bool)
        head[1:] = (pairs[1:, 0] != pairs[:-1, 0]) | (comp[pairs[1:, 1]] != comp[pairs[:-1, 1]])
        heads = np.flatnonzero(head)
        heads = heads[np.argsort(pairs[heads, 2], kind="stable")]
        taken = heads[_joining(comp[pairs[heads, 0]], comp[pairs[heads, 1]])]
        left = np.unique(key[np.delete(pairs, taken, axis=0)[:, :2]])
        pairs = pairs[taken]
    x, y = key[pairs[:, 0]], key[pairs[:, 1]]
    out = pa.table({"list": pa.nulls(len(x), pa.int64()), "a": np.minimum(x, y), "b": np.maximum(x, y)})
    name = np.full(len(left), rows["list"][0].as_py())
    return pa.concat_tables([out, pa.table({"list": pa.array(name, pa.int64()), "a": left, "b": pa.nulls(len(left), pa.int64())})])


# ---------------------------------------------------------------- the join


class SetJoin:
    """What joins of shingle sets share: sets and frequent tokens, verification, components, and what is left to compare in lists.

    A subclass says what a set is compared by before it is read again whole:
    ``sketch`` gives its binary columns ``sketches``, of which ``small`` is compared
    first and ``sketch`` last, and ``entries`` the lists that each set belongs to.
    """

    width = WIDTH
    similarity = Similarity()
    sketches = ("small", "sketch")

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str]):
        self.spark = docs.sparkSession
        self.rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        if {c.lower() for c in carry} & {"doc_id", "n_shingles", "component_id", "group"}:
            raise ValueError("a column to carry has the name of a column of the result")
        # under names of their own until the end
        self.carry = {f"carried_{k}": c for k, c in enumerate(carry)}
        scan = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`").alias(k) for k, c in self.carry.items()])
        fields = [T.StructField("doc_id", T.LongType()), *[T.StructField(k, scan.schema[k].dataType) for k in self.carry]]
        fields = T.StructType(fields + [f for f in _SCAN.fields if f.dataType != T.BinaryType() or f.name in self.sketches])
        scanned = checkpoint(scan.mapInArrow(_scan(fields, len(self.carry) + 1, self.width, self.sketch), fields))
        self.members = scanned.where("token is null").select("doc_id", *self.carry, "n", "key", *self.sketches)
        self.tokens = scanned.where("token is not null").select("token", "count")
        self.sets = checkpoint(
            self.members.where("key is not null")
            .groupBy("key")
            .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", *self.sketches)])
        )

    @staticmethod
    def sketch(tokens: np.ndarray) -> tuple[np.ndarray, dict[str, bytes]]:
        """The tokens of a set to count, and its sketches by column."""
        raise NotImplementedError

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent tokens and their counts (HOT_TOKENS pairs of numbers at most)."""
        hot = self.tokens.groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(HOT_TOKENS).toArrow()
        self.shingles, self.n_sets = self.sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.filter_bits = min(MOST_FILTER_BITS, 1 << max(16, (64 * self.n_sets).bit_length()))
        return hot["token"].to_numpy().view(np.uint64), hot["count"].to_numpy()

    def entries(self, buckets: Callable[[int], int]) -> DataFrame:
        """Entries of lists in blobs by bucket; ``buckets`` gives their number from that of entries."""
        raise NotImplementedError

    def plausible(self, pairs: DataFrame) -> DataFrame:
        for k in ("a", "b"):
            pairs = pairs.join(self.sets.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("small").alias(f"s{k}")), k)
        return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(self.similarity.plausible, _CROSS)

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of checkpointed pairs."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        wanted = checkpoint(self.sets.select("key", "rep", "n").join(ends, "key", "left_semi"))
        size = self.filter_bits
        spot = F.pmod(F.xxhash64("rep"), F.lit(size))
        word = wanted.groupBy(F.floor(spot / 64).cast("int").alias("word"))
        bits = word.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rep), {size}) % 64 as int))")).alias("bits"), F.sum("n").alias("n"))
        got = bits.toArrow()  # MOST_FILTER_BITS bits at most: documents outside are surely not needed
        mask = np.zeros(size // 64, np.int64)
        mask[got["word"].to_numpy()] = got["bits"].to_numpy()
        shared = self.spark.sparkContext.broadcast(mask)
        schema = T.StructType(
            [T.StructField("key", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("tokens", T.BinaryType())]
        )
        width = self.width
        rows = self.rows.withColumn("spot", F.pmod(F.xxhash64("doc_id"), F.lit(size)))

        def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                spots = batch["spot"].to_numpy()
                hit = shared.value[spots >> 6] >> (spots & 63) & 1
                batch = batch.filter(pa.array(hit == 1))
                for lo in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(lo, BATCH_ROWS)
                    ids = part["doc_id"].to_pylist()
                    keys, reps, blobs = [], [], []
                    for i, tokens in _sets(part, width):
                        if len(tokens) and (key := (set_key(tokens), ids[i])) not in seen:
                            seen.add(key)
                            keys.append(key[0])
                            reps.append(ids[i])
                            blobs.append(tokens.tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(reps, pa.int64()), pa.array(blobs, pa.binary())], names=schema.names
                    )

        # pairs lie in the cells of a grid of blocks of sets, and each set goes once to every cell that needs it
        shingles = sum(got["n"].to_pylist())
        side = max(1, isqrt(2 * partitions(self.spark)), -(-2 * 8 * shingles // CELL_BYTES))
        block = {c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int") for c in ("a", "b")}
        cells = pairs.select("a", "b", F.least(*block.values()).alias("i"), F.greatest(*block.values()).alias("j"))
        needed = cells.select(F.explode(F.array("a", "b")).alias("key"), F.col("i").alias("p"), F.col("j").alias("q")).distinct()
        needed = needed.join(wanted.select("key", "rep"), "key")
        found = rows.mapInArrow(some, schema).withColumnRenamed("key", "own")
        # a set all of whose documents lack an id has none as its representative
        placed = found.join(needed, (F.col("own") == F.col("key")) & found["rep"].eqNullSafe(needed["rep"])).select("p", "q", "key", "tokens")
        release(self.spark)
        links = checkpoint(cells.groupBy("i", "j").cogroup(placed.groupBy("p", "q")).applyInArrow(_similar(self.similarity.needed), _CROSS))
        shared.unpersist()
        return links

    def grouped(self, links: DataFrame) -> DataFrame:
        groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        release(self.spark)
        return groups

    def open_pairs(self, member: DataFrame, groups: DataFrame, sketch: str, best: bool) -> DataFrame:
        """Plausible pairs of different components in lists (list, key)."""
        placed = member.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn(
            "component", F.coalesce("component", "key")
        )
        placed = checkpoint(placed)
        # two members of different components aren't both in the list's largest one, so those outside it probe the list
        parts = placed.groupBy("list", "component").agg(F.count("*").alias("size"))
        lists = parts.groupBy("list").agg(
            F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("size"), F.max("size").alias("most")
        ).where("size > most")
        blocks = {"wide": "size", "high": "size - most"}
        lists = lists.select("list", "main", *[F.ceil(F.expr(x) / BLOCK).cast("int").alias(c) for c, x in blocks.items()])
        left = placed.join(lists, "list").join(self.sets.select("key", "n", F.col(sketch).alias("sketch")), "key")
        left = left.withColumn("other", F.col("component") != F.col("main"))
        at = {c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int") for c in blocks}
        every = {c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in blocks}
        columns = ["list", "key", "component", "n", "sketch", "other"]
        # in a list of one block a row plays both parts
        one = (F.col("wide") == 1) & F.col("other")
        role = F.when(one, PROBE | MEMBER).otherwise(MEMBER).alias("role")
        members = left.select(*columns, role, at["wide"].alias("i"), every["high"].alias("j"))
        probes = left.where(F.col("other") & (F.col("wide") > 1))
        probes = probes.select(*columns, F.lit(PROBE).alias("role"), every["wide"].alias("i"), at["high"].alias("j"))
        return members.unionByName(probes).groupBy("list", "i", "j").applyInArrow(self.similarity.cross(best), _FOUND)

    def run(self) -> DataFrame:
        n = partitions(self.spark)
        entries = self.entries(lambda size: max(4 * n, -(-size * _ENTRY.itemsize // BUCKET_BYTES)))
        lists = checkpoint(entries.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_lists, _LISTS))
        release(self.spark)
        stars = checkpoint(self.plausible(lists.where("list is null").select("a", "b").distinct()))
        links = self.verify(stars)
        groups = self.grouped(links)

        # first the likeliest pairs, by small sketches, as most links that they give join the components of others
        member = lists.where("list is not null").select("list", F.col("a").alias("key")).distinct()
        found = checkpoint(self.open_pairs(member, groups, "small", best=True))
        likely = checkpoint(found.where("list is null").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti"))
        links = checkpoint(links.unionByName(self.verify(likely)))
        groups = self.grouped(links)
        # then all that are left
        member = found.where("list is not null").select("list", F.col("a").alias("key")).distinct()
        found = self.open_pairs(member, groups, "sketch", best=False).select("a", "b").distinct()
        rest = checkpoint(found.join(stars.unionByName(likely), ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            groups = self.grouped(links.unionByName(self.verify(rest)))

        placed = checkpoint(self.sets.select("key", "rep", "copies").join(groups.withColumnRenamed("node", "key"), "key", "left"))
        linked = placed.where("component is not null")
        least = checkpoint(linked.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")))
        named = looked_up(linked, least, "component", "size").select("key", "component", "component_id", "copies")
        alone = placed.where("component is null").select("key", F.col("key").alias("component"), F.col("rep").alias("component_id"), "copies")
        named = checkpoint(named.unionByName(alone))
        rows = self.members.drop(*self.sketches)
        blank = rows.where("key is null").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
        full = looked_up(rows.where("key is not null"), named, "key", "copies")
        return full.select(blank.columns).unionByName(blank).select(
            "doc_id", *[F.col(k).alias(c) for k, c in self.carry.items()], F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("component").alias("group")
        )


class _HeavyLight(SetJoin):
    """Subsets for light sets, inverted lists of prefixes for heavy ones; parity sketches before whole sets."""

    @staticmethod
    def sketch(tokens: np.ndarray) -> tuple[np.ndarray, dict[str, bytes]]:
        full = sketch(tokens)
        return tokens, {"sketch": full, "small": small_sketch(full, len(tokens))}

    def entries(self, buckets: Callable[[int], int]) -> DataFrame:
        tokens, counts = self.frequent()
        length = 1 + float((counts.astype(float) ** 2).sum()) / max(1, self.shingles)
        boundary = next((n for n in range(1, MOST_LIGHT) if subset_cost(n) > prefix_length(n) * length), MOST_LIGHT)
        order = self.spark.sparkContext.broadcast((tokens, counts))  # HOT_TOKENS pairs of numbers
        # a prefix is about a quarter of a set
        return self.rows.mapInArrow(_index(order, boundary, buckets(self.shingles // 4)), _ENTRIES)


def looked_up(rows: DataFrame, values: DataFrame, key: str, weight: str) -> DataFrame:
    """Rows with the columns of ``values``, which has each key once and the number of its rows as ``weight``.

    The keys of most rows go to all tasks, so that their rows stay where they are.
    """
    heavy = values.orderBy(F.desc(weight), key).limit(HEAVY_KEYS)
    there = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(values, key)
    return there.unionByName(rest)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to carry, n_shingles and component_id of each row; the id is taken as a long.

    ``group`` names the component also where no document in it has an id; it is
    null for a document without words.
    """
    return _HeavyLight(docs, id_col, text_col, carry).run()


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).drop("group")
