"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are powers of two: as
many of the sequence length as fit, then the binary digits of the rest, largest
first.  Every piece is a sequence of its own, so no sequence crosses documents
and none has padding; pieces of equal length share a bucket, and sequences are
numbered bucket after bucket within a partition.

Tokens come from a public tokenizer file whose path is a parameter.  Its model
splits text at white space first, so ids of what stands between two of the ASCII
separators do not depend on its neighbours: a worker keeps the ids of such words
that it has met (at most ``CACHE_WORDS``, in a few flat arrays, found by 64-bit
hashes, which are taken for equality), encodes only new ones, and puts the ids of
a whole slice of documents together at once.

Defined results: a null text is an empty one; an empty text is one piece holding
the end id.  Repeated rows are packed once for each row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import BATCH_ROWS, checkpoint, documents
from sparkloom.llm.textops import PrefixHash, Slice, slices

SEQUENCE = 4096
END_ID = 2
CACHE_WORDS = 1_000_000
#: Words to encode with one call.
CALL_WORDS = 2_000

MARKS = ".,;:!?"
#: Below it are the letters that all versions of Unicode in use agree on (Latin, Greek, Cyrillic).
SETTLED = "\u0530"

#: The model's own word rule, on lower-case ASCII.
_ASCII_UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin[0], begin[0] + 1, ... (n[0] of them), begin[1], ..."""
    run = np.cumsum(n, dtype=np.int64)
    return np.repeat(begin - (run - n), n) + np.arange(run[-1] if len(run) else 0)


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        #: Hashes of the words met, sorted; where the ids of each begin in the pool, and how many there are.
        self.known = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.n = np.empty(0, np.int32)
        self.pool = np.empty(0, "<u4")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _ids_of_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings that the model takes as one word each, end to end, and how many each has; a word's last token says that it is the last."""
        flat, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for lo in range(0, len(units), CALL_WORDS):
            some = units[lo : lo + CALL_WORDS]
            ids = self._ids(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                flat.append(ids)
                counts.append(np.diff(cuts, prepend=0))
            else:
                each = [self._ids(u) for u in some]
                flat += each
                counts.append(np.array([len(x) for x in each]))
        return np.concatenate(flat), np.concatenate(counts)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end and how many each has, by way of the units that the model cuts a word into where that is certain.

        The model composes and lower-cases a word before it cuts it, which can make
        a letter into a letter and a mark; so it is the changed word that is judged.
        """
        number: dict[str, int] = {}
        place = number.setdefault
        parts: list[int] = []  # units of all words
        n_parts, other = [], []
        for k, w in enumerate(words):
            before = len(parts)
            x = w if w.isascii() else normalize("NFC", w).lower()
            if x.isalpha():
                parts.append(place(w, len(number)))
            elif x[:-1].isalpha() and w[-1] in MARKS and max(x) < SETTLED:
                parts.append(place(w[:-1], len(number)))
                parts.append(place(w[-1], len(number)))
            elif w.isascii() and "<|" not in w and w.isprintable():
                parts += [place(u, len(number)) for u in _ASCII_UNITS.findall(w.lower())]
            else:
                other.append(k)
            n_parts.append(len(parts) - before)
        flat, counts = self._ids_of_units(list(number))
        part = np.array(parts, np.int64)
        ids = flat[spans((np.cumsum(counts) - counts)[part], counts[part])]
        run = np.concatenate([[0], np.cumsum(counts[part])])
        n = np.diff(run[np.concatenate([[0], np.cumsum(n_parts)])])
        if other:
            whole = [np.array(x.ids, "<u4") for x in self.model.encode_batch_fast([words[k] for k in other], add_special_tokens=False)]
            ids = np.insert(ids, np.repeat((np.cumsum(n) - n)[other], [len(x) for x in whole]), np.concatenate(whole))
            n[other] = [len(x) for x in whole]
        return ids, n

    def _learn(self, part: Slice, key: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = part.data.tobytes()
        ids, n = self._encoded([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        key = np.concatenate([self.known, key])
        order = np.argsort(key, kind="stable")  # two sorted runs
        self.known = key[order]
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(n) - n])[order]
        self.n = np.concatenate([self.n, n.astype(np.int32)])[order]
        self.pool = np.concatenate([self.pool, ids])

    def encode(self, part: Slice, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's documents end to end, each followed by the end id, and where each document begins (n + 1)."""
        starts, ends, first = part.words()
        if not len(starts):
            return np.full(len(part), end, "<u4"), np.arange(len(part) + 1)
        key, head, which = np.unique(PrefixHash(part.data).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.clear()
        new = np.ones(len(key), bool)
        if len(self.known):
            place = np.searchsorted(self.known, key)
            place[place == len(self.known)] = 0
            new = self.known[place] != key
        if new.any():
            self._learn(part, key[new], starts[head[new]], ends[head[new]])
            place = np.searchsorted(self.known, key)
        begin, n = self.at[place][which], self.n[place][which]
        run = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        edges = run[first] + np.arange(len(part) + 1)  # an end id more for each document before
        doc = np.repeat(np.arange(len(part)), np.diff(run[first]))
        out = np.full(edges[-1], end, "<u4")
        out[np.arange(run[-1]) + doc] = self.pool[spans(begin, n)]
        return out, edges


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(total: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of so many tokens: full sequences, then the rest's binary digits from the largest."""
    bits = 1 << np.arange(sequence.bit_length() - 2, -1, -1) if sequence > 1 else np.empty(0, np.int64)
    full, rest = total // sequence, (total % sequence)[:, None] & bits
    n = full + (rest > 0).sum(axis=1)
    doc = np.repeat(np.arange(len(total)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length = np.full(len(doc), sequence, np.int64)
    length[within >= full[doc]] = rest[rest > 0]
    run = np.cumsum(length) - length
    start = run - np.repeat(run[np.cumsum(n) - n], n) if len(doc) else run
    return doc, start, length


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence; with its ids if asked for."""
    if sequence & (sequence - 1):
        raise ValueError("a sequence length must be a power of two")
    key = docs.schema[id_col]
    fields = [T.StructField(id_col, key.dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(lo, BATCH_ROWS)
                for part in slices(rows.column(1)):
                    ids, edges = coder.encode(part)
                    doc, start, length = pieces(np.diff(edges), sequence)
                    raw, begin = memoryview(ids.tobytes()), 4 * (edges[doc] + start)
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                    columns = [rows.column(0).take(pa.array(part.first + doc, pa.int64()))]
                    columns += [pa.array(x, pa.int64()) for x in (start, length, crc, np.diff(edges)[doc])]
                    if with_ids:
                        cut = np.concatenate([[0], np.cumsum(length)])
                        columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    packed = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, T.StructType(fields))
    # the numbers below depend on where rows lie: the checkpoint fixes that for good
    packed = checkpoint(packed.sortWithinPartitions("length"))
    return packed.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer())
