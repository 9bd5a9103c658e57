"""Ranked lexical search over document-sharded postings.

An index is a table of shards.  A shard holds some documents: their ids, its
distinct terms (64-bit hashes, sorted, taken for equality), and for each term a
run of (document, impact) postings.  The impact of a posting is the integer
``1000000000 tf div (1000 tf + 12 m)``, computed once, when the index is built,
from the corpus totals that a first pass over the texts counts.  No text and no
posting is ever shuffled; shards are written where their documents were read.

A search takes the queries in blocks of bounded size.  For each block one pass
over the shards' term columns counts document frequencies; a second one adds up
scores, term after term, in an array with a place for each document of the
shard, and keeps the best ``k`` of each query.  A task merges the shards it
reads; what tasks keep is merged twice, in parts and then whole.

A term is a maximal run of ASCII letters and digits and of non-ASCII characters,
with A-Z lower-cased.

Defined results: null and empty texts have no terms and are never found; a query
without terms finds nothing.  Rows of equal score come by ascending id, a null
id last.  Repeated documents are ranked row by row; a query row that repeats as
a whole is answered once, different texts under one id each for itself.  Of an
empty table nothing is found.  A text of any length is one document of one
shard.  Only id and text are read, so other columns don't matter, whatever
their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import checkpoint, delete_path, documents, shared_dir, table
from sparkloom.llm.textops import LOWER_ASCII, PrefixHash, Slice, slices

TOP = 20
#: Postings and documents of a shard, about; a longer document has a shard of its own.
SHARD_POSTINGS, SHARD_DOCS = 2 << 20, 1 << 18
#: Queries, and bytes of their texts, that are answered in one pass over the index.
BLOCK_QUERIES, BLOCK_BYTES = 4096, 4 << 20
#: Parts in which the tasks' best documents of a query are merged first.
PARTS = 16

NOT_IN_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def terms(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of a slice in order, and where each document's begin (n + 1)."""
    data = LOWER_ASCII[part.data]
    starts, ends, first = part.words(data, NOT_IN_TERM)
    return (PrefixHash(data).of(starts, ends) if len(starts) else np.empty(0, np.uint64)), first


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)


# ---------------------------------------------------------------- the index

_TOTALS = T.StructType([T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType())])
_SHARD = T.StructType(
    [
        T.StructField("docs", T.ArrayType(T.LongType())),
        T.StructField("terms", T.BinaryType()),
        T.StructField("edges", T.BinaryType()),
        T.StructField("places", T.BinaryType()),
        T.StructField("impacts", T.BinaryType()),
    ]
)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and all their terms."""
    docs = total = 0
    for batch in batches:
        for part in slices(batch.column(0)):
            starts, _, first = part.words(part.data, NOT_IN_TERM)
            docs += int((np.diff(first) > 0).sum())
            total += len(starts)
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], names=_TOTALS.names)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The integer weight of a term that occurs tf times in a document of length norm m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _shards(n_docs: int, n_terms: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = held = 0

        def shard() -> pa.RecordBatch:
            term, place, tf = (np.concatenate(x) for x in zip(*postings, strict=True))
            order = np.argsort(term, kind="stable")  # places ascend within a term
            term, place, tf = term[order], place[order], tf[order]
            m = 100 - 25 + 25 * np.concatenate(lengths) * n_docs // max(1, n_terms)
            edges = _runs(term)
            docs = pa.concat_arrays(ids)
            columns = [pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)]
            blobs = [term[edges[:-1]], edges.astype("<i4"), place.astype("<i4"), impacts(tf, m[place]).astype("<i4")]
            columns += [pa.array([x.tobytes()], pa.binary()) for x in blobs]
            return pa.RecordBatch.from_arrays(columns, names=_SHARD.names)

        for batch in batches:
            for part in slices(batch.column(1)):
                term, first = terms(part)
                n = np.diff(first)
                doc = np.repeat(np.arange(len(part)), n)
                order = np.argsort(term, kind="stable")  # documents ascend within a term
                term, doc = term[order], doc[order]
                edges = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]), [True]])) if len(term) else np.zeros(1, np.int64)
                at = edges[:-1]
                postings.append((term[at], rows + doc[at], np.diff(edges)))
                ids.append(batch.column(0).slice(part.first, len(part)))
                lengths.append(n)
                rows, held = rows + len(part), held + len(at)
                if held >= SHARD_POSTINGS or rows >= SHARD_DOCS:
                    yield shard()
                    ids, lengths, postings, rows, held = [], [], [], 0, 0
        if rows:
            yield shard()

    return run


@dataclass
class Index:
    """Shards written under a path of their own, and the corpus totals that their impacts were computed with."""

    spark: SparkSession
    path: str
    n_docs: int
    n_terms: int

    @property
    def shards(self) -> DataFrame:
        return self.spark.read.schema(_SHARD).parquet(f"{self.path}/shards")

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        return Index(spark, path, *spark.read.parquet(f"{path}/totals").first())

    def delete(self) -> None:
        delete_path(self.spark, self.path)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Write the index of documents under a path that all executors share."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    totals = rows.select("text").mapInArrow(_counted, _TOTALS).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _TOTALS.names])
    totals.write.parquet(f"{path}/totals")
    index = Index.open(spark, path)
    shards = rows.mapInArrow(_shards(index.n_docs, index.n_terms), _SHARD)
    shards.write.option("compression", "zstd").parquet(f"{path}/shards")
    return index


# ---------------------------------------------------------------- search


@dataclass
class Block:
    """Some queries: the distinct hashes of their terms, sorted, and of each query the places of its terms there and how often it has each."""

    ids: pa.Array
    terms: np.ndarray
    edges: np.ndarray
    place: np.ndarray
    times: np.ndarray
    weights: np.ndarray | None = None

    @staticmethod
    def of(queries: pa.Table) -> Block:
        found = [terms(part) for part in slices(queries["text"])]
        term = np.concatenate([np.empty(0, np.uint64), *[t for t, _ in found]])
        owner = np.repeat(np.arange(len(queries)), np.concatenate([np.empty(0, np.int64), *[np.diff(f) for _, f in found]]).astype(np.int64))
        distinct, place = np.unique(term, return_inverse=True)
        pairs, times = np.unique(owner * max(1, len(distinct)) + place, return_counts=True)
        owner, place = np.divmod(pairs, max(1, len(distinct)))
        return Block(queries["id"].combine_chunks(), distinct, np.searchsorted(owner, np.arange(len(queries) + 1)), place, times)


def _matched(shard_terms: bytes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the wanted terms that a shard has: their places in the wanted, and in the shard."""
    own = np.frombuffer(shard_terms, np.uint64)
    if not len(own) or not len(wanted):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(own, wanted)
    at[at == len(own)] = 0
    there = np.flatnonzero(own[at] == wanted)
    return there, at[there]


_DF = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("df", T.LongType())])


def _frequencies(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for own, edges in zip(batch["terms"].to_pylist(), batch["edges"].to_pylist(), strict=True):
                there, at = _matched(own, shared.value)
                df[there] += np.diff(np.frombuffer(edges, "<i4"))[at]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], names=_DF.names)

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, in no order; of those that equal the k-th the least ids."""
    if len(score) <= k:
        return np.arange(len(score))
    least = score[np.argpartition(score, len(score) - k)[len(score) - k]]
    above, equal = np.flatnonzero(score > least), np.flatnonzero(score == least)
    if len(above) + len(equal) > k:
        equal = equal[np.argsort(ids[equal], kind="stable")[: k - len(above)]]
    return np.concatenate([above, equal])


def _search(shared, k: int, found: T.StructType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        n = len(block.ids)
        # per query: scores, ids (a null one as the greatest number) and whether the id is null
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * n
        top = np.iinfo(np.int64).max
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch["docs"][i].values
                null = np.asarray(docs.is_null())
                ids = docs.fill_null(top).to_numpy(zero_copy_only=False)
                edges, places, impact = (np.frombuffer(batch[c][i].as_buffer(), "<i4") for c in ("edges", "places", "impacts"))
                there, at = _matched(batch["terms"][i].as_py(), block.terms)
                row = np.full(len(block.terms), -1)
                row[there] = at
                for q in range(n):
                    lo, hi = block.edges[q], block.edges[q + 1]
                    own = row[block.place[lo:hi]]
                    worth = block.weights[block.place[lo:hi]] * block.times[lo:hi]
                    use = np.flatnonzero((own >= 0) & (worth > 0))
                    if not len(use):
                        continue
                    total = np.zeros(len(ids), np.int64)
                    for t in use.tolist():
                        a, b = edges[own[t]], edges[own[t] + 1]
                        total[places[a:b]] += impact[a:b].astype(np.int64) * worth[t]
                    scored = np.flatnonzero(total)
                    scored = scored[best(total[scored], ids[scored], k)]
                    both = [np.concatenate(x) for x in zip(kept[q], (total[scored], ids[scored], null[scored]), strict=True)]
                    keep = best(both[0], both[1], k)
                    kept[q] = tuple(x[keep] for x in both)
        which = np.repeat(np.arange(n), [len(x[0]) for x in kept])
        score, ids, null = (np.concatenate([x[c] for x in kept]) if n else [] for c in range(3))
        columns = [pa.array(which, pa.int32()), block.ids.take(pa.array(which)), pa.array(ids, pa.int64(), mask=np.asarray(null, bool)), pa.array(score, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=found.names)

    return run


def search(index: Index, queries: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The query id (its own column name), rank, doc_id and score of the ``k`` best documents of each query."""
    spark = index.spark
    # what no column of the result may be called
    name = id_col if id_col.lower() not in ("rank", "doc_id", "score") else f"query_{id_col}"
    rows = queries.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_QUERIES), -(-size // BLOCK_BYTES))
    found = T.StructType([T.StructField("no", T.IntegerType()), T.StructField("id", queries.schema[id_col].dataType), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    out = None
    for b in range(blocks):
        # a block has about BLOCK_QUERIES queries and BLOCK_BYTES of text at most
        block = Block.of(rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).toArrow())
        wanted = spark.sparkContext.broadcast(block.terms)
        df = index.shards.select("terms", "edges").mapInArrow(_frequencies(wanted), _DF).groupBy("place").agg(F.sum("df").alias("df")).toArrow()
        block.weights = np.zeros(len(block.terms), np.int64)
        for place, docs in zip(df["place"].to_pylist(), df["df"].to_pylist(), strict=True):
            block.weights[place] = weight(index.n_docs, docs)
        shared = spark.sparkContext.broadcast(block)
        part = F.spark_partition_id() % PARTS
        hits = index.shards.mapInArrow(_search(shared, k, found), found).withColumn("part", part)
        for key in (["no", "part"], ["no"]):
            hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
        hits = checkpoint(hits.select(F.col("id").alias(name), "rank", "doc_id", "score"))
        out = hits if out is None else out.unionByName(hits)
        wanted.unpersist()
        shared.unpersist()
    return out


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """Build an index, search it and delete it."""
    index = build_index(docs, f"{shared_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}")
    found = search(index, queries, k)
    index.delete()
    return found


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11_SQL = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals
),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 20
"""
