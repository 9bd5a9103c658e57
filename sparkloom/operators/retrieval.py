"""Batched retrieval: dense and sparse search, rank fusion, relevance floors, near-duplicate removal.

All take many queries at once.  A dense search scores each query against all
points, which is what exact search means; queries are the side that is sent to
all tasks, in blocks of a checked size (``BROADCAST_QUERIES``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import jaccard
from sparkloom.functions.vectors import METRICS
from sparkloom.operators import alike, nearest

DENSE_WEIGHT, SPARSE_WEIGHT, RRF_K = 0.5, 0.5, 60
NEAR_DUPLICATE = 0.95
BROADCAST_QUERIES = 10_000


def search_depth(k: int) -> int:
    """Over-fetch: three times k, 100 at most, for k clamped to 1..50."""
    return min(3 * max(1, min(k, 50)), 100)


def dense_search(points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k closest of points (chunk_id, vector) to queries (query_id, query).

    ``where`` narrows the points before any is scored.  Queries are met in blocks
    of at most about ``BROADCAST_QUERIES``, each sent to all tasks: every point is
    read once a block and keeps a place among the k best of its task before
    anything is shuffled.
    """
    if metric.lower() not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    points = (points if where is None else points.where(where)).select("chunk_id", "vector")
    return ranked(_met(points, queries.select("query_id", "query"), k, metric), k)


def _met(points: DataFrame, queries: DataFrame, k: int, metric: str, own: bool = False) -> DataFrame:
    """``nearest.candidates`` of all queries, block by block."""
    blocks = max(1, -(-queries.count() // BROADCAST_QUERIES))
    found = None
    for block in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        scored = nearest.candidates(points, some, k, metric, own)
        found = scored if found is None else found.unionByName(scored)
    return found


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query with 0-based ranks; ties go to the smaller chunk."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < max(k, 0))


def term_frequencies(tokens: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, term, tf) of (key, tokens)."""
    return tokens.select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def inverse_frequency(containing: Column, chunks: int) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1)."""
    df, n = containing.cast("double"), F.lit(float(chunks))
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_statistics(tokens: DataFrame, chunks: int) -> DataFrame:
    """(term, total, documents, idf) of a column ``tokens``, in one pass: each chunk gives its tokens and its distinct ones, which are summed before they are shuffled."""
    once = lambda column, n, df: F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(n).alias("n"), F.lit(df).alias("df")))
    both = F.concat(once("tokens", 1, 0), once(F.array_distinct("tokens"), 0, 1))
    sums = tokens.select(F.inline(both)).groupBy("term").agg(F.sum("n").alias("total"), F.sum("df").alias("documents"))
    return sums.withColumn("idf", inverse_frequency(F.col("documents"), chunks))


#: Distinct terms that are sent to all tasks at most; more are met by a shuffle.
BROADCAST_TERMS = 500_000


def sparse_search(chunks: DataFrame, queries: DataFrame, k: int, total: int, decimals: int = 6) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks by the sum of tf * tf * idf over shared terms.

    ``chunks`` is (chunk_id, tokens), ``queries`` (query_id, tokens); ``total`` is
    the number of chunks.  Only terms that are asked for are counted, so what the
    chunks hold besides never leaves its task.  Scores are rounded before they are
    ranked, so that sums in another order rank alike.
    """
    asked = term_frequencies(queries, "query_id")
    terms = asked.select("term").distinct()
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    rows = chunks.select("chunk_id", F.explode("tokens").alias("term")).join(F.broadcast(terms) if few else terms, "term", "left_semi")
    tf = rows.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg(inverse_frequency(F.count("*"), total).alias("idf"))
    wanted = asked.join(idf, "term").select("query_id", "term", F.col("tf").alias("q_tf"), "idf")
    shared = tf.join(F.broadcast(wanted) if few else wanted, "term")
    score = F.round(F.sum(F.col("q_tf") * F.col("tf") * F.col("idf")), decimals).alias("score")
    return ranked(shared.groupBy("query_id", "chunk_id").agg(score), k)


def fuse(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT, rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion; ties keep the dense order, then the sparse one."""
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")

    def part(rank: str, weight: float):
        return F.coalesce(F.lit(weight) * (F.lit(1.0) / (rrf_k + F.col(rank) + 1)), F.lit(0.0))

    score = part("dense_rank", dense_weight) + part("sparse_rank", sparse_weight)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))
    return both.withColumn("score", score).withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < max(k, 0))


def floors(candidates: DataFrame, least: float = 0.0, share: float = 0.0) -> DataFrame:
    """Candidates of at least a score, and of at least a share of their query's best survivor."""
    kept = candidates.where(F.col("score") >= least)
    if share <= 0:
        return kept
    best = F.max("score").over(Window.partitionBy("query_id"))
    return kept.withColumn("__best", best).where(F.col("score") >= share * F.col("__best")).drop("__best")


def drop_near_duplicates(candidates: DataFrame, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """Of each pair of a query's candidates with similar token sets the lower-scoring one goes, the later on ties.

    All pairs count, those with dropped candidates too.  A query has at most 100
    candidates (``search_depth``), so they are compared within one row of the
    query: the candidates, a whole search, are computed once and moved once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in candidates.columns], F.array_distinct("tokens").alias("__set"))
    each = candidates.groupBy("query_id").agg(F.collect_list(row).alias("c"))

    def loses(x: Column, y: Column) -> Column:
        ahead = F.coalesce(F.when(y["pos"] < x["pos"], y["score"] >= x["score"]).otherwise(x["score"] < y["score"]), F.lit(False))
        return (x["pos"] != y["pos"]) & ahead & (jaccard(x["__set"], y["__set"]) >= threshold)

    kept = F.filter("c", lambda x: ~F.exists("c", lambda y: loses(x, y)))
    return each.select(F.explode(kept).alias("x")).select(*[F.col(f"x.`{c}`").alias(c) for c in candidates.columns])


#: Occurrences of a token for which its list is cut once more: a block has fewer sets than that, as it has one class of sizes and prefixes only.
BLOCK_SETS = 4096


def similar_pairs(rows: DataFrame, key: str, tokens: str, numerator: int, denominator: int) -> DataFrame:
    """(a, b, similarity): all pairs of different token sets with a Jaccard similarity of numerator / denominator or more.

    Equal sets are one, under the least key; empty sets are alike to nothing.
    Tokens are 64-bit hashes, taken for equality.  Sets meet under their rarest
    tokens (``alike.keyed``), by classes of size; pairs that can't be similar by
    their sizes, by where their first shared token stands, or by the parities of
    their tokens leave no task, and whole sets are fetched for the pairs left
    only.  A long list is cut into blocks, which meet pairwise.
    """
    hashes = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))).alias("hashes")
    hashed = rows.where(F.size(tokens) > 0).select(F.col(key).alias("id"), hashes)
    sets = hashed.groupBy("hashes").agg(F.min("id").alias("id")).select("id", "hashes")
    counts = rows.sparkSession.sparkContext.broadcast(alike.bucket_counts(hashed))
    x, y = (alike.keyed(sets, larger, counts, numerator, denominator, BLOCK_SETS) for larger in (False, True))
    # a set is in a row of its block as the smaller one, in a column as the larger: each pair of a list meets in one cell
    block, every = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = x.withColumn("__row", block).withColumn("__column", every)
    y = y.withColumn("__column", block).withColumn("__row", every)
    y = y.select("key", "__row", "__column", *[F.col(c).alias(f"y_{c}") for c in ("id", "n", "pos", "s0", "s1")])
    both = F.col("n") + F.col("y_n")
    apart = F.floor((both - 2 * F.ceil(both * numerator / (numerator + denominator))) / F.col("parts"))
    ordered = (F.col("n") < F.col("y_n")) | ((F.col("n") == F.col("y_n")) & (F.col("id") < F.col("y_id")))
    fits = ordered & (denominator * F.col("n") >= numerator * F.col("y_n")) & (F.col("pos") + F.col("y_pos") <= apart)
    differ = F.bit_count(F.col("s0").bitwiseXOR(F.col("y_s0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("y_s1")))
    met = x.join(y, ["key", "__row", "__column"]).where(fits & (differ <= apart))
    pairs = met.select(F.least("id", "y_id").alias("a"), F.greatest("id", "y_id").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("hashes").alias(f"__{side}")), side)
    shared = F.size(F.array_intersect("__a", "__b"))
    union = F.size("__a") + F.size("__b") - shared
    return pairs.where(denominator * shared >= numerator * union).select("a", "b", (shared / union).alias("similarity"))


def context(chunks: DataFrame) -> DataFrame:
    """(query_id, context): numbered chunk texts in order."""
    line = F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), F.col("text"))
    lines = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    return chunks.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def hybrid_retrieve(
    points: DataFrame,
    queries: DataFrame,
    k: int = 5,
    where: Column | None = None,
    least: float = 0.0,
    share: float = 0.0,
    near_duplicate: float = NEAR_DUPLICATE,
    metric: str = "cosine",
    refill: bool = True,
) -> DataFrame:
    """(query_id, chunk_id, score, pos, text): dense and sparse candidates fused, floored, freed of near-duplicates and cut to k.

    ``points`` is (chunk_id, vector, tokens, text and payload), ``queries``
    (query_id, query, tokens).  The filter narrows both legs; k is clamped to
    1..50 and three times as many candidates are looked at.  A scope that is
    empty (``where`` false) gives nothing, which is not the same as no scope.
    What stands for a near-duplicate that went is the next candidate; without
    ``refill`` nothing does, and what is left of the first k fused ones is returned.
    """
    k = max(1, min(k, 50))
    depth = search_depth(k)
    kept = points if where is None else points.where(where)
    dense = dense_search(kept, queries.select("query_id", "query"), depth, metric)
    sparse = sparse_search(kept.select("chunk_id", "tokens"), queries.select("query_id", "tokens"), depth, kept.count())
    fused = fuse(dense, sparse, depth).select("query_id", "chunk_id", "score", "pos")
    # at most 100 candidates a query fetch their texts
    found = kept.select("chunk_id", "tokens", "text").join(fused, "chunk_id")
    relevant = drop_near_duplicates(floors(found, least, share), near_duplicate)
    relevant = relevant if refill else relevant.where(F.col("pos") < k)
    order = Window.partitionBy("query_id").orderBy("pos")
    return relevant.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < k).select("query_id", "chunk_id", "score", "pos", "text")


def hydrated(found: DataFrame, items: DataFrame, key: str = "chunk_id") -> DataFrame:
    """What a search found with the items' own columns; hits whose item is gone or deleted drop out, so fewer than k may remain."""
    return found.join(items.where("deleted_at IS NULL").drop("deleted_at"), key)


def recall(points: DataFrame, queries: DataFrame, items: DataFrame, k: int, agent: str = "agent_key") -> DataFrame:
    """Each query's k nearest memories of its own agent, with their items; k is 1 to 50."""
    if not 1 <= k <= 50:
        raise ValueError("k must be between 1 and 50")
    asked = queries.select("query_id", "query", F.col(agent).alias("own"))
    scored = _met(points.select("chunk_id", "vector", F.col(agent).alias("own")), asked, k, "cosine", own=True)
    return hydrated(ranked(scored, k), items)


def referenced_parents(parents: DataFrame, chunks: DataFrame, document: str = "doc_id") -> DataFrame:
    """Parents (document, parent_key, ord, text) that chunks still refer to, numbered from 0 in their order within the document."""
    used = chunks.where("parent_key IS NOT NULL").select(document, "parent_key").distinct()
    seq = F.row_number().over(Window.partitionBy(document).orderBy("ord")) - 1
    return parents.join(used, [document, "parent_key"], "left_semi").withColumn("seq", seq)


def upsert_points(points: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New points replace those of their ids; of several new ones of an id the last in order of ``version`` counts."""
    newest = Window.partitionBy(key).orderBy(F.desc("version"))
    one = new.withColumn("__n", F.row_number().over(newest)).where("__n = 1").select(*points.columns)
    return points.join(one.select(key), key, "left_anti").unionByName(one)


def delete_points(points: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Points without those of the ids; an id that isn't there is no error."""
    return points.join(ids.select(key).distinct(), key, "left_anti")


def write_points(points: DataFrame, path: str) -> None:
    """Lay points out by tenant and space, so that a filter on either reads its own folders only."""
    points.repartition("workspace_id", "space").write.partitionBy("workspace_id", "space").mode("overwrite").parquet(path)
