"""Operators on small inputs with results worked out by hand."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom import sources, streaming
from sparkloom.functions import text as tx
from sparkloom.functions import vectors
from sparkloom.operators import chunking, mutation, relational, retrieval, tables, usage


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "kind"),
    [("مرحبا بالعالم", "arabic"), ("hello world", "english"), ("مرحبا hello", "mixed"), ("123", "unknown"), ("", "unknown")],
)
def test_detect_language(spark, text, kind):
    assert one(spark, tx.detect_language(F.col("t")), t=text) == kind


def test_tokens(spark):
    assert one(spark, tx.tokenize(F.col("t")), t="The quick, quick fox! a b") == ["quick", "quick", "fox"]
    assert one(spark, tx.tokenize(F.col("t")), t="  ") == []
    assert one(spark, tx.normalize_arabic(F.col("t")), t="مَدرسةٌ إلى") == "مدرسه الي"
    assert one(spark, tx.tokenize(F.col("t")), t="قلم and قلم بيت") == ["قلم", "and", "قلم", "بيت"]


def test_tokens_by_a_language_that_is_known(spark):
    assert one(spark, tx.tokenize(F.col("t"), kind=F.lit("english")), t="fox fox") == ["fox", "fox"]
    assert one(spark, tx.tokenize(F.col("t"), kind=F.lit("mixed")), t="fox fox") == ["fox"]


def test_rows_that_become_many_are_dealt_out_finer(spark):
    rows = spark.range(100, numPartitions=2)
    assert sources.dealt(rows, "id").rdd.getNumPartitions() == 2 * sources.FINER


def test_intent(spark):
    cases = {"how many files": "metadata", "how many files about tax": "content", "summarize this": "summarize_doc", "": "content", "tax law": "content"}
    for query, kind in cases.items():
        assert one(spark, tx.classify_intent(F.col("t")), t=query) == kind


def test_clean_text_and_sentences(spark):
    assert one(spark, tx.clean_text(F.col("t")), t="Page 3 é ---- b") == "b"
    assert one(spark, tx.sentences(F.col("t")), t="One. Two!\n\n Three") == ["One", "Two", "Three"]


def test_windows_merge_keeps_overlap_twice(spark):
    text = " ".join(f"w{i}" for i in range(11))
    got = one(spark, chunking.windows(tx.words(F.col("t")), 10, 2), t=text)
    assert [w["token_count"] for w in got] == [13]
    assert got[0]["text"].endswith("w9 w8 w9 w10")
    assert one(spark, chunking.windows(tx.words(F.col("t")), 10, 2), t="") == []


def test_chunk_segments_orders_and_numbers(spark):
    schema = "doc_id int, text string, page_number int, position_in_doc int, paragraph_number int, chunk_index int, ord int, sub_order int"
    rows = [
        (1, "second segment of the text", None, None, None, None, 1, 0),
        (1, "first segment of the text", 1, None, None, None, 2, 0),
        (1, "first segment of the text", 2, None, None, None, 3, 0),
        (1, "short", 3, None, None, None, 4, 0),
    ]
    got = chunking.chunk_segments(spark.createDataFrame(rows, schema), 50, 5).orderBy("seq").select("seq", "chunk").collect()
    assert [tuple(r) for r in got] == [(0, "first segment of the text"), (1, "second segment of the text")]


def test_semantic_parts_split_where_vectors_turn(spark):
    rows = [(1, i, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(10)]
    got = chunking.semantic_parts(spark.createDataFrame(rows, "segment_id int, sentence_no int, vector array<double>"))
    parts = {r["sentence_no"]: r["part"] for r in got.collect()}
    assert parts[0] == 0 and parts[9] > 0


def test_collapse_runs(spark):
    rows = [(1, 0, "a", True), (1, 1, "a", True), (1, 2, "b", False), (1, 3, "b", False), (1, 4, "a", True)]
    frame = spark.createDataFrame(rows, "doc int, seq int, parent_id string, parent_is_complete boolean")
    assert sorted(r["seq"] for r in chunking.collapse_runs(frame, "doc", "seq").collect()) == [0, 2, 3, 4]


def test_greedy_batches(spark):
    assert one(spark, chunking.greedy_batches(F.col("s"), 2, 10), s=[4, 4, 4, 20, 1]) == [0, 0, 1, 2, 3]


@pytest.mark.parametrize(("n", "complete", "truncated"), [(0, False, False), (20, True, False), (21, False, False), (2001, False, True)])
def test_explode_tables(spark, n, complete, truncated):
    rows = [[("id", "7"), ("name", f"n{i}"), ("empty", " ")] for i in range(n)]
    schema = "table_id string, headers array<string>, rows array<array<struct<k:string,v:string>>>"
    got = tables.explode_tables(spark.createDataFrame([("t", ["id", "name"], rows)], schema)).first()
    assert (got["parent_is_complete"], got["truncated"]) == (complete, truncated)
    assert len(got["sentences"]) == min(n, 2000)
    if n:
        assert got["sentences"][0] == "name: n0"
    if truncated:
        assert got["overflow_text"] == "name: n2000" and got["parent_text"] == "name"


def test_vectors(spark):
    assert one(spark, vectors.cosine_distance(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 1.0
    assert one(spark, vectors.similarity(F.col("a"), F.col("b"), "Euclid"), a=[0.0, 3.0], b=[4.0, 0.0]) == -5.0
    with pytest.raises(ValueError):
        vectors.similarity(F.col("a"), F.col("b"), "hamming")


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid", "manhattan"])
def test_nearest_equals_scoring_all_pairs(spark, metric, monkeypatch):
    """Also for ties, other lengths, nulls and no numbers; and no task hands on more than the k best of each query a batch."""
    monkeypatch.setattr(retrieval.nearest, "POINTS", 16)
    rng = random.Random(3)
    vector = lambda i: [rng.choice([-2.0, 0.5, 1.0, 3.0]) for _ in range(4)] if i % 9 else [[0.0] * 4, [1.0, 2.0], None, [1.0, None, 0.0, 1.0], [float("nan")] * 4, [1e200] * 4][i // 9 % 6]
    schema = "chunk_id long, vector array<double>, agent_key string"
    points = spark.createDataFrame([(i, vector(i), "ab"[i % 2] if i % 5 else None) for i in range(200)], schema).repartition(3)
    asked = points.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query"), "agent_key")
    met = points.crossJoin(asked.select("query_id", "query", F.col("agent_key").alias("own")))
    met = met.withColumn("score", vectors.similarity(F.col("query"), F.col("vector"), metric))
    # a length's last digit differs by the formula's own rounding at 1 only
    shown = lambda rows: sorted((r["query_id"], r["rank"], r["chunk_id"], repr(r["score"] and round(r["score"], 9))) for r in rows.collect())
    clipped = F.when(F.col("score").between(-1.0, 1.0) | F.col("score").isNull() | F.isnan("score"), F.col("score")).otherwise(F.signum("score")) if metric == "cosine" else F.col("score")
    met = met.withColumn("score", clipped)
    assert shown(retrieval.dense_search(points, asked, 5, metric)) == shown(retrieval.ranked(met, 5))
    assert retrieval.nearest.candidates(points.where("chunk_id % 9 <> 0"), asked.where("query_id % 9 <> 0"), 5, metric).groupBy("query_id").count().where("count > 5 * 3 * 5").count() == 0
    if metric == "cosine":
        items = points.select("chunk_id", F.lit(None).cast("string").alias("deleted_at"))
        got = retrieval.recall(points, asked, items, 5).select("query_id", "rank", "chunk_id", "score")
        assert shown(got) == shown(retrieval.ranked(met.where("agent_key = own"), 5))


def test_cosine_is_the_product_over_one_root(spark):
    a, b = [0.1, 0.7, 0.3], [0.9, 0.2, 0.4]
    inner = lambda v, w: v[0] * w[0] + v[1] * w[1] + v[2] * w[2]
    wanted = inner(a, b) / (inner(a, a) * inner(b, b)) ** 0.5
    assert one(spark, vectors.cosine_similarity(F.col("a"), F.col("b")), a=a, b=b) == wanted


@pytest.mark.parametrize(("refill", "wanted"), [(True, [0, 2]), (False, [0])])
def test_a_dropped_near_duplicate_is_made_up_for(spark, refill, wanted):
    rows = [(0, [1.0, 0.0], ["aa", "bb"], "t"), (1, [0.9, 0.1], ["aa", "bb"], "t"), (2, [0.5, 0.5], ["cc"], "t")]
    points = spark.createDataFrame(rows, "chunk_id long, vector array<double>, tokens array<string>, text string")
    asked = spark.createDataFrame([(7, [1.0, 0.0], ["zz"])], "query_id long, query array<double>, tokens array<string>")
    got = retrieval.hybrid_retrieve(points, asked, 2, refill=refill).orderBy("pos").collect()
    assert [(r["pos"], r["chunk_id"]) for r in got] == list(enumerate(wanted))


def test_fuse_ties_and_empty_legs(spark):
    schema = "query_id int, chunk_id string, rank int"
    dense = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], schema)
    sparse = spark.createDataFrame([(1, "b", 0), (1, "c", 1)], schema)
    got = retrieval.fuse(dense, sparse, 10).orderBy("pos").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a", "c"]
    assert retrieval.fuse(dense, sparse, 0).count() == 0
    assert [r["chunk_id"] for r in retrieval.fuse(dense, sparse.limit(0), 10).orderBy("pos").collect()] == ["a", "b"]


def test_near_duplicates_are_not_transitive(spark):
    rows = [(1, 0, 0.5, list("abcdefghij")), (1, 1, 0.9, list("abcdefghij")), (1, 2, 0.4, list("abcdefghi"))]
    frame = spark.createDataFrame(rows, "query_id int, pos int, score double, tokens array<string>")
    assert [r["pos"] for r in retrieval.drop_near_duplicates(frame, 0.9).collect()] == [1]


def test_similar_pairs_equal_all_pairs(spark, monkeypatch):
    """Sets that share rare and common tokens, copies, empty sets; lists in blocks of a few sets."""
    monkeypatch.setattr(retrieval, "BLOCK_SETS", 3)
    rng, rows = random.Random(7), []
    for k in range(120):
        base = [f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(0, 14))]
        for _ in range(rng.randrange(1, 4)):
            rows.append((len(rows), [w for w in base if rng.random() > 0.08] + ["the"] * (k % 2)))
    frame = spark.createDataFrame(rows, "id int, tokens array<string>").repartition(3)
    got = {(r["a"], r["b"]): r["similarity"] for r in retrieval.similar_pairs(frame, "id", "tokens", 7, 10).collect()}
    sets: dict = {}
    for i, tokens in rows:
        if tokens:
            sets.setdefault(frozenset(tokens), i)
    wanted = {}
    for x, i in sets.items():
        for y, j in sets.items():
            if i < j and 10 * len(x & y) >= 7 * len(x | y):
                wanted[i, j] = len(x & y) / len(x | y)
    assert got == wanted and len(wanted) > 20
    assert retrieval.similar_pairs(frame.limit(0), "id", "tokens", 7, 10).count() == 0


def test_similar_pairs_of_large_sets_in_parts(spark, monkeypatch):
    """Sets of many parts, some of few tokens; a set gives rows by what it may differ in, not by all of its tokens."""
    monkeypatch.setattr(retrieval.alike, "PART", 6)
    rng = random.Random(11)
    sets = {}
    for k in range(30):
        base = rng.sample(range(300), rng.randrange(2, 120))
        for _ in range(3):
            swap = rng.randrange(0, 1 + len(base) // 6)
            sets[len(sets)] = {f"t{w}" for w in base[swap:]} | {f"t{rng.randrange(300)}" for _ in range(rng.randrange(0, 3))}
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id int, tokens array<string>")
    got = {(r["a"], r["b"]) for r in retrieval.similar_pairs(frame, "id", "tokens", 8, 10).collect()}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    wanted = {(min(i, j), max(i, j)) for x, i in first.items() for y, j in first.items() if i != j and 10 * len(x & y) >= 8 * len(x | y)}
    assert got == wanted and len(wanted) > 10
    hashed = frame.select("id", F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t))).alias("hashes"))
    counts = spark.sparkContext.broadcast(retrieval.alike.bucket_counts(hashed))
    monkeypatch.setattr(retrieval.alike, "PART", 128)
    assert retrieval.alike.keyed(hashed, False, counts, 8, 10, 4096).count() <= sum(len(s) // 4 + 1 for s in sets.values())


def test_payload_filter(spark):
    frame = spark.createDataFrame([("a", {"x": "1"}), ("b", {"y": "1"})], "id string, payload map<string,string>")
    assert [r["id"] for r in frame.where(relational.payload_filter({"x": ["1", "2"]})).collect()] == ["a"]
    for bad in (1.5, None, {"a": 1}, [1, "a"]):
        with pytest.raises(ValueError):
            relational.payload_filter({"x": bad})


def test_pages_follow_cursors(spark):
    frame, seen, cursor = spark.range(45), [], None
    while True:
        got = relational.page(frame, "id", 20, cursor)
        seen += [r["id"] for r in got.rows]
        cursor = got.next_cursor
        if cursor is None:
            break
    assert seen == list(range(44, -1, -1))
    with pytest.raises(ValueError):
        relational.decode_cursor("***")


def test_scope_and_narrowing(spark):
    frame = spark.createDataFrame([("w", 1), ("v", 2)], "workspace_id string, n int")
    assert relational.scoped(frame, None).count() == 0
    assert relational.scoped(frame, "w").count() == 1
    assert relational.narrowed(frame, n=None).count() == 2 and relational.narrowed(frame, n=[]).count() == 0


def test_rollups_count_wildcards_once(spark):
    at = dt.datetime(2024, 1, 31, 23)
    rows = [("w", "*", "p", "o1", 5, 15, at), ("w", "*", "p", "o1", 5, 15, at)]
    schema = "workspace_id string, agent_key string, provider string, operation_id string, tokens long, cost_micros long, created_at timestamp"
    got = usage.rollups(usage.deduplicated(spark.createDataFrame(rows, schema))).where("period = 'day'").collect()
    assert {(r["agent_key"], r["provider"]): r["tokens"] for r in got} == {("*", "*"): 5, ("*", "p"): 5}


def test_quota_edges(spark):
    schema = "workspace_id string, r_agent string, r_provider string, rule_no int, metric string, scope string, period string, limit_value long, current long, estimated int"
    on_cap = spark.createDataFrame([("w", "a", "p", 0, "tokens", "workspace", "day", 100, 90, 10)], schema)
    assert usage.decisions(on_cap).first()["allowed"]
    rows = [("w", "a", "p", 0, "cost_micros", "workspace", "day", 5, 5, 10), ("w", "a", "p", 1, "tokens", "provider", "day", 100, 95, 10)]
    got = usage.decisions(spark.createDataFrame(rows, schema)).first()
    assert (got["allowed"], got["binding"], got["reason"], got["remaining"]) == (False, "tokens/provider/day", "quota_exceeded", 5)


def test_mutations(spark):
    current = spark.createDataFrame([(1, "a", 1)], "id int, v string, version int")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string")
    got = mutation.replace_upsert(current, new, ["id"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "b", 2), (2, "c", 1)]
    updates = spark.createDataFrame([(1, "x", 1), (1, "z", 1), (2, "y", 9)], "id int, v string, version int")
    state, conflicts = mutation.optimistic_update(current, updates, "id", ["v"])
    assert [tuple(r) for r in state.collect()] == [(1, "x", 2)]
    assert sorted((r["id"], r["v"]) for r in conflicts.collect()) == [(1, "z"), (2, "y")]
    inserted = mutation.insert_ignore(current, updates, ["id"], ["version"]).orderBy("id").collect()
    assert [r["v"] for r in inserted] == ["a", "y"]


def test_idempotency_and_jobs(spark):
    requests = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("d", "x")], "key string, request_hash string")
    store = spark.createDataFrame([("b", "h", "r"), ("c", "h", None), ("d", "h", "r")], "key string, request_hash string, response string")
    got = {r["key"]: r["outcome"] for r in mutation.idempotency_outcomes(requests, store, ["key"]).collect()}
    assert got == {"a": "claimed", "b": "replay", "c": "in_progress", "d": "mismatch"}
    jobs = [(1, "queued"), (2, "succeeded"), (3, "running"), (4, "queued"), (5, "queued")]
    jobs = spark.createDataFrame([(i, st, 0, 0) for i, st in jobs], "id int, status string, total_chunks long, done_chunks long")
    moves = [(1, 0, "advance", 1), (1, 1, "start", 8), (1, 2, "start", 6), (1, 3, "advance", 9), (2, 0, "cancel", 0), (2, 1, "fail", 0),
             (3, 0, "succeed", 0), (4, 0, "start", 4), (4, 1, "advance", 3), (4, 2, "cancel", 0), (4, 3, "advance", 4)]
    moved = mutation.move_jobs(jobs, spark.createDataFrame(moves, "id int, pos long, move string, n long"))
    got = {r["id"]: (r["status"], r["total_chunks"], r["done_chunks"], r["refused"]) for r in moved.collect()}
    assert got == {1: ("running", 6, 6, 1), 2: ("succeeded", 0, 0, 1), 3: ("succeeded", 0, 0, 0), 4: ("cancelled", 4, 3, 1), 5: ("queued", 0, 0, 0)}
    shown = moved.select("id", mutation.percent(F.col("status"), F.col("done_chunks"), F.col("total_chunks")).alias("p")).collect()
    assert {r["id"]: r["p"] for r in shown} == {1: 99, 2: 100, 3: 100, 4: 75, 5: 0}


def test_dispatch(spark):
    good = '{"id":"1","type":"t","workspaceid":"w"}'
    rows = [(good, 1, False), (None, 1, False), ("{", 1, False), ('{"id":"1","type":"t"}', 1, False), (good, 5, True), (good, 4, True), ('{"id":"1","type":"u","workspaceid":"w"}', 1, False)]
    frame = spark.createDataFrame(rows, "ce string, delivery_count int, failed boolean")
    got = [(r["outcome"], r["reason"]) for r in streaming.dispatched(frame, ["t"]).collect()]
    assert got == [("handled", None), ("dead_letter", "malformed"), ("dead_letter", "malformed"), ("dead_letter", "incomplete"), ("dead_letter", "retries"), ("redeliver", None), ("skipped", None)]


def test_published_prefix(spark):
    rows = [(str(i), dt.datetime(2024, 1, 1, 0, i), None) for i in range(5)]
    outbox = spark.createDataFrame(rows, "id string, created_at timestamp, published_at timestamp")
    results = spark.createDataFrame([("0", True), ("1", True), ("2", False), ("3", True)], "id string, ok boolean")
    assert sorted(r["id"] for r in streaming.published_prefix(outbox, results, 10).collect()) == ["0", "1"]


def test_stream_claims_once_and_splits(spark, tmp_path):
    rows = [(i % 10, "t" if i % 3 else "u", dt.datetime(2024, 1, 1, 0, i % 50)) for i in range(100)]
    frame = spark.createDataFrame(rows, "event_id long, kind string, ts timestamp")
    frame.write.parquet(str(tmp_path / "in"))
    events = streaming.claimed(sources.event_stream(spark, str(tmp_path / "in"), frame.schema), "ts", ["event_id"])

    def sinks(batch, number):
        batch.write.mode("append").parquet(str(tmp_path / "out"))

    streaming.run_split(events, str(tmp_path / "checkpoint"), sinks).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_text_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.bin").write_text("x")
    (tmp_path / "c.csv").write_text("a,b")
    got = sources.text_documents(spark, str(tmp_path)).collect()
    assert sorted((r["ext"], r["text"]) for r in got) == [("csv", "a,b"), ("txt", "hello")]


def test_points_are_laid_out_by_tenant_and_space(spark, tmp_path):
    rows = [(i, f"w{i % 2}", "s" if i % 3 else None, [float(i)]) for i in range(12)]
    points = spark.createDataFrame(rows, "chunk_id long, workspace_id string, space string, vector array<double>")
    retrieval.write_points(points, str(tmp_path / "points"))
    stored = spark.read.parquet(str(tmp_path / "points"))
    assert stored.count() == 12 and stored.where("workspace_id = 'w1' AND space = 's'").count() == 4
    plan = stored.where("workspace_id = 'w1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(workspace_id" in plan


def test_small_tables_are_dealt_to_all_cores(spark, folder):
    few = sources.table(spark, folder, "documents").coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert sources.spread(few).rdd.getNumPartitions() == cores
    many = few.repartition(cores + 3)
    assert sources.spread(many) is many


def test_long_lists_are_joined(spark):
    frame = spark.range(5000).withColumnRenamed("id", "k")
    wanted = list(range(0, 4000, 2)) + [7, 7]
    assert relational.any_of(frame, "k", wanted).count() == 2001
    assert relational.any_of(frame, "k", [1, 2, 9999]).count() == 2 and relational.any_of(frame, "k", []).count() == 0


def test_delivery_stream_splits_sinks_once(spark, tmp_path):
    """Entries of a file stream are dispatched in micro-batches; a second run over the same files gives nothing new."""
    rows = [(f"{i}", "click" if i % 3 else "odd", "w", None, i % 7 == 0) for i in range(50)]
    frame = spark.createDataFrame(rows, "id string, type string, workspace_id string, data string, failed boolean")
    made = frame.select("failed", streaming.envelope(F.col("id"), F.col("type"), F.col("workspace_id"), F.current_timestamp(), F.col("data")).alias("ce"), F.lit(5).alias("delivery_count"))
    made.coalesce(2).write.parquet(str(tmp_path / "in"))
    seen = []

    def sinks(batch, number):
        done = streaming.dispatched(batch, ["click"])
        seen.extend((r["id"], r["outcome"]) for r in done.select("id", "outcome").collect())

    for _ in range(2):
        stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
        streaming.run_split(stream, str(tmp_path / "checkpoint"), sinks).awaitTermination()
    assert len(seen) == 50 and dict(seen)["0"] == "skipped" and dict(seen)["7"] == "dead_letter" and dict(seen)["1"] == "handled"
