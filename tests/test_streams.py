"""Streams with state, tables written as one by micro-batches, and rollups that rewrite what a batch touches."""

from __future__ import annotations

import datetime as dt
import random
import time
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sparkloom import streaming
from sparkloom.operators import chunking, mutation, structure, usage
from sparkloom.operators.folds import Admission
from sparkloom.streaming import ledger as ledgers
from sparkloom.streaming import stateful

START = dt.datetime(2024, 1, 1)


def second(n):
    return START + dt.timedelta(seconds=n)


def run(stream, path, seen, mode="update"):
    """Run over what is there; collect the rows of each batch."""
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: seen.extend(batch.collect())).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    query.awaitTermination()


def test_delivery_counts_go_on_after_a_restart(spark, tmp_path):
    """Three micro-batches, the stream started anew for each, give what the batch function gives."""
    rng = random.Random(5)
    rows = [(f"g{rng.randrange(2)}", rng.randrange(6), second(k), k % 5 == 4 and rng.random() < 0.5) for k in range(90)]
    kind = "consumer_group string, entry_id int, at timestamp, ack boolean"
    seen: list = []
    for part in range(3):
        spark.createDataFrame(rows[30 * part : 30 * part + 30], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        entries = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        run(stateful.delivery_stream(entries, ["consumer_group", "entry_id"]), tmp_path / "state", seen)
    got = {(r["consumer_group"], r["entry_id"]): tuple(r)[2:] for r in seen}
    every = spark.createDataFrame(rows, kind)
    wanted = streaming.delivered(every.where("NOT ack").drop("ack"), every.where("ack"), ["consumer_group", "entry_id"])
    assert got == {(r["consumer_group"], r["entry_id"]): (r["deliveries"], r["last_at"], r["pending"]) for r in wanted.collect()}
    assert max(d for d, _, _ in got.values()) > 3 and {p for _, _, p in got.values()} == {True, False}


def test_admissions_expire_in_a_stream(spark, tmp_path):
    """Batch by batch the same attempts are admitted as in one fold, and after the last one's end nothing is kept."""
    rng = random.Random(2)
    rows = [(rng.randrange(3), k, second(4 * k + rng.randrange(3))) for k in range(60)]
    kind = "user_id int, n int, ts timestamp"
    seen: list = []
    for part in range(3):
        spark.createDataFrame(rows[20 * part : 20 * part + 20], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        attempts = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        run(stateful.admission_stream(attempts, "user_id", "ts", ["n"], 30, 2), tmp_path / "state", seen, "append")
    wanted = streaming.admissions(spark.createDataFrame(rows, kind), "user_id", "ts", ["n"], 30, 2).select("user_id", "n", "admitted").collect()
    assert sorted(map(tuple, seen)) == sorted(map(tuple, wanted)) and {r["admitted"] for r in wanted} == {True, False}
    # an attempt much later moves the watermark beyond every admission's end; its own goes in a batch after the next
    for k, late in enumerate((100_000, 200_000)):
        spark.createDataFrame([(9, 1000 + k, second(late))], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        attempts = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        run(stateful.admission_stream(attempts, "user_id", "ts", ["n"], 30, 2), tmp_path / "state", seen, "append")
    held = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "held").load()
    assert {r["key"]["user_id"] for r in held.collect()} <= {9}


def outcome_counts(spark, ledger):
    return {name: ledger.read(name, kind).count() for name, kind in (("effects", "id string, workspace_id string, data string"), ("outbox", ledgers.OUTBOX), ("letters", "source_id int, reason string"))}


@pytest.mark.parametrize("broken", ["claims", "effects", "outbox", "letters", "commit"])
def test_a_batch_that_fails_between_writes_counts_once(spark, tmp_path, monkeypatch, broken):
    """A sink that dies between two writes and is started again leaves each effect, event and dead letter once."""
    rows = [(k, f"id{k % 25}", "click" if k % 4 else "other", k % 7 == 0) for k in range(60)]
    frame = spark.createDataFrame(rows, "entry_id int, id string, type string, failed boolean")
    ce = streaming.envelope(F.col("id"), F.col("type"), F.lit("w"), F.lit(START), F.lit("{}"))
    made = frame.select(F.lit("s").alias("stream"), "entry_id", ce.alias("ce"), F.lit(5).alias("delivery_count"), "failed")
    for lo in (0, 30):
        made.where(f"entry_id >= {lo} AND entry_id < {lo + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ledger = ledgers.BatchLedger(spark, str(tmp_path / "tables"))

    def start():
        entries = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        effect = lambda done: done.select("id", F.col("workspace").alias("workspace_id"), F.lit("done").alias("data"))
        return ledgers.deliver(entries, str(tmp_path / "checkpoint"), ledger, ["click"], "g", effect, F.lit("a.b.c.v1"), F.lit(START).cast("timestamp"))

    put, commit, left = ledgers.BatchLedger.put, ledgers.BatchLedger.commit, [1]

    def fails(self, name, batch, rows=None):
        if batch == 1 and left and name == broken:
            left.pop()
            raise RuntimeError("killed")
        return put(self, name, batch, rows)

    monkeypatch.setattr(ledgers.BatchLedger, "put", fails)
    monkeypatch.setattr(ledgers.BatchLedger, "commit", lambda self, batch: (fails(self, "commit", batch) if broken == "commit" and batch == 1 and left else None, commit(self, batch)))
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    assert ledger.last() == 0 and not left
    first = outcome_counts(spark, ledger)
    start().awaitTermination()
    assert ledger.last() == 1
    done = [(k, i) for k, i, t, failed in rows if t == "click" and not failed]
    wanted = {"effects": len({i for _, i in done}), "outbox": len({i for _, i in done}), "letters": sum(t == "click" and f for _, _, t, f in rows)}
    assert outcome_counts(spark, ledger) == wanted and first["effects"] < wanted["effects"]
    effects = ledger.read("effects", "id string, workspace_id string, data string")
    assert effects.select("id").distinct().count() == wanted["effects"]
    start().awaitTermination()
    assert outcome_counts(spark, ledger) == wanted

    out = ledgers.BatchLedger(spark, str(tmp_path / "out"))
    broken_id = effects.agg(F.min("id")).first()[0]
    send = lambda ok: lambda due: due.select("id", (F.lit(ok) | (F.col("id") != broken_id)).alias("ok"))
    n = ledgers.relay(ledger, out, send(False), 1000)
    assert n < wanted["outbox"] and n + ledgers.relay(ledger, out, send(True), 1000) == wanted["outbox"]
    assert ledgers.relay(ledger, out, send(True), 1000) == 0


def test_two_groups_read_one_log_each_at_its_own_pace(spark, tmp_path):
    """Backlog before fresh entries, a last delivery that fails is a dead letter, and new objects go on where the old ones were."""
    kind = "stream string, ce string"
    ce = lambda k: streaming.envelope(F.lit(f"i{k:02}"), F.lit("odd" if k == 5 else "click"), F.lit("w"), F.lit(START), F.lit("x"))
    made = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit("s").alias("stream"), ce(k).alias("ce")) for k in range(10)])).alias("x")).select("x.*")
    log = ledgers.BatchLedger(spark, str(tmp_path / "log"))
    for part in (made.limit(6), made.subtract(made.limit(6)).orderBy("ce")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        ledgers.log_stream(stream, str(tmp_path / "checkpoint"), log).awaitTermination()
    assert log.last() == 1 and ledgers.append_entries(log, made, 1) == 1 and log.read("entries", ledgers.LOG).count() == 10

    def handle(bad):
        return lambda due: due.select("entry_id", F.get_json_object("ce", "$.id").isin(*bad).alias("failed"))

    group = lambda name: ledgers.ConsumerGroup(log, str(tmp_path / "groups"), name)
    told = lambda name: {(r["id"], r["delivery_count"]): r["outcome"] for r in group(name).state.read("outcomes", ledgers._OUTCOMES).select(F.get_json_object("ce", "$.id").alias("id"), "delivery_count", "outcome").collect()}
    assert group("a").cycle(handle(["i01"]), ["click"], 4) == 4
    assert group("b").cycle(handle([]), ["click"], 100) == 10
    assert told("a") == {("i00", 1): "handled", ("i01", 1): "redeliver", ("i02", 1): "handled", ("i03", 1): "handled"}
    # the backlog takes the first of two places
    assert group("a").cycle(handle(["i01"]), ["click"], 2, most_deliveries=2) == 2
    assert told("a")["i01", 2] == "dead_letter" and told("a")["i04", 1] == "handled"
    assert group("a").cycle(handle([]), ["click"], 100) == 5 and told("a")["i05", 1] == "skipped"
    assert group("a").cycle(handle([]), ["click"], 100) == 0 and group("b").cycle(handle([]), ["click"], 100) == 0
    letters = group("a").state.read("letters", "source_id string, reason string, consumer_group string").collect()
    assert [(r["reason"], r["consumer_group"]) for r in letters] == [("retries", "a")] and len(told("b")) == 10

    # a cycle that dies before its commit is delivered again under the same number
    ledgers.append_entries(log, made.limit(3))
    with pytest.raises(ZeroDivisionError):
        group("b").cycle(lambda due: 1 / 0, ["click"], 100)
    assert group("b").cycle(handle([]), ["click"], 100) == 3
    # the oldest whole batches go while enough newer entries stay
    ledgers.append_entries(log, made.limit(2), most=5)
    assert log.read("entries", ledgers.LOG).groupBy("batch").count().count() == 2 and log.read("entries", ledgers.LOG).count() == 5
    assert group("b").cycle(handle([]), ["click"], 100) == 2


def charges(spark, lo, hi, days):
    rows = [(k % 3, k, f"a{k % 2}", f"p{k % 2}", k, 2 * k, START + dt.timedelta(days=days[k % len(days)], seconds=k)) for k in range(lo, hi)]
    return spark.createDataFrame(rows, usage.LEDGER)


def files_of(root):
    return {str(f.relative_to(root)) for f in Path(root).rglob("part-*.parquet")}


def test_rollups_rewrite_only_what_a_batch_touches(spark, tmp_path, monkeypatch):
    first, second_batch = charges(spark, 0, 60, [0, 1, 40]), charges(spark, 50, 90, [1])
    root = str(tmp_path)
    usage.capture_batch(first, root)
    before = files_of(tmp_path / "rollups")
    usage.capture_batch(second_batch, root)
    after = files_of(tmp_path / "rollups")
    same = {f for f in before if "period_start=2024-01-02" not in f and "period=month/period_start=2024-01-01" not in f}
    assert same and same <= after and not (before - same) & after
    # operations 50 to 59 came before, under another day's charge
    every = usage.deduplicated(first.unionByName(second_batch.where("operation_id >= 60")))
    columns = ["workspace_id", "period", "period_start", "agent_key", "provider", "tokens", "cost_micros"]
    rows = lambda df: sorted(map(repr, df.select(columns).collect()))
    assert rows(usage.read_rollups(spark, root)) == rows(usage.rollups(every))
    # a batch that is run again, also after it failed half way, changes nothing
    wanted = rows(usage.read_rollups(spark, root))
    usage.capture_batch(second_batch, root)
    assert rows(usage.read_rollups(spark, root)) == wanted
    third = charges(spark, 100, 110, [1, 2])
    monkeypatch.setattr(usage, "read_rollups", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        usage.capture_batch(third, root)
    monkeypatch.undo()
    usage.capture_batch(third, root)
    assert rows(usage.read_rollups(spark, root)) == rows(usage.rollups(every.unionByName(third.select(every.columns))))


def test_streamed_rollups(spark, folder, tmp_path):
    """Micro-batches of charges, some of them twice, give the rollups of all charges at once."""
    from sparkloom.plans import queries

    every = queries.ledger(spark, folder).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in usage.LEDGER.split(", ")])
    every.repartition(3).write.parquet(str(tmp_path / "in"))
    every.where("operation_id % 4 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(usage.LEDGER).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    usage.rollup_stream(stream, str(tmp_path / "tables"), str(tmp_path / "checkpoint")).awaitTermination()
    columns = ["workspace_id", "period", "period_start", "agent_key", "provider", "tokens", "cost_micros"]
    rows = lambda df: sorted(map(repr, df.select(columns).collect()))
    assert rows(usage.read_rollups(spark, str(tmp_path / "tables"))) == rows(queries.QUERIES["d9_usage_rollups"](spark, folder))


def test_replaced_partitions_leave_the_others(spark, tmp_path):
    path = str(tmp_path / "limits")
    rows = spark.createDataFrame([(w, f"m{k}", k) for w in (1, 2) for k in range(3)], "workspace_id int, metric string, value int")
    mutation.replace_partitions(rows, path, ["workspace_id"])
    before = files_of(tmp_path)
    mutation.replace_partitions(rows.where("workspace_id = 2 AND value = 1"), path, ["workspace_id"])
    assert {f for f in before if "workspace_id=1" in f} == {f for f in files_of(tmp_path) if "workspace_id=1" in f}
    assert sorted((r["workspace_id"], r["metric"]) for r in spark.read.parquet(path).collect()) == [(1, "m0"), (1, "m1"), (1, "m2"), (2, "m1")]


def test_gauges_in_flight_and_sessions_with_late_rows(spark, tmp_path):
    """Counts are told while a stream runs; a row behind the watermark opens no session."""
    kind = "stream string, ce string, delivery_count int, failed boolean"
    ce = [streaming.envelope(F.lit(f"i{k}"), F.lit("click" if k % 3 else "odd"), F.lit("w"), F.lit(START), F.lit("x")) for k in range(12)]
    made = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit("s").alias("stream"), c.alias("ce"), F.lit(1).alias("delivery_count"), F.lit(k % 4 == 1).alias("failed")) for k, c in enumerate(ce)])).alias("x")).select("x.*")
    made.repartition(3).write.parquet(str(tmp_path / "in"))
    entries = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    gauges = streaming.Gauges()
    spark.streams.addListener(gauges)
    try:
        run(streaming.outcome_gauges(streaming.dispatched(entries, ["click"])), tmp_path / "c1", [], "append")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if gauges.totals.get("depth") == 12:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(gauges)
    wanted = {r["outcome"]: r["count"] for r in streaming.dispatched(made, ["click"]).groupBy("outcome").count().collect()}
    assert gauges.totals == {"depth": 12, "dead_letter": 0, "handled": 0, "skipped": 0, "redeliver": 0} | wanted

    kind, seen = "user_id int, ts timestamp", []
    for part in ([(1, second(0)), (1, second(30)), (1, second(500))], [(2, second(3000))], [(1, second(100)), (2, second(3010))], [(3, second(9000))]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        events = spark.readStream.schema(kind).parquet(str(tmp_path / "events"))
        run(streaming.session_counts(events, "ts", ["user_id"], "1 minute", "0 seconds"), tmp_path / "c2", seen, "append")
    assert sorted((r["user_id"], r["session"]["start"], r["n"]) for r in seen) == [(1, second(0), 2), (1, second(500), 1), (2, second(3000), 2)]


# ---------------------------------------------------------------- folds


def test_folds_carry_state_over_batches(spark):
    """A hot key of many Arrow batches, null keys, and what a plain loop gives."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rng = random.Random(1)
        rows = [(rng.choice([1, 1, 1, 1, None, 2]), k, rng.randrange(1, 50)) for k in range(3000)]
        frame = spark.createDataFrame(rows, "space int, n int, size int").withColumn("used", F.lit(10))
        got = {r["n"]: r["accepted"] for r in mutation.admitted(frame, "space", ["n"], "size", "used", 900, 40).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held: dict = {}
    for space, n, size in rows:
        used = held.setdefault(space, 10)
        fits = size > 40 or used + size <= 900
        held[space] += size if fits else 0
        assert got[n] == fits
    assert mutation.admitted(frame.limit(0), "space", ["n"], "size", "used", 900, 40).count() == 0


def test_a_hot_key_is_folded_in_linear_time(spark):
    frame = spark.range(300_000).select(F.lit("hot").alias("space"), F.col("id").alias("n"), F.lit(3).alias("size"), F.lit(0).alias("used"))
    assert mutation.admitted(frame, "space", ["n"], "size", "used", 600_000, 10).where("accepted").count() == 200_000
    made = chunking.batched(frame, ["space"], ["n"], {"batch": ("size", 4, 100)})
    assert made.agg(F.max("batch")).first()[0] == 74_999
    images = frame.select("space", F.lit(1).alias("page"), "n", F.col("n").cast("string").alias("sha1"), F.lit(300).alias("width"), F.lit(300).alias("height"))
    assert structure.images_to_read(images, "space", "page", "n").where("read").count() == 8


def test_admission_lets_go_of_what_is_over():
    admit = Admission(10, 2)
    assert [admit(t) for t in (0, 5, 9, 10, 11, 15, 16)] == [True, True, False, True, False, True, False]
    assert admit.held == [10, 15]
