"""Several tables written as one by a stream's micro-batches, and what is built on that.

A batch's rows go to a folder of their own in each table.  They count once the
batch is committed, by a single file that appears as a whole; until then no
reader sees any of them.  A batch that fails between two writes is run again by
Spark under the same number and overwrites its own folders; one that is run
again after it was committed writes nothing.  So effect, event and dead letter
of a batch appear together and once, whatever fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparkloom import streaming


class BatchLedger:
    """Tables under one root that the batches of one stream write together, in order."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, *parts: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The number of the last committed batch, -1 before the first."""
        where = self._path("_committed")
        if not self._files().exists(where):
            return -1
        return max((int(s.getPath().getName()) for s in self._files().listStatus(where)), default=-1)

    def put(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        """Write a batch's rows of a table; returns them as written, from which what must agree with them is derived."""
        path = f"{self.root}/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, batch: int) -> None:
        """Make a batch's rows count.  Batches come in order, so the last number stands for all before it."""
        files = self._files()
        files.mkdirs(self._path("_committed"))
        files.create(self._path("_committed", batch), True).close()
        for status in files.listStatus(self._path("_committed")):
            if int(status.getPath().getName()) < batch - 1:
                files.delete(status.getPath(), False)

    def drop(self, name: str, batch: int) -> None:
        """Delete a batch's rows of a table."""
        self._files().delete(self._path(name, f"batch={batch}"), True)

    def read(self, name: str, schema: StructType | str) -> DataFrame:
        """The rows of all committed batches, with their ``batch``."""
        kind = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        if not self._files().exists(self._path(name)):
            return self.spark.createDataFrame([], f"{kind}, batch long")
        rows = self.spark.read.schema(f"{kind}, batch long").parquet(f"{self.root}/{name}")
        return rows.where(F.col("batch") <= self.last())


def deliver(
    entries: DataFrame, checkpoint: str, ledger: BatchLedger, handled: list[str], group: str, effect: Callable[[DataFrame], DataFrame], kind: Column, at: Column
) -> StreamingQuery:
    """Consume entries (stream, entry_id, ce, delivery_count, failed): dispatch each batch and write outcomes, effects, their outbox events and dead letters as one.

    ``effect`` makes (id, workspace_id, data) of handled entries; each effect has
    an event of ``kind``.  Entries of one (group, id) have an effect once: in a
    batch, and over batches by the ids that the ledger has.
    """

    def sinks(batch: DataFrame, number: int) -> None:
        if number <= ledger.last():
            return
        done = ledger.put("outcomes", number, streaming.dispatched(batch, handled).withColumn("consumer_group", F.lit(group)))
        before = ledger.read("claims", "consumer_group string, id string")
        fresh = done.where("outcome = 'handled'").dropDuplicates(["id"]).join(before.where(F.col("consumer_group") == group), "id", "left_anti")
        ledger.put("claims", number, fresh.select("consumer_group", "id"))
        effects = ledger.put("effects", number, effect(fresh))
        ledger.put("outbox", number, streaming.outbox_rows(effects, kind, at))
        ledger.put("letters", number, streaming.dead_letters(done, group))
        ledger.commit(number)

    return streaming.run_split(entries, checkpoint, sinks)


OUTBOX = "id string, ce string, created_at timestamp, published_at timestamp, attempts int"


def relay(ledger: BatchLedger, out: BatchLedger, send: Callable[[DataFrame], DataFrame], batch: int) -> int:
    """One cycle of a relay over a ledger's outbox: hand the oldest unpublished rows to ``send``, which returns (id, ok), and write down those before the first failure.

    Returns the number published.  What was sent and not written down when a
    cycle fails is sent again: consumers claim ids once.
    """
    number = out.last() + 1
    sent = out.read("published", "id string").select("id")
    outbox = ledger.read("outbox", OUTBOX).drop("batch")
    due = streaming.oldest_unpublished(outbox.join(sent, "id", "left_anti"), batch)
    results = out.put("results", number, send(due).select(F.col("id").cast("string"), "ok"))
    published = out.put("published", number, streaming.published_prefix(due, results, batch).select("id"))
    out.commit(number)
    return published.count()


# ---------------------------------------------------------------- a log and its consumer groups

LOG = "entry_id string, stream string, ce string"
_OUTCOMES = "entry_id string, stream string, ce string, delivery_count int, outcome string, reason string"
#: Outcomes after which an entry is not delivered again.
FINAL = ("handled", "skipped", "dead_letter")


def append_entries(log: BatchLedger, rows: DataFrame, batch: int | None = None, most: int | None = None) -> int:
    """Append rows (stream, ce) to a log as one batch; returns its number.  A batch that was appended already changes nothing.

    Entry ids are the batch's number and the row's place, so they sort in the
    order of appending.  With ``most`` the oldest whole batches go as long as at
    least that many newer entries stay.
    """
    number = log.last() + 1 if batch is None else batch
    if number <= log.last():
        return number
    name = F.format_string("%012d-%020d", F.lit(number), F.monotonically_increasing_id())
    log.put("entries", number, rows.select(name.alias("entry_id"), "stream", "ce"))
    log.commit(number)
    if most is not None:
        # a row for each batch that the log still has
        held = log.read("entries", LOG).groupBy("batch").count().orderBy(F.desc("batch")).collect()
        newer = 0
        for r in held:
            if newer >= most:
                log.drop("entries", r["batch"])
            newer += r["count"]
    return number


def log_stream(entries: DataFrame, checkpoint: str, log: BatchLedger, most: int | None = None) -> StreamingQuery:
    """A sink: append a stream (stream, ce) to a log, each micro-batch once."""
    return streaming.run_split(entries, checkpoint, lambda rows, number: append_entries(log, rows, number, most))


class ConsumerGroup:
    """A reader of a log with a place, deliveries and dead letters of its own, kept under ``root``; another object of the same root goes on where this one was."""

    def __init__(self, log: BatchLedger, root: str, group: str):
        self.log, self.group, self.state = log, group, BatchLedger(log.spark, f"{root}/{group}")

    def entries(self) -> DataFrame:
        """(entry_id, stream, ce, delivery_count, fresh) of what is to be delivered: entries whose last delivery failed, then those that the group never had.

        The group's place is the last entry that it was given, as fresh ones are
        given in order; a trimmed entry that still is to be delivered again comes
        from the group's own tables.
        """
        told = self.state.read("outcomes", _OUTCOMES)
        last = told.groupBy("entry_id").agg(
            F.max(F.col("outcome").isin(*FINAL)).alias("done"), F.count("*").cast("int").alias("n"), *[F.first(c).alias(c) for c in ("stream", "ce")]
        )
        again = last.where("NOT done").select("entry_id", "stream", "ce", (F.col("n") + 1).alias("delivery_count"), F.lit(0).alias("fresh"))
        place = told.agg(F.coalesce(F.max("entry_id"), F.lit("")).alias("place"))  # one row
        new = self.log.read("entries", LOG).drop("batch").join(F.broadcast(place), F.col("entry_id") > F.col("place"))
        return again.unionByName(new.select("entry_id", "stream", "ce", F.lit(1).alias("delivery_count"), F.lit(1).alias("fresh")))

    def cycle(self, handle: Callable[[DataFrame], DataFrame], handled: list[str], count: int, most_deliveries: int = 5) -> int:
        """Deliver the next ``count`` entries, backlog first, to ``handle``, which returns (entry_id, failed); write outcomes and dead letters as one.

        Returns the number delivered.  What was handled when a cycle dies before
        its commit is delivered again: handlers claim ids once.
        """
        number = self.state.last() + 1
        due = self.state.put("due", number, self.entries().orderBy("fresh", "entry_id").limit(count))
        done = due.join(handle(due).select("entry_id", "failed"), "entry_id", "left").withColumn("failed", F.coalesce("failed", F.lit(True)))
        told = streaming.dispatched(done, handled, most_deliveries)
        told = self.state.put("outcomes", number, told.select("entry_id", "stream", "ce", "delivery_count", "outcome", "reason"))
        self.state.put("letters", number, streaming.dead_letters(told, self.group))
        self.state.commit(number)
        return told.count()
