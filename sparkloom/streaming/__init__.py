"""Event delivery: envelopes, dispatch, idempotent claims, dead letters, retention; event-time windows as an extra."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from sparkloom.operators.folds import Admission, Fold, folded

ENVELOPE = "id string, type string, workspaceid string, time string, data string"
#: Days that outbox rows, processed events and idempotency keys are kept.
RETENTION_DAYS = {"idempotency": 2, "processed": 30, "outbox": 90}


#: A fixed value: module, aggregate, event and version.
EVENT_TYPE = r"^[a-z]+\.[a-z_]+\.[a-z_]+\.v[0-9]+$"


def is_event_type(kind: Column) -> Column:
    return F.coalesce(kind.rlike(EVENT_TYPE), F.lit(False))


def envelope(event_id: Column, kind: Column, workspace: Column, at: Column, data: Column) -> Column:
    """A CloudEvents envelope as JSON, with its time in RFC 3339."""
    time = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.to_json(F.struct(event_id.alias("id"), kind.alias("type"), workspace.alias("workspaceid"), time.alias("time"), data.alias("data")))


def dispatched(entries: DataFrame, handled: list[str] | Column, most_deliveries: int = 5) -> DataFrame:
    """Append id, type, workspace, outcome and reason to entries (ce, delivery_count, failed); ``handled`` are types, or a condition on ``type``.

    Malformed or incomplete entries are dead letters, entries without a handler
    are skipped, a failure is redelivered until its last delivery; the rest is handled.
    """
    ce = F.from_json("ce", ENVELOPE, {"mode": "PERMISSIVE"})
    rows = entries.withColumn("__ce", ce).withColumns({"id": F.col("__ce.id"), "type": F.col("__ce.type"), "workspace": F.col("__ce.workspaceid")})
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    malformed = F.col("ce").isNull() | (blank("id") & blank("type") & blank("workspace"))
    incomplete = blank("type") | blank("workspace") | blank("id")
    known = F.coalesce(handled, F.lit(False)) if isinstance(handled, Column) else F.col("type").isin(*handled) if handled else F.lit(False)
    outcome = (
        F.when(malformed | incomplete, "dead_letter")
        .when(~known, "skipped")
        .when(F.col("failed") & (F.col("delivery_count") >= most_deliveries), "dead_letter")
        .when(F.col("failed"), "redeliver")
        .otherwise("handled")
    )
    reason = F.when(malformed, "malformed").when(incomplete, "incomplete").when(F.col("outcome") == "dead_letter", "retries")
    return rows.withColumn("outcome", outcome).withColumn("reason", reason).drop("__ce")


def claimed(events: DataFrame, time: str, keys: list[str], horizon: str = "30 days") -> DataFrame:
    """One event for each key: exact in a batch, within the horizon's watermark in a stream."""
    if events.isStreaming:
        return events.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def dead_letter_report(letters: DataFrame, as_of: Column) -> DataFrame:
    """Depth, oldest entry, its reason and age in seconds of each stream's dead letters."""
    return letters.groupBy("stream").agg(
        F.count("*").alias("depth"),
        F.min_by("entry_id", F.struct("at", "entry_id")).alias("oldest_id"),
        F.min_by("reason", F.struct("at", "entry_id")).alias("oldest_reason"),
        F.greatest(F.lit(0), F.unix_timestamp(as_of) - F.unix_timestamp(F.min("at"))).alias("oldest_age"),
    )


def expired(rows: DataFrame, at: str, days: int, as_of: Column) -> DataFrame:
    """Rows older than the cutoff, the ones that a sweep deletes; rows without a time (unpublished) stay."""
    return rows.where(F.col(at) < as_of - F.make_dt_interval(days=F.lit(days)))


def outbox_rows(effects: DataFrame, kind: Column, at: Column) -> DataFrame:
    """An unpublished outbox row for each effect (id, workspace_id, data), to be written in the effect's own batch."""
    ce = envelope(F.col("id"), kind, F.col("workspace_id"), at, F.col("data"))
    return effects.select("id", ce.alias("ce"), at.alias("created_at"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(0).alias("attempts"))


def oldest_unpublished(outbox: DataFrame, batch: int) -> DataFrame:
    return outbox.where("published_at IS NULL").orderBy("created_at", "id").limit(batch)


def relayed(outbox: DataFrame, results: DataFrame, batch: int, at: Column) -> DataFrame:
    """The outbox after a relay's cycle over its oldest unpublished rows.

    Rows before the first failure are published; the failed one's attempts are
    counted up; those behind it stay as they are for the next cycle.
    """
    due = oldest_unpublished(outbox, batch).select("id", F.struct("created_at", "id").alias("__place"))
    tried = due.join(results.select("id", F.col("ok").alias("__ok")), "id", "left").withColumn("__ok", F.coalesce("__ok", F.lit(False)))
    stop = tried.where(~F.col("__ok")).agg(F.min("__place").alias("__stop"))  # one row
    judged = tried.crossJoin(F.broadcast(stop)).select(
        "id", (F.col("__stop").isNull() | (F.col("__place") < F.col("__stop"))).alias("__sent"), F.coalesce(F.col("__place") == F.col("__stop"), F.lit(False)).alias("__failed")
    )
    rows = outbox.join(judged, "id", "left")
    failed = F.coalesce(F.col("__failed"), F.lit(False)).cast("int")
    return rows.withColumns({"published_at": F.when(F.col("__sent"), at).otherwise(F.col("published_at")), "attempts": F.col("attempts") + failed}).drop("__sent", "__failed")


def published_prefix(outbox: DataFrame, results: DataFrame, batch: int) -> DataFrame:
    """The rows that a relay's cycle publishes: of the oldest unpublished ones those before the first failure."""
    sent = relayed(outbox.withColumn("attempts", F.lit(0)), results, batch, F.current_timestamp()).where("published_at IS NOT NULL").select("id")
    return outbox.where("published_at IS NULL").join(sent, "id", "left_semi")


def delivered(entries: DataFrame, acks: DataFrame, keys: list[str]) -> DataFrame:
    """Deliveries of each entry and whether it is still pending; ``entries`` has a row for each delivery (keys, at), ``acks`` one for each acknowledgement."""
    counts = entries.groupBy(*keys).agg(F.count("*").alias("deliveries"), F.max("at").alias("last_at"))
    return counts.join(acks.select(*keys).distinct().withColumn("__done", F.lit(True)), keys, "left").select(
        *keys, "deliveries", "last_at", F.col("__done").isNull().alias("pending")
    )


def next_reads(entries: DataFrame, deliveries: DataFrame, consumer: str, group_keys: list[str], count: int) -> DataFrame:
    """A consumer's next entries: its own backlog first, then fresh ones that no consumer of the group has had.

    ``entries`` has stream and entry_id; ``deliveries`` has group_keys, entry_id, consumer and pending.
    """
    own = deliveries.where((F.col("consumer") == consumer) & F.col("pending")).select(*group_keys, "entry_id", F.lit(0).alias("fresh"))
    new = entries.join(deliveries.select(*group_keys, "entry_id").distinct(), [*group_keys, "entry_id"], "left_anti").select(*group_keys, "entry_id", F.lit(1).alias("fresh"))
    return own.unionByName(new).orderBy("fresh", "entry_id").limit(count)


def dead_letters(dispatched_rows: DataFrame, group: str) -> DataFrame:
    """The dead letters of dispatched entries (stream, entry_id, ce, reason, delivery_count)."""
    return dispatched_rows.where("outcome = 'dead_letter'").select(
        F.concat("stream", F.lit(".dlq")).alias("stream"), F.col("stream").alias("source_stream"), F.col("entry_id").alias("source_id"),
        F.lit(group).alias("consumer_group"), "ce", "reason", F.col("delivery_count").alias("deliveries"),
    )


def peeked(letters: DataFrame, count: int) -> DataFrame:
    """The oldest letters of each stream; nothing moves."""
    rank = F.row_number().over(Window.partitionBy("stream").orderBy("entry_id"))
    return letters.withColumn("__n", rank).where(F.col("__n") <= count).drop("__n")


def requeued(letters: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries to append to the source stream, refused letters): a letter without an envelope has nothing to give back. Letters stay until purged."""
    asked = letters.join(wanted, ["stream", "entry_id"], "left_semi")
    return asked.where("ce IS NOT NULL").select(F.regexp_replace("stream", r"\.dlq$", "").alias("stream"), "ce"), asked.where("ce IS NULL")


def purged(letters: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining letters, one row with the number deleted)."""
    keys = ["stream", "entry_id"]
    return letters.join(wanted, keys, "left_anti"), letters.join(wanted, keys, "left_semi").agg(F.count("*").alias("deleted"))


def swept_consumers(consumers: DataFrame, live: str, least_idle: int) -> DataFrame:
    """Append ``outcome`` to consumers (stream, group, name, pending, idle_ms, reclaimed): kept, refused or deleted.

    The sweeper's own consumer and those that aren't idle long enough stay.
    Pending entries are reclaimed first, and a consumer that still has some stays.
    """
    stays = (F.col("name") == live) | (F.col("idle_ms") < least_idle)
    left = F.greatest(F.lit(0), F.col("pending") - F.coalesce("reclaimed", F.lit(0)))
    return consumers.withColumn("outcome", F.when(stays, "kept").when(left > 0, "refused").otherwise("deleted"))


def orphan_groups(first: DataFrame, second: DataFrame) -> DataFrame:
    """Groups (stream, name, consumers, pending, alive) that two readings both find without consumers, pending entries or a live process."""
    idle = "consumers = 0 AND pending = 0 AND NOT alive"
    keys = ["stream", "name"]
    return first.where(idle).select(*keys).join(second.where(idle).select(*keys), keys, "left_semi")


def trimmed(entries: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` entries of each stream."""
    rank = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("entry_id")))
    return entries.withColumn("__n", rank).where(F.col("__n") <= most).drop("__n")


#: The events that sessions hear of.
NOTIFIED = (
    "knowledge.document.indexed.v1", "knowledge.document.indexing_failed.v1", "media.job.generated.v1", "media.job.failed.v1",
)


def notified(events: DataFrame, sessions: DataFrame, kinds: tuple[str, ...] = NOTIFIED) -> DataFrame:
    """A row for each session of the workspace of an event that sessions hear of."""
    return events.where(F.col("type").isin(*kinds)).join(sessions, "workspace_id")


def admissions(attempts: DataFrame, key: str, at: str, order: list[str], ttl: int, most: int) -> DataFrame:
    """Append ``admitted`` to connection attempts: one is admitted while fewer than ``most`` admitted within ``ttl`` seconds before it are held.

    Whether an attempt counts depends on those before it, so a key's attempts are
    folded in order; the state is the times of at most ``most`` admissions.  For
    a stream see ``stateful.admission_stream``.
    """
    micros = attempts.withColumn("__micros", F.unix_micros(F.col(at).cast("timestamp")))
    fold = Fold("admitted", T.BooleanType(), ("__micros",), lambda: Admission(ttl * 1_000_000, most))
    return folded(micros, [key], ["__micros", *order], [fold]).drop("__micros")


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; late rows are dropped in a stream."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, size, slide), *keys).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts by session: events of a key that follow each other within ``gap``; late rows are dropped in a stream."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap).alias("session"), *keys).agg(F.count("*").alias("n"))


def outcome_gauges(dispatched_rows: DataFrame, name: str = "outcomes") -> DataFrame:
    """Dispatched rows whose counts by outcome, and oldest time, are told while they pass, to a ``Gauges`` or an ``Observation`` of that name: no second scan."""
    counts = [F.count_if(F.col("outcome") == kind).alias(kind) for kind in ("handled", "skipped", "redeliver", "dead_letter")]
    return dispatched_rows.observe(name, F.count("*").alias("depth"), *counts)


class Gauges(StreamingQueryListener):
    """Sums of what a session's streams observe under one name, batch by batch."""

    def __init__(self, name: str = "outcomes"):
        super().__init__()
        self.name, self.totals = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics.get(self.name)
        for key, value in (told.asDict() if told else {}).items():
            self.totals[key] = self.totals.get(key, 0) + value

    def onQueryTerminated(self, event) -> None:
        pass


def run_split(stream: DataFrame, checkpoint: str, sinks: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run a stream over what is there, handing each micro-batch and its number to ``sinks``."""
    return stream.writeStream.foreachBatch(sinks).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
