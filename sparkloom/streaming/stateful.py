"""Delivery with state per key in a stream: counts of deliveries, and expiring admissions.

The processors keep their state in the stream's state store, under its
checkpoint, so a stream that is started again goes on where it was.  A state is
a few numbers for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.operators.folds import Admission

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COUNT = T.StructType([T.StructField("deliveries", T.LongType()), T.StructField("last_at", T.TimestampType()), T.StructField("pending", T.BooleanType())])


def keep_state(df: DataFrame) -> None:
    """State variables need the RocksDB store; set in the stream's session before it starts."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


class _Deliveries(StatefulProcessor):
    """How often an entry was delivered, when last, and whether it is still without an acknowledgement."""

    def __init__(self, keys: list[str], kinds: list[str]):
        self.keys, self.kinds = keys, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("count", _COUNT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, last, pending = self.state.get() if self.state.exists() else (0, None, True)
        for some in rows:
            delivered = some[~some["ack"].astype(bool)]
            count += len(delivered)
            newest = delivered["at"].max()
            if not pd.isna(newest):
                newest = newest.to_pydatetime()
                last = newest if last is None else max(last, newest)
            pending = pending and not some["ack"].astype(bool).any()
        self.state.update((count, last, pending))
        if count:
            out = dict(zip(self.keys, ([k] for k in key), strict=True))
            yield pd.DataFrame(out | {"deliveries": [count], "last_at": [last], "pending": [pending]})

    def close(self) -> None:
        pass


def delivery_stream(entries: DataFrame, keys: list[str]) -> DataFrame:
    """``delivered`` as a stream: of entries (keys, at, ack), a row for each delivery and each acknowledgement, the state of each entry that a batch changes.

    An acknowledgement may come before a delivery that is seen late; an entry
    that was never delivered has no row.
    """
    keep_state(entries)
    kinds = [entries.schema[k].dataType for k in keys]
    schema = T.StructType([T.StructField(k, t) for k, t in zip(keys, kinds, strict=True)] + _COUNT.fields)
    rows = entries.select(*keys, F.col("at").cast("timestamp").alias("at"), F.coalesce("ack", F.lit(False)).alias("ack"))
    return rows.groupBy(*keys).transformWithStateInPandas(_Deliveries(keys, [t.simpleString() for t in kinds]), schema, outputMode="Update", timeMode="None")


class _Admissions(StatefulProcessor):
    """The times of admissions that are held, ``most`` at most; a timer lets them go when the watermark has passed the last one's end."""

    def __init__(self, key: str, order: list[str], ttl: int, most: int):
        self.key, self.order, self.ttl, self.most = key, order, ttl * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", T.StructType([T.StructField("micros", T.LongType())]))

    def _keep(self, held: list[int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.held.put([(t,) for t in held])
            self.handle.registerTimer((max(held) + self.ttl) // 1000 + 1)
        else:
            self.held.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows)).sort_values(["micros", *self.order], kind="stable")
        admit = Admission(self.ttl, self.most, [t for (t,) in self.held.get()] if self.held.exists() else [])
        said = [admit(int(t)) for t in some["micros"]]
        self._keep(admit.held)
        yield some[[self.key, *self.order]].assign(admitted=said)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self._keep([t for (t,) in self.held.get() if t + self.ttl > now] if self.held.exists() else [])
        yield from ()

    def close(self) -> None:
        pass


def admission_stream(attempts: DataFrame, key: str, at: str, order: list[str], ttl: int, most: int, late: str = "0 seconds") -> DataFrame:
    """``admissions`` as a stream: (key, order, admitted) of attempts that come in the order of their time, but for ``late``.

    Attempts of a batch are taken in order; one behind the watermark is dropped.
    """
    keep_state(attempts)
    rows = attempts.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    rows = rows.select(key, *order, F.unix_micros("__at").alias("micros"), "__at")
    schema = T.StructType([attempts.schema[c] for c in (key, *order)] + [T.StructField("admitted", T.BooleanType())])
    return rows.groupBy(key).transformWithStateInPandas(_Admissions(key, order, ttl, most), schema, outputMode="Append", timeMode="EventTime")
