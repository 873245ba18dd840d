"""Keyed state over a stream of events: a session's quota, a job's status and the cursor of its event log.

One processor keeps, for each key, a counter, a status and the ids it has seen, each with a time to live, and gives a
row for each new event. An event that comes again changes nothing while its id is remembered; one that
comes late counts when it comes, but does not replace a later event's status. A key's rows of a micro-batch are taken in the
order of (ts, event_id), so a stream that arrives in order gives what the batch queries give. A key's events go through one task, as its state
is sequential; the state is a few values and the ids of one time to live.

Defined results: an event without a key or an id is dropped; a null time is before all others; after the time to live a key begins anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SCHEMA = "user_id long, event_id long, n long, used long, allowed boolean, status string, errors long"
_COUNTS = "n long, used long, errors long"
_LAST = "ts double, event_id long, status string"


class SessionProcessor(StatefulProcessor):
    """n is the event's place in the key's log (the cursor that a reader keeps), used the questions of the session so far."""

    def __init__(self, limit: int, ttl_ms: int | None):
        self.limit, self.ttl_ms = limit, ttl_ms

    def init(self, handle) -> None:
        self.counts = handle.getValueState("counts", _COUNTS, self.ttl_ms)
        self.last = handle.getValueState("last", _LAST, self.ttl_ms)
        self.seen = handle.getMapState("seen", "event_id long", "yes boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        n, used, errors = self.counts.get() or (0, 0, 0)
        last = self.last.get() or (None, None, None)
        place = lambda ts, event: (ts is not None, ts or 0.0, event)
        some = False
        for r in sorted(rows, key=lambda r: place(r.ts, r.event_id)):
            if self.seen.containsKey((r.event_id,)):
                continue
            self.seen.updateValue((r.event_id,), (True,))
            some = True
            error = r.event_type == "error"
            n, used, errors = n + 1, used + (not error), errors + error
            if last[1] is None or place(r.ts, r.event_id) >= place(last[0], last[1]):
                last = (r.ts, r.event_id, r.event_type)
            yield Row(user_id=key[0], event_id=r.event_id, n=n, used=used, allowed=used <= self.limit and not error, status=last[2], errors=errors)
        if some:
            self.counts.update((n, used, errors))
            self.last.update(last)

    def close(self) -> None:
        pass


def sessions(events: DataFrame, limit: int = 25, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """A row of SCHEMA for each new event of the stream (user_id, event_id, ts, event_type), in append mode. The state store must be the one on disk
    (``use_disk_state``)."""
    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"), "event_type")
    rows = rows.filter("user_id is not null and event_id is not null")
    return rows.groupBy("user_id").transformWithState(statefulProcessor=SessionProcessor(limit, ttl_ms), outputStructType=SCHEMA, outputMode="append", timeMode="processingTime" if ttl_ms else "none")


def use_disk_state(spark) -> None:
    """State that is kept on the executors' disks and in the checkpoint, not in the heap; ``transformWithState`` asks for it. State with a time to live
    would have empty micro-batches run without end, so those are off; what has expired goes with the next events."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def quota(state: DataFrame) -> DataFrame:
    return state.select("user_id", "event_id", "used", "allowed")


def tail(state: DataFrame, after: int) -> DataFrame:
    """The events behind a reader's cursor."""
    return state.filter(F.col("n") > after).select("user_id", "event_id", "n")


def status(state: DataFrame) -> DataFrame:
    """The newest row of each key: its status and number of errors."""
    return state.groupBy("user_id").agg(F.max_by("status", "n").alias("status"), F.max("errors").alias("errors"))
