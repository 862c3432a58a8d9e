"""Live forms of the work queue and the alerts on Structured Streaming state.

A processor keeps one small state per key and folds events into it in order; leases and sustained breaches end
by timers. Replayed over a finished stream the results equal the batch folds in citeloom.operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.versions import shared_folder

WORK_STATE = "failures long, n_events long, last string, lease_until long"
WORK_OUT = "work_id long, failures long, n_events long, state string, batch_time long"
KINDS = {"signup": "enqueued", "view": "claimed", "purchase": "done", "error": "failed", "click": "suppressed"}


def state_name(failures: int, last: str) -> str:
    if last == "done":
        return "completed"
    if last == "suppressed":
        return "suppressed"
    if failures >= 4:
        return "exhausted"
    return "processing" if last == "claimed" else "pending"


class WorkQueue(StatefulProcessor):
    """work_id -> folded state; with `lease_ms` a claim sets a lease whose timer returns the work to pending.

    Leases need the time mode ProcessingTime, and a query that goes on running: a replay of the past has none.
    """

    def __init__(self, lease_ms: int | None = 120_000) -> None:
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("work", WORK_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, n, last, _ = self.state.get() or (0, 0, "", 0)
        failures, n, newest = int(failures), int(n), None
        now = timerValues.getCurrentProcessingTimeInMs() if self.lease_ms else 0
        for f in rows:  # frames come in no order; what is kept of each is its counts and its newest event
            failures, n = failures + int((f["kind"] == "failed").sum()), n + len(f)
            at, seq, kind = f[["at", "seq", "kind"]].sort_values(["at", "seq"]).iloc[-1]
            newest = max(newest, (at, seq, str(kind))) if newest else (at, seq, str(kind))
        last = newest[2]
        lease = 0
        if last == "claimed" and self.lease_ms:
            lease = now + self.lease_ms
            self.handle.registerTimer(lease)
        self.state.update((failures, n, last, lease))
        yield pd.DataFrame({"work_id": [key[0]], "failures": [failures], "n_events": [n], "state": [state_name(failures, last)], "batch_time": [int(now)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if held and held[2] == "claimed" and held[3] <= due:  # a later heartbeat would have moved the lease
            self.state.update((held[0], held[1], "enqueued", 0))
            yield pd.DataFrame({"work_id": [key[0]], "failures": [held[0]], "n_events": [held[1]], "state": ["pending"], "batch_time": [int(due)]})

    def close(self) -> None:
        pass


ALERT_STATE = "breach_ms long, firing boolean"
ALERT_OUT = "alert string, at_ms long, seq long, breach_ms long, firing boolean"


class Alerts(StatefulProcessor):
    """Alert class -> breach start and whether it fires, with hysteresis."""

    def __init__(self, threshold: float, recovery: float, sustain_ms: int) -> None:
        self.threshold, self.recovery, self.sustain_ms = threshold, recovery, sustain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", ALERT_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        breach, firing = (int(held[0]), bool(held[1])) if held else (-1, False)
        out = []
        for e in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples():
            at = int(e.at.value // 1_000_000)
            if pd.isna(e.value) or e.value <= self.recovery:
                breach, firing = -1, False
            elif e.value >= self.threshold:
                breach = at if breach < 0 else breach
                firing = firing or at - breach >= self.sustain_ms
            out.append((key[0], at, e.seq, breach, firing))
        self.state.update((breach, firing))
        yield pd.DataFrame(out, columns=["alert", "at_ms", "seq", "breach_ms", "firing"])

    def close(self) -> None:
        pass


def replay(rows: DataFrame, schema: str) -> DataFrame:
    """Run a stream to the end of its present input and return what it appended."""
    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(schema).parquet(f"{base}/out")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work states after replaying all events as a stream; equals the batch fold `lifecycle_states`."""
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    e = event_stream(spark, sf_dir).select(F.col("user_id").alias("work_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.element_at(kinds, F.col("event_type")).alias("kind"))
    states = e.groupBy("work_id").transformWithStateInPandas(WorkQueue(None), WORK_OUT, "Append", "None")
    done = replay(states, WORK_OUT)
    return done.groupBy("work_id").agg(F.max_by(F.struct("failures", "state"), F.struct("n_events", "batch_time")).alias("s"), F.max("n_events").alias("n_events")).select("work_id", "s.failures", "n_events", "s.state")


def alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert states after replaying all events as a stream; equals the batch form `alert_islands`."""
    e = event_stream(spark, sf_dir).select(F.col("event_type").alias("alert"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), "value")
    out = e.groupBy("alert").transformWithStateInPandas(Alerts(60.0, 30.0, 3_600_000), ALERT_OUT, "Append", "None")
    return replay(out, ALERT_OUT).select(F.col("seq").alias("event_id"), "firing")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Closed windows of event counts by type; late events are dropped after `late`. Batch or stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))


QUERIES = {f.__name__: f for f in (queue_stream, alert_stream, hourly_counts)}
