"""Operational metrics and alerts over job and attempt histories. Every function takes its `now`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LATENCY_BOUNDS, MAX_ATTEMPTS, RETRY_WINDOW_MICROS, SAFE_CODES

RETRYABLE = ("provider_transient", "database_transient", "storage_transient", "worker_unexpected", "attempt_timeout", "lease_expired")
TERMINAL = {"invalid_input": "terminal_input", "unsupported_input": "terminal_input", "configuration_invalid": "terminal_config", "resource_limit": "resource_limit", "vector_mismatch": "terminal_config"}


def micros(a: Column, b: Column) -> Column:
    """Microseconds from a to b."""
    return F.timestamp_diff("MICROSECOND", a, b)


def due(now: Column) -> Column:
    """Work that can be claimed: queued, or scheduled and due, with attempts left."""
    ready = (F.col("state") == "queued") | ((F.col("state") == "retry_scheduled") & (F.col("next_attempt_at") <= now))
    return ready & (F.col("attempt_count") < F.col("max_attempts"))


def claim_order() -> list[Column]:
    """Never scheduled first, then by due time, age and id."""
    return [F.asc_nulls_first("next_attempt_at"), F.asc("created_at"), F.asc("job_id")]


def attempt_latencies(attempts: DataFrame) -> DataFrame:
    """`attempts` (job_id, attempt_number, claimed_at, created_at, next_attempt_at) with latency_us.

    An attempt is eligible from the retry time that the attempt before it left, else from the job's creation.
    """
    w = Window.partitionBy("job_id").orderBy("attempt_number")
    before = F.when(F.lag("attempt_number").over(w) == F.col("attempt_number") - 1, F.lag("next_attempt_at").over(w))
    return attempts.withColumn("latency_us", F.greatest(F.lit(0), micros(F.coalesce(before, F.col("created_at")), F.col("claimed_at"))))


def histogram(rows: DataFrame, micros_column: str, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """bound, count: cumulative counts of values at most each bound (seconds), the last for all. One pass, one row a bound."""
    counts = rows.agg(*[F.count_if(F.col(micros_column) <= round(b * 1e6)).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(micros_column).alias("all"))
    pairs = [F.struct(F.lit(b).alias("bound"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)]
    return counts.select(F.explode(F.array(*pairs, F.struct(F.lit(float("inf")).alias("bound"), F.col("all").alias("count")))).alias("x")).select("x.*")


def snapshot(jobs: DataFrame, attempts: DataFrame, now: Column, window_seconds: int, cleanups: DataFrame | None = None, work: DataFrame | None = None) -> DataFrame:
    """One row of metrics: queue_depth, oldest_job_age_s, closures and retries of the window, retry_rate, recoveries.

    With `cleanups` (closed_at, disposition) also cleanup_attempts and cleanup_failures; with `work` (artifact_class, state,
    discovered_at, disposition) also orphan_discoveries and orphan_reconciliations. Each input is one scan and one
    aggregate with partial sums; retry_rate is null, not 0, without closures.
    """
    ready = due(now)
    queue = jobs.agg(F.count_if(ready).alias("queue_depth"), F.min(F.when(ready, F.col("created_at"))).alias("oldest"))
    done = queue.select("queue_depth", F.coalesce(F.greatest(F.lit(0.0), micros(F.col("oldest"), now) / 1e6), F.lit(0.0)).alias("oldest_job_age_s"))
    recent = F.col("closed_at").between(now - F.make_dt_interval(secs=F.lit(window_seconds)), now)
    closed = attempts.agg(F.count_if(recent).alias("closures"), F.count_if(recent & (F.col("closure") == "schedule_retry")).alias("retries"), F.count_if(F.col("closure") == "lease_expired").alias("recoveries"))
    done = done.crossJoin(closed).withColumn("retry_rate", F.try_divide(F.col("retries").cast("double"), F.col("closures")))
    if cleanups is not None:
        done = done.crossJoin(cleanups.agg(F.count("*").alias("cleanup_attempts"), F.count_if(F.col("closed_at").isNotNull() & (F.col("disposition") == "failed")).alias("cleanup_failures")))
    if work is not None:
        orphan, report = F.col("artifact_class") == "orphan", F.col("artifact_class") == "orphan_report"
        settled = (orphan & F.col("disposition").isin("repaired", "deleted")) | (report & (F.col("disposition") == "repaired"))
        done = done.crossJoin(work.agg(F.count_if(orphan & F.col("discovered_at").isNotNull()).alias("orphan_discoveries"), F.count_if(settled & (F.col("state") == "succeeded")).alias("orphan_reconciliations")))
    return done


def retry_decision(cause: Column, attempt: Column, max_attempts: int = MAX_ATTEMPTS, jitter: Column | None = None) -> tuple[Column, Column, Column]:
    """(decision, terminal reason, delay in microseconds): retry with full jitter within the attempt's window, exhausted, or terminal.

    `jitter`: a number in [0, 1); by default the whole window, so that checked results are deterministic.
    """
    retry = cause.isin(*RETRYABLE)
    decision = F.when(~retry, "fail_terminal").when(attempt >= max_attempts, "retry_exhausted").otherwise("schedule_retry")
    window = reduce(lambda c, kv: c.when(attempt == kv[0], F.lit(kv[1])), RETRY_WINDOW_MICROS.items(), F.when(F.lit(False), F.lit(0)))
    delay = window if jitter is None else F.floor(jitter * (window + 1)).cast("long")
    reason = reduce(lambda c, kv: c.when(cause == kv[0], F.lit(kv[1])), TERMINAL.items(), F.when(F.lit(False), F.lit("")))
    return decision, reason, F.when(decision == "schedule_retry", delay)


def failure_cause(kind: Column, code: Column) -> Column:
    """The cause that a handler's failure kind and safe code stand for; null where the code is none of the kind's."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, codes in SAFE_CODES.items() for c in codes])
    return F.when(F.exists(pairs, lambda p: (p["k"] == kind) & (p["c"] == code)), kind)


def alert_states(samples: DataFrame, threshold: float, recovery: float, sustain_seconds: int, by: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """`samples` (by, at, value) with breach_started, firing: sustained breach with hysteresis, as gaps and islands.

    A breach begins at a value at or above the threshold and lasts until a value at or below the recovery
    boundary or a missing one; in between it neither begins nor ends. It fires once it has lasted `sustain_seconds`
    and a sample at or above the threshold says so, and fires until it ends.

    A class may hold most samples, so no window runs over a whole class: samples are looked at in buckets of time, and a
    bucket gets from those before it the last edge and the start of the breach that is still on, which are a row a bucket.
    A breach is known by its start; the first sample that shows it sustained is a minimum over the breach.
    """
    edge = F.when(F.col("value").isNull() | (F.col("value") <= recovery), 0).when(F.col("value") >= threshold, 1)
    bucket = F.floor(micros(F.lit("1970-01-01").cast("timestamp_ntz"), F.col("at").cast("timestamp_ntz")) / (bucket_seconds * 1_000_000))
    rows = samples.withColumns({"__edge": edge, "__bucket": bucket})
    keyed = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]
    alike = lambda b: reduce(Column.__and__, [*keyed, F.col("__bucket") == F.col("__b")]) if b else reduce(Column.__and__, keyed)

    def carried(what: DataFrame, value: str, name: str) -> DataFrame:
        """by and bucket as __k_ and __b, with the last non-null `value` of the buckets before."""
        before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        return what.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__bucket").alias("__b"), F.last(value, ignorenulls=True).over(before).alias(name))

    last = rows.groupBy(*by, "__bucket").agg(F.max_by("__edge", F.when(F.col("__edge").isNotNull(), F.col("at"))).alias("e"))
    names = [c for c in rows.columns]
    rows = rows.join(carried(last, "e", "__before"), alike(True)).select(*names, F.coalesce("__before", F.lit(0)).alias("__before"))
    w = Window.partitionBy(*by, "__bucket").orderBy("at")
    rows = rows.withColumn("__on", F.coalesce(F.last("__edge", ignorenulls=True).over(w), "__before"))
    new = (F.col("__on") == 1) & (F.coalesce(F.lag("__on").over(w), "__before") == 0)
    rows = rows.withColumn("__new", F.when(new, F.col("at")))
    starts = rows.groupBy(*by, "__bucket").agg(F.max("__new").alias("s"))
    names = [c for c in rows.columns]
    rows = rows.join(carried(starts, "s", "__start"), alike(True)).select(*names, "__start")
    begun = F.when(F.col("__on") == 1, F.coalesce(F.last("__new", ignorenulls=True).over(w), "__start"))
    rows = rows.withColumn("breach_started", begun)
    sustained = (F.col("__edge") == 1) & (micros(F.col("breach_started"), F.col("at")) >= sustain_seconds * 1_000_000)
    hits = rows.filter(sustained).groupBy(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("breach_started").alias("__s")).agg(F.min("at").alias("__hit"))
    done = rows.join(hits, alike(False) & (F.col("breach_started") == F.col("__s")), "left")
    firing = F.coalesce((F.col("__on") == 1) & (F.col("at") >= F.col("__hit")), F.lit(False))
    return done.select(*samples.columns, "breach_started", firing.alias("firing"))
