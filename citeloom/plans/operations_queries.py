"""Operational metrics, queue states and reconciliation over the event and order tables.

Events are attempts: a user is a job, ts and event_id order its attempts, the type is the outcome (view: claimed,
purchase: succeeded, error: scheduled for retry, click: lease expired, signup: submitted). `now` is the last event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lifecycle as li
from ..operators import operations as op
from ..sources.files import table

WINDOW_S = 86_400
THRESHOLD, RECOVERY, SUSTAIN_S = 60.0, 30.0, 3600


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, attempt_number, claimed_at, created_at, next_attempt_at, closed_at, closure."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("job_id"), "event_id", F.row_number().over(w).alias("attempt_number"), F.col("ts").alias("claimed_at"), F.min("ts").over(Window.partitionBy("user_id")).alias("created_at"), F.col("ts").alias("closed_at"), "event_type")
    closure = F.when(F.col("event_type") == "error", "schedule_retry").when(F.col("event_type") == "click", "lease_expired").otherwise("closed")
    retry = F.when(F.col("event_type") == "error", F.col("closed_at") + F.expr("INTERVAL 30 SECONDS"))
    return rows.withColumn("closure", closure).withColumn("next_attempt_at", retry)


_ATTEMPTS = """
a AS (
  SELECT user_id AS job_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt_number, ts AS claimed_at,
    min(ts) OVER (PARTITION BY user_id) AS created_at, ts AS closed_at, event_type,
    CASE event_type WHEN 'error' THEN 'schedule_retry' WHEN 'click' THEN 'lease_expired' ELSE 'closed' END AS closure,
    CASE WHEN event_type = 'error' THEN ts + INTERVAL 30 SECONDS END AS next_attempt_at
  FROM events),
now AS (SELECT max(ts) AS now FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state each job's last attempt left it in."""
    last = attempts(spark, sf_dir).groupBy("job_id").agg(F.max_by(F.struct("event_type", "closed_at", "next_attempt_at"), "attempt_number").alias("l"), F.count("*").alias("attempts"), F.min("created_at").alias("created_at"))
    kind = F.col("l.event_type")
    state = F.when(kind == "signup", "queued").when(kind == "error", "retry_scheduled").when(kind == "purchase", "succeeded").otherwise("processing")
    return last.select("job_id", (F.col("job_id") % 10).alias("workspace_id"), state.alias("state"), "created_at", F.col("l.next_attempt_at").alias("next_attempt_at"), (F.col("attempts") % 4).cast("int").alias("attempt_count"), F.lit(4).alias("max_attempts"), F.lit(0).alias("fence"), F.when(state == "processing", F.col("l.closed_at") + F.expr("INTERVAL 2 MINUTES")).alias("lease_until"))


_JOBS = _ATTEMPTS + """,
j AS (
  SELECT job_id, job_id % 10 AS workspace_id,
    CASE arg_max(event_type, attempt_number) WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'retry_scheduled' WHEN 'purchase' THEN 'succeeded' ELSE 'processing' END AS state,
    min(created_at) AS created_at, arg_max_null(next_attempt_at, attempt_number) AS next_attempt_at, count(*) % 4 AS attempt_count,
    CASE WHEN arg_max(event_type, attempt_number) IN ('view', 'click') THEN max(closed_at) + INTERVAL 2 MINUTES END AS lease_until
  FROM a GROUP BY job_id),
due AS (SELECT * FROM j, now WHERE (state = 'queued' OR (state = 'retry_scheduled' AND next_attempt_at <= now)) AND attempt_count < 4)"""


def now_of(spark: SparkSession, sf_dir: str) -> Column:
    """The last event's time as a literal: one value is read."""
    return F.lit(table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


def ops_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric snapshot at the last event, orders read as cleanups and parts as lifecycle work."""
    cleanups = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("closed_at"), F.when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("succeeded").alias("disposition"))
    k = F.col("p_partkey")
    work = table(spark, sf_dir, "part").select(
        F.when(k % 3 == 0, "orphan").when(k % 3 == 1, "orphan_report").otherwise("chunk").alias("artifact_class"),
        F.when(k % 4 == 0, "queued").otherwise("succeeded").alias("state"),
        F.when(k % 5 > 0, k).alias("discovered_at"),
        F.when(k % 7 < 2, "repaired").when(k % 7 < 4, "deleted").when(k % 7 < 5, "reported").alias("disposition"),
    )
    done = op.snapshot(jobs(spark, sf_dir), attempts(spark, sf_dir), now_of(spark, sf_dir), WINDOW_S, cleanups, work)
    return done.withColumn("oldest_job_age_s", F.round("oldest_job_age_s", 6)).withColumn("retry_rate", F.round("retry_rate", 9))


SNAPSHOT_SQL = "WITH " + _JOBS + """,
q AS (SELECT count(*) AS queue_depth, round(coalesce(greatest(0, date_diff('microsecond', min(created_at), any_value(now)) / 1e6), 0), 6) AS oldest_job_age_s FROM due),
c AS (SELECT count_if(closed_at BETWEEN now - INTERVAL 86400 SECONDS AND now)::BIGINT AS closures, count_if(closed_at BETWEEN now - INTERVAL 86400 SECONDS AND now AND closure = 'schedule_retry')::BIGINT AS retries, count_if(closure = 'lease_expired')::BIGINT AS recoveries FROM a, now),
k AS (SELECT count(*) AS cleanup_attempts, count_if(o_orderstatus = 'F' AND o_orderkey % 3 = 0)::BIGINT AS cleanup_failures FROM orders),
w AS (SELECT count_if(p_partkey % 3 = 0 AND p_partkey % 5 > 0)::BIGINT AS orphan_discoveries,
  count_if(p_partkey % 4 <> 0 AND ((p_partkey % 3 = 0 AND p_partkey % 7 < 4) OR (p_partkey % 3 = 1 AND p_partkey % 7 < 2)))::BIGINT AS orphan_reconciliations FROM part)
SELECT *, round(retries / nullif(closures, 0), 9) AS retry_rate FROM q, c, k, w"""


def claim_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and claim latency of every job, in microseconds."""
    rows = op.attempt_latencies(attempts(spark, sf_dir))
    return rows.groupBy("job_id").agg(F.count("*").alias("n"), F.sum("latency_us").alias("total_us"), F.max("latency_us").alias("most_us"))


_LATENCY = "WITH " + _ATTEMPTS + """,
l AS (SELECT *, greatest(0, date_diff('microsecond', coalesce(lag(next_attempt_at) OVER (PARTITION BY job_id ORDER BY attempt_number), created_at), claimed_at)) AS latency_us FROM a)"""


def claim_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cumulative latency histogram over all attempts."""
    return op.histogram(op.attempt_latencies(attempts(spark, sf_dir)), "latency_us").withColumn("bound", F.col("bound").cast("string"))


HISTOGRAM_SQL = _LATENCY + ", b AS (SELECT unnest([0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 'inf'::DOUBLE]) AS bound) SELECT CASE WHEN isinf(bound) THEN 'Infinity' ELSE CAST(bound::DOUBLE AS VARCHAR) END AS bound, CAST(count_if(isinf(bound) OR latency_us <= bound * 1000000) AS BIGINT) AS count FROM l, b GROUP BY ALL"


CAUSES = {"error": "provider_transient", "click": "lease_expired", "view": "invalid_input", "signup": "resource_limit", "purchase": "configuration_invalid"}


def _cause(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CAUSES.items() for x in kv]), kind)


def retry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retry policy's decision on every attempt, its type read as a cause."""
    rows = attempts(spark, sf_dir).withColumn("attempt", (F.col("attempt_number") - 1) % 4 + 1)
    decision, reason, delay = op.retry_decision(_cause(F.col("event_type")), F.col("attempt"))
    return rows.select("event_id", decision.alias("decision"), reason.alias("reason"), delay.cast("long").alias("delay_us"))


RETRY_SQL = "WITH " + _ATTEMPTS + """,
r AS (SELECT event_id, event_type, (attempt_number - 1) % 4 + 1 AS n FROM a)
SELECT event_id, CASE WHEN event_type NOT IN ('error', 'click') THEN 'fail_terminal' WHEN n >= 4 THEN 'retry_exhausted' ELSE 'schedule_retry' END AS decision,
  CASE event_type WHEN 'view' THEN 'terminal_input' WHEN 'signup' THEN 'resource_limit' WHEN 'purchase' THEN 'terminal_config' END AS reason,
  CAST(CASE WHEN event_type IN ('error', 'click') THEN CASE n WHEN 1 THEN 5000000 WHEN 2 THEN 30000000 WHEN 3 THEN 120000000 END END AS BIGINT) AS delay_us FROM r"""


def due_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due jobs in claim order, by workspace."""
    w = Window.partitionBy("workspace_id").orderBy(*op.claim_order())
    return jobs(spark, sf_dir).filter(op.due(now_of(spark, sf_dir))).select("workspace_id", "job_id", "state", F.row_number().over(w).cast("long").alias("place"))


def claim_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs after one claim a workspace."""
    rows = li.claim(jobs(spark, sf_dir), now_of(spark, sf_dir), 120)
    return rows.select("job_id", "state", F.col("attempt_count").cast("long").alias("attempt_count"), F.col("fence").cast("long").alias("fence"), F.unix_micros(F.col("lease_until").cast("timestamp")).alias("lease_until_us"))


CLAIM_SQL = "WITH " + _JOBS + """,
t AS (SELECT job_id FROM due QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY next_attempt_at NULLS FIRST, created_at, job_id) = 1)
SELECT j.job_id, CASE WHEN t.job_id IS NOT NULL THEN 'processing' ELSE state END AS state, attempt_count + CASE WHEN t.job_id IS NOT NULL THEN 1 ELSE 0 END AS attempt_count,
  CAST(CASE WHEN t.job_id IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS fence, epoch_us(CASE WHEN t.job_id IS NOT NULL THEN now + INTERVAL 120 SECONDS ELSE lease_until END) AS lease_until_us
FROM j CROSS JOIN now LEFT JOIN t ON t.job_id = j.job_id"""


def expired_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose lease has run out at the last event and what becomes of them."""
    rows = li.recover_expired(jobs(spark, sf_dir), now_of(spark, sf_dir))
    return rows.select("job_id", F.col("attempt_count").cast("long").alias("attempt_count"), "state", F.col("delay_us").cast("long").alias("delay_us"), "overdue_us")


EXPIRED_SQL = "WITH " + _JOBS + """
SELECT job_id, attempt_count, CASE WHEN attempt_count >= 4 THEN 'failed' ELSE 'retry_scheduled' END AS state,
  CAST(CASE attempt_count WHEN 1 THEN 5000000 WHEN 2 THEN 30000000 WHEN 3 THEN 120000000 END AS BIGINT) AS delay_us, date_diff('microsecond', lease_until, now) AS overdue_us
FROM j, now WHERE state = 'processing' AND lease_until <= now"""


def heartbeat_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leases after beats in mid-January from two thirds of the jobs, half of them with a stale fence."""
    held = jobs(spark, sf_dir)
    beats = held.filter("job_id % 3 <> 0").select("job_id", (F.col("job_id") % 2).cast("int").alias("fence"))
    rows = li.heartbeat(held, beats, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 86_400)
    return rows.select("job_id", "state", F.unix_micros(F.col("lease_until").cast("timestamp")).alias("lease_until_us"))


HEARTBEAT_SQL = "WITH " + _JOBS + """
SELECT job_id, state, epoch_us(CASE WHEN state = 'processing' AND job_id % 3 <> 0 AND job_id % 2 = 0 AND lease_until > TIMESTAMP '2024-01-15'
  THEN greatest(lease_until, TIMESTAMP '2024-01-16') ELSE lease_until END) AS lease_until_us FROM j"""


def finalize_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a result of every job: half hold a stale fence, nations hold the documents' current versions."""
    held = jobs(spark, sf_dir)
    results = held.select("job_id", (F.col("job_id") % 2).alias("fence"), (F.col("job_id") % 50).alias("document_id"), (F.col("job_id") % 3).alias("target_version"))
    current = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("document_id"), (F.col("n_regionkey") % 3).cast("long").alias("current_version"))
    return li.finalize(held, results, current)


FINALIZE_SQL = "WITH " + _JOBS + """
SELECT job_id, CASE WHEN job_id % 2 <> 0 OR state <> 'processing' THEN 'stale' WHEN job_id % 3 IS DISTINCT FROM n_regionkey % 3 THEN 'superseded' ELSE 'succeeded' END AS outcome
FROM j LEFT JOIN nation ON n_nationkey = job_id % 50"""


def job_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by state, those with a lease, with a retry time and over budget, and breaches of what the state demands."""
    state, lease, retry = F.col("state"), F.col("lease_until").isNotNull(), F.col("next_attempt_at").isNotNull()
    breach = ((state == "processing") != lease) | ((state == "retry_scheduled") != retry) | (F.col("attempt_count") > F.col("max_attempts"))
    return jobs(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.count_if(lease).alias("leased"), F.count_if(retry).alias("retrying"), F.count_if(F.col("attempt_count") == 0).alias("fresh"), F.count_if(breach).alias("breaches"))


MATRIX_SQL = "WITH " + _JOBS + """
SELECT state, count(*) AS n, CAST(count_if(lease_until IS NOT NULL) AS BIGINT) AS leased, CAST(count_if(next_attempt_at IS NOT NULL) AS BIGINT) AS retrying,
  CAST(count_if(attempt_count = 0) AS BIGINT) AS fresh,
  CAST(count_if(((state = 'processing') <> (lease_until IS NOT NULL)) OR ((state = 'retry_scheduled') <> (next_attempt_at IS NOT NULL)) OR attempt_count > 4) AS BIGINT) AS breaches
FROM j GROUP BY state"""


def replacement_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every finished order the earliest open one of its customer."""
    o = table(spark, sf_dir, "orders")
    first = o.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("replacement"))
    return o.filter("o_orderstatus = 'F'").join(first, "o_custkey", "left").select("o_orderkey", "replacement")


REPLACEMENT_SQL = """
WITH f AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS replacement FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT o_orderkey, replacement FROM orders LEFT JOIN f USING (o_custkey) WHERE o_orderstatus = 'F'"""


def job_status_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public status of every order: masked failure, serving state, polling hint."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left")
    state = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    serving = F.when(F.col("c_custkey").isNull(), "unavailable").when(state == "succeeded", "current").otherwise("previous")
    reason = F.when(F.col("o_orderpriority").rlike("^[0-9]-[A-Z]+$"), F.col("o_orderpriority")).otherwise("internal")
    return rows.select("o_orderkey", state.alias("state"), serving.alias("serving"), reason.alias("reason"), F.when(state.isin("queued", "processing"), 5).otherwise(0).cast("long").alias("poll_after_s"))


STATUS_SQL = """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE 'processing' END AS state,
  CASE WHEN c_custkey IS NULL THEN 'unavailable' WHEN o_orderstatus = 'F' THEN 'current' ELSE 'previous' END AS serving,
  CASE WHEN regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+$') THEN o_orderpriority ELSE 'internal' END AS reason,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 5 END AS BIGINT) AS poll_after_s
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""


def version_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next number of every customer (one above its highest order key, 1 without any), with the earliest and latest order."""
    o = table(spark, sf_dir, "orders")
    order = F.struct("o_orderdate", "o_orderkey")
    held = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("highest"), F.min_by("o_orderkey", order).alias("earliest"), F.max_by("o_orderkey", order).alias("latest"))
    rows = table(spark, sf_dir, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", (F.coalesce("highest", F.lit(0)) + 1).cast("long").alias("next_version"), "earliest", "latest")


VERSION_SQL = """
WITH h AS (SELECT o_custkey, max(o_orderkey) AS highest, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS earliest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey)
SELECT c_custkey, CAST(coalesce(highest, 0) + 1 AS BIGINT) AS next_version, earliest, latest FROM customer LEFT JOIN h ON o_custkey = c_custkey"""


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.lit("w").alias("workspace_id"), F.col("doc_id").alias("object_key"))


BASE_S, SPAN_S = 1_700_000_000, 200_000


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored objects, made at times spread over the span whatever their number."""
    at = F.timestamp_seconds(F.lit(BASE_S) + F.pmod(F.col("doc_id") * 7919, F.lit(SPAN_S)))
    return table(spark, sf_dir, "documents").select(F.lit("w").alias("workspace_id"), F.col("doc_id").alias("object_key"), at.alias("created_at"), "n_chars")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label refers to, older than a day at the end of the span, and what a correction of them comes to."""
    now = F.timestamp_seconds(F.lit(BASE_S + SPAN_S))
    rows = li.orphans(_objects(spark, sf_dir), now, 86_400, _references(spark, sf_dir))
    k = F.col("object_key")
    kind = F.when(k % 4 == 0, "orphan_report").when(k % 29 == 0, "failed_upload_diagnostic").otherwise("orphan")
    state = F.when(k % 5 == 0, "queued").otherwise("succeeded")
    before = F.when(k % 3 == 0, "reported").when(k % 7 == 0, "repaired")
    wanted = F.when(k % 13 == 0, "dropped").when(F.col("n_chars") < 500, "deleted").otherwise("repaired")
    return rows.select("object_key", li.orphan_disposition(kind, state, before, wanted).alias("disposition"))


ORPHANS_SQL = f"""
WITH o AS (SELECT doc_id AS k, CASE WHEN doc_id % 4 = 0 THEN 'orphan_report' WHEN doc_id % 29 = 0 THEN 'failed_upload_diagnostic' ELSE 'orphan' END AS kind,
    CASE WHEN doc_id % 5 = 0 THEN 'queued' ELSE 'succeeded' END AS state, CASE WHEN doc_id % 3 = 0 THEN 'reported' WHEN doc_id % 7 = 0 THEN 'repaired' END AS before,
    CASE WHEN doc_id % 13 = 0 THEN 'dropped' WHEN n_chars < 500 THEN 'deleted' ELSE 'repaired' END AS wanted
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND {SPAN_S} - doc_id * 7919 % {SPAN_S} >= 86400)
SELECT k AS object_key, CASE WHEN wanted = 'dropped' THEN 'UNSUPPORTED' WHEN kind = 'failed_upload_diagnostic' THEN 'NOT_ORPHAN_WORK'
  WHEN kind = 'orphan_report' AND wanted = 'deleted' THEN 'RECORD_CANNOT_BE_DELETED' WHEN before = wanted THEN 'replayed'
  WHEN before IS NOT NULL AND NOT (kind = 'orphan_report' AND before = 'reported' AND wanted = 'repaired') THEN 'ALREADY_BOUND'
  WHEN state = 'queued' THEN 'NOT_COMPLETE' ELSE 'applied' END AS disposition FROM o"""


def inconsistent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose document is short of 300 characters, as records whose object is gone."""
    kept = _objects(spark, sf_dir).filter("n_chars >= 300")
    return li.absent(_references(spark, sf_dir), kept).select("object_key")


def retained_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a label or a vector refers to."""
    vecs = table(spark, sf_dir, "embeddings").select(F.lit("w").alias("workspace_id"), F.col("vec_id").alias("object_key"))
    return li.retained(_objects(spark, sf_dir), _references(spark, sf_dir), vecs).select("object_key", "n_chars")


def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded state of every user's work from its events."""
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "enqueued", "view", "claimed", "purchase", "done", "error", "failed", "click", "suppressed")])
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("work_id"), F.struct("ts", "event_id").alias("seq"), F.element_at(kinds, F.col("event_type")).alias("kind"))
    return li.fold_work(e)


LIFECYCLE_SQL = """
SELECT user_id AS work_id, CAST(count_if(event_type = 'error') AS BIGINT) AS failures, count(*) AS n_events,
  CASE WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 'completed' WHEN arg_max(event_type, (ts, event_id)) = 'click' THEN 'suppressed'
    WHEN count_if(event_type = 'error') >= 4 THEN 'exhausted' WHEN arg_max(event_type, (ts, event_id)) = 'view' THEN 'processing' ELSE 'pending' END AS state
FROM events GROUP BY user_id"""


def alert_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sustained breaches of each event type's value, with hysteresis."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("ts").alias("at"), "value")
    rows = op.alert_states(e, THRESHOLD, RECOVERY, SUSTAIN_S, ["event_type"])
    return rows.select("event_id", F.unix_micros(F.col("breach_started").cast("timestamp")).alias("breach_started_us"), "firing")


ALERT_SQL = """
WITH s AS (SELECT event_type, event_id, ts, CASE WHEN value IS NULL OR value <= 30 THEN 0 WHEN value >= 60 THEN 1 END AS edge FROM events),
o AS (SELECT *, coalesce(last_value(edge IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts), 0) AS live FROM s),
n AS (SELECT *, CASE WHEN live = 1 AND coalesce(lag(live) OVER (PARTITION BY event_type ORDER BY ts), 0) = 0 THEN 1 ELSE 0 END AS new FROM o),
i AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts) AS island FROM n),
b AS (SELECT *, CASE WHEN live = 1 THEN min(CASE WHEN live = 1 THEN ts END) OVER (PARTITION BY event_type, island ORDER BY ts) END AS begun FROM i),
f AS (SELECT *, CASE WHEN edge = 1 AND date_diff('microsecond', begun, ts) >= 3600000000 THEN 1 ELSE 0 END AS hit FROM b)
SELECT event_id, epoch_us(begun) AS breach_started_us, live = 1 AND max(CASE WHEN live = 1 THEN hit END) OVER (PARTITION BY event_type, island ORDER BY ts) = 1 AS firing FROM f"""


def idempotent_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests: the customer and day are the key, the priority the fingerprint; the first of a key is on record."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("workspace_id"), F.col("o_orderstatus").alias("key"), F.col("o_orderpriority").alias("fingerprint"))
    first = o.groupBy("workspace_id", "key").agg(F.min_by(F.struct("o_orderkey", "fingerprint"), "o_orderkey").alias("f"))
    records = first.select("workspace_id", "key", F.col("f.fingerprint").alias("fingerprint"), F.when(F.col("f.o_orderkey") % 2 == 0, F.lit("2030-01-01")).otherwise("2000-01-01").cast("timestamp").alias("expires_at"))
    return li.submit(o, records, F.lit("2024-01-01").cast("timestamp"), "o_orderkey").select("o_orderkey", "outcome")


SUBMIT_SQL = """
WITH n AS (SELECT *, lag(o_orderkey) OVER w IS NULL AS opens, first_value(o_orderkey) OVER w % 2 = 0 AS live, first_value(o_orderpriority) OVER w AS known
  FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey))
SELECT o_orderkey, CASE WHEN opens AND NOT live THEN 'created' WHEN known = o_orderpriority THEN 'replayed' ELSE 'conflict' END AS outcome FROM n"""

QUERIES = {f.__name__: f for f in (ops_snapshot, claim_latency, claim_histogram, retry_decisions, due_queue, claim_step, expired_recovery, job_status_projection, version_allocation, orphans, inconsistent_records, retained_objects, lifecycle_states, alert_islands, idempotent_submit, heartbeat_step, finalize_outcomes, job_matrix, replacement_jobs)}

ORACLE_SQL = {
    "ops_snapshot": SNAPSHOT_SQL,
    "claim_latency": _LATENCY + " SELECT job_id, count(*) AS n, CAST(sum(latency_us) AS BIGINT) AS total_us, max(latency_us) AS most_us FROM l GROUP BY job_id",
    "claim_histogram": HISTOGRAM_SQL,
    "retry_decisions": RETRY_SQL,
    "due_queue": "WITH " + _JOBS + " SELECT workspace_id, job_id, state, row_number() OVER (PARTITION BY workspace_id ORDER BY next_attempt_at NULLS FIRST, created_at, job_id) AS place FROM due",
    "claim_step": CLAIM_SQL,
    "expired_recovery": EXPIRED_SQL,
    "job_status_projection": STATUS_SQL,
    "version_allocation": VERSION_SQL,
    "orphans": ORPHANS_SQL,
    "inconsistent_records": "SELECT doc_id AS object_key FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 300)",
    "retained_objects": "SELECT doc_id AS object_key, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) OR doc_id IN (SELECT vec_id FROM embeddings)",
    "lifecycle_states": LIFECYCLE_SQL,
    "alert_islands": ALERT_SQL,
    "idempotent_submit": SUBMIT_SQL,
    "heartbeat_step": HEARTBEAT_SQL,
    "finalize_outcomes": FINALIZE_SQL,
    "job_matrix": MATRIX_SQL,
    "replacement_jobs": REPLACEMENT_SQL,
}
