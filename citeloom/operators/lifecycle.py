"""Work coordination as folds over states and events, and reconciliation of objects with records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DIAGNOSTIC_HOURS, MAX_ATTEMPTS
from ..functions.canonical import json_strings
from .operations import TERMINAL, due, micros, retry_decision


def claim(jobs: DataFrame, now: Column, lease_seconds: int, by: str = "workspace_id") -> DataFrame:
    """The jobs after one claim a workspace: the first due job gets a lease, the next fence and attempt.

    The first of each workspace is a minimum, combined before the shuffle; its ids join back to the jobs.
    """
    order = F.struct(F.col("next_attempt_at").isNotNull(), "next_attempt_at", "created_at", "job_id")
    first = jobs.filter(due(now)).groupBy(by).agg(F.min_by("job_id", order).alias("job_id")).select("job_id", F.lit(True).alias("__taken"))
    rows = jobs.join(first, "job_id", "left").withColumn("__taken", F.coalesce("__taken", F.lit(False)))
    return rows.withColumns(
        {
            "state": F.when(F.col("__taken"), "processing").otherwise(F.col("state")),
            "attempt_count": F.col("attempt_count") + F.col("__taken").cast("int"),
            "fence": F.col("fence") + F.col("__taken").cast("int"),
            "lease_until": F.when(F.col("__taken"), now + F.make_dt_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_until")),
        }
    ).drop("__taken")


def heartbeat(jobs: DataFrame, beats: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
    """Leases extended by beats (job_id, fence) that hold the current fence and come before the lease ends."""
    held = jobs.join(beats.select("job_id", F.col("fence").alias("__fence")).distinct(), "job_id", "left")
    live = (F.col("state") == "processing") & (F.col("__fence") == F.col("fence")) & (F.col("lease_until") > now)
    return held.withColumn("lease_until", F.when(live, F.greatest("lease_until", now + F.make_dt_interval(secs=F.lit(lease_seconds)))).otherwise(F.col("lease_until"))).drop("__fence")


def recover_expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs whose lease has run out, oldest first, and what the retry policy decides for them."""
    decision, _, delay = retry_decision(F.lit("lease_expired"), F.col("attempt_count"))
    rows = jobs.filter((F.col("state") == "processing") & (F.col("lease_until") <= now))
    state = F.when(decision == "schedule_retry", "retry_scheduled").otherwise("failed")
    return rows.select("job_id", "attempt_count", "lease_until", state.alias("state"), delay.alias("delay_us"), micros(F.col("lease_until"), now).alias("overdue_us")).orderBy("lease_until", "job_id")


def finalize(jobs: DataFrame, results: DataFrame, current: DataFrame) -> DataFrame:
    """job_id, outcome of finished attempts (job_id, fence, document_id, target_version): stale fences are ignored,
    targets that are no longer current are superseded, the others succeed."""
    rows = results.withColumnRenamed("fence", "__f").join(jobs.select("job_id", "fence", "state"), "job_id").join(current, "document_id", "left")
    outcome = (
        F.when((F.col("__f") != F.col("fence")) | (F.col("state") != "processing"), "stale")
        .when(~F.col("target_version").eqNullSafe(F.col("current_version")), "superseded")
        .otherwise("succeeded")
    )
    return rows.select("job_id", outcome.alias("outcome"))


def submit(requests: DataFrame, records: DataFrame, now: Column, order: str, jobs: DataFrame | None = None) -> DataFrame:
    """Outcomes of requests (workspace_id, key, fingerprint, `order`, and content with `jobs`): replayed, conflict, deduplicated or created.

    Requests come in the order of a unique column. A record of the key that has not expired answers them: the same fingerprint is
    replayed, another conflicts. Without one the key's first request makes the record that answers the others. Such a first
    request is taken in by a job (workspace_id, content) of the same content, whether it was there before or an earlier request
    created it; else it creates the job. First requests are minima, combined before the shuffle.
    """
    key = ["workspace_id", "key"]
    live = records.filter(F.col("expires_at") > now).groupBy(*key).agg(F.first("fingerprint").alias("__known"))
    first = requests.groupBy(*key).agg(F.min(F.struct(order, "fingerprint")).alias("__first"))
    rows = requests.join(live, key, "left").join(first, key)
    opens = F.col("__known").isNull() & (F.col(order) == F.col(f"__first.{order}"))
    alike = F.lit(False)
    if jobs is not None:
        content = ["workspace_id", "content"]
        there = jobs.select(*content).distinct().withColumn("__there", F.lit(True))
        maker = rows.filter(opens).groupBy(*content).agg(F.min(order).alias("__maker"))
        rows = rows.join(there, content, "left").join(maker, content, "left")
        alike = F.coalesce("__there", F.lit(False)) | (F.col("__maker") < F.col(order))
    same = F.coalesce("__known", F.col("__first.fingerprint")) == F.col("fingerprint")
    outcome = F.when(opens & alike, "deduplicated").when(opens, "created").when(same, "replayed").otherwise("conflict")
    return rows.withColumn("outcome", outcome).select(*requests.columns, "outcome")


def heartbeat_outcomes(jobs: DataFrame, beats: DataFrame, applied: DataFrame, now: Column) -> DataFrame:
    """operation_id, outcome of beats (operation_id, job_id, fence): replayed if it was applied before, extended under the current fence and a live lease, else fenced."""
    known = applied.select("operation_id").distinct().withColumn("__done", F.lit(True))
    rows = beats.withColumnRenamed("fence", "__f").join(known, "operation_id", "left").join(jobs.select("job_id", "fence", "state", "lease_until"), "job_id", "left")
    live = (F.col("state") == "processing") & (F.col("__f") == F.col("fence")) & (F.col("lease_until") > now)
    return rows.select("operation_id", F.when(F.col("__done"), "replayed").when(F.coalesce(live, F.lit(False)), "extended").otherwise("fenced").alias("outcome"))


def recover_attempts(jobs: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """Expired jobs with the open attempt that recovery closes: job_id, attempt_number, outcome; jobs without one are inconsistent and stay."""
    expired = jobs.filter((F.col("state") == "processing") & (F.col("lease_until") <= now)).select("job_id", "attempt_count")
    open_ = attempts.filter(F.col("closed_at").isNull()).select("job_id", "attempt_number")
    rows = expired.join(open_, "job_id", "left")
    same = F.col("attempt_number").eqNullSafe(F.col("attempt_count"))
    return rows.select("job_id", "attempt_number", F.when(~same, "INCONSISTENT").when(F.col("attempt_count") >= MAX_ATTEMPTS, "failed").otherwise("retry_scheduled").alias("outcome"))


def reference_ids(arrays: list[Column], maps: list[Column], texts: list[Column]) -> Column:
    """All identifiers a row refers to, as strings: elements of arrays, values of maps, string values at any depth of JSON texts."""
    parts = [*[a.cast("array<string>") for a in arrays], *[F.map_values(m).cast("array<string>") for m in maps], *[json_strings(t) for t in texts]]
    return F.array_distinct(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))


def retained(objects: DataFrame, *references: DataFrame) -> DataFrame:
    """Objects that any of the reference key sets holds (columns workspace_id, object_key)."""
    keys = references[0].select("workspace_id", "object_key")
    for r in references[1:]:
        keys = keys.union(r.select("workspace_id", "object_key"))
    return objects.join(keys, ["workspace_id", "object_key"], "left_semi")


def orphans(inventory: DataFrame, now: Column, min_age_seconds: int, *references: DataFrame) -> DataFrame:
    """Inventory objects (workspace_id, object_key, created_at) that nothing refers to and that are old enough."""
    rows = inventory.filter(micros(F.col("created_at"), now) >= min_age_seconds * 1_000_000)
    for r in references:
        rows = rows.join(r.select("workspace_id", "object_key"), ["workspace_id", "object_key"], "left_anti")
    return rows


def absent(references: DataFrame, inventory: DataFrame) -> DataFrame:
    """Recorded keys that the inventory does not have."""
    return references.join(inventory.select("workspace_id", "object_key"), ["workspace_id", "object_key"], "left_anti")


def blockers(objects: DataFrame, key: str, references: dict[str, DataFrame]) -> DataFrame:
    """`objects` with the number of references of each kind and deletable, where there are none.

    References come as arrays of keys (`ids`); they are exploded and counted by key, so containment is an equi-join.
    """
    rows = reduce(DataFrame.union, [r.select(F.explode("ids").alias(key), F.lit(kind).alias("kind")) for kind, r in references.items()])
    counts = rows.groupBy(key).agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in references])
    done = objects.join(counts, key, "left").withColumns({kind: F.coalesce(kind, F.lit(0)) for kind in references})
    return done.withColumn("deletable", reduce(Column.__and__, [F.col(kind) == 0 for kind in references]))


def orphan_disposition(artifact_class: Column, state: Column, before: Column, requested: Column) -> Column:
    """The outcome of a corrective disposition of orphan work: applied, replayed, or why it is refused.

    Orphans become repaired or deleted; a reported inconsistent record (orphan_report) only repaired, also after it
    was reported. What is bound otherwise stays; corrections need work that succeeded.
    """
    report = artifact_class == "orphan_report"
    free = before.isNull() | (report & (before == "reported") & (requested == "repaired"))
    return (
        F.when(~requested.isin("repaired", "deleted"), "UNSUPPORTED")
        .when(~artifact_class.isin("orphan", "orphan_report"), "NOT_ORPHAN_WORK")
        .when(report & (requested != "repaired"), "RECORD_CANNOT_BE_DELETED")
        .when(before == requested, "replayed")
        .when(~free, "ALREADY_BOUND")
        .when(state != "succeeded", "NOT_COMPLETE")
        .otherwise("applied")
    )


def fold_work(events: DataFrame) -> DataFrame:
    """The state of each work item from its events (work_id, seq, kind): enqueued, claimed, done, failed or suppressed.

    Four failures exhaust an item. Events combine to counts and the last kind, so no list of events is kept.
    """
    rows = events.groupBy("work_id").agg(F.count_if(F.col("kind") == "failed").alias("failures"), F.max_by("kind", "seq").alias("last"), F.count("*").alias("n_events"))
    state = F.when(F.col("last") == "done", "completed").when(F.col("last") == "suppressed", "suppressed").when(F.col("failures") >= 4, "exhausted").when(F.col("last") == "claimed", "processing").otherwise("pending")
    return rows.select("work_id", "failures", "n_events", state.alias("state"))


def lifecycle_order() -> list[Column]:
    """First in, first out."""
    return [F.asc("created_at"), F.asc("work_id")]


def lifecycle_due(now: Column) -> Column:
    """Work that can be claimed: queued or due for a retry, with attempts left, and past its retention where it has one."""
    ready = (F.col("state") == "queued") | ((F.col("state") == "retry_scheduled") & (F.col("next_attempt_at") <= now))
    return F.coalesce(ready, F.lit(False)) & (F.col("attempt_count") < F.col("max_attempts")) & (F.col("eligible_at").isNull() | (F.col("eligible_at") <= now))


def work_pass(work: DataFrame, objects: DataFrame, blocked: DataFrame, now: Column) -> DataFrame:
    """`work` (work_id, workspace_id, object_key, state, attempt_count, max_attempts, created_at, next_attempt_at, eligible_at) with the outcome of one pass over all of it.

    not_eligible: not due; suppressed: something refers to the object (`blocked`); succeeded: the object is gone already;
    deleted: it is there and goes now. Objects and references are looked up by key, whatever their number.
    """
    key = ["workspace_id", "object_key"]
    mark = lambda x, name: x.select(*key).distinct().withColumn(name, F.lit(True))
    rows = work.join(mark(objects, "__there"), key, "left").join(mark(blocked, "__kept"), key, "left")
    outcome = F.when(~lifecycle_due(now), "not_eligible").when(F.col("__kept"), "suppressed").when(F.col("__there"), "deleted").otherwise("succeeded")
    return rows.withColumn("outcome", outcome).drop("__there", "__kept")


def enqueue(work: DataFrame, items: DataFrame) -> DataFrame:
    """What `items` adds to `work`: one row for each new (workspace_id, object_key, artifact_class, generation); repeats and known ones add nothing."""
    key = ["workspace_id", "object_key", "artifact_class", "generation"]
    first = items.groupBy(*key).agg(F.min("work_id").alias("work_id"))
    return first.join(work.select(*key), key, "left_anti")


def work_rules() -> dict[str, Column]:
    """One lifecycle item: attempts within budget; diagnostics of failed uploads are kept for 24 hours after they were classified."""
    diagnostic = F.col("artifact_class") == "failed_upload_diagnostic"
    kept = F.col("discovered_at").isNotNull() & F.col("eligible_at").isNotNull() & (micros(F.col("discovered_at"), F.col("eligible_at")) >= DIAGNOSTIC_HOURS * 3_600_000_000)
    return {"attempts": F.col("attempt_count").between(0, MAX_ATTEMPTS), "retention": ~diagnostic | F.coalesce(kept, F.lit(False))}


def fail_terminally(jobs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """`jobs` after terminal failures (job_id, worker_id, fence, attempt, cause), with outcome where one was asked for.

    applied needs the current worker, fence and attempt and a live lease; a stale one is fenced, another attempt invalid.
    """
    f = failures.select("job_id", F.col("worker_id").alias("__w"), F.col("fence").alias("__f"), F.col("attempt").alias("__a"), "cause")
    rows = jobs.join(f, "job_id", "left")
    asked = F.col("cause").isNotNull()
    owns = (F.col("state") == "processing") & (F.col("__w") == F.col("worker_id")) & (F.col("__f") == F.col("fence")) & (F.col("lease_until") > now)
    outcome = F.when(asked & ~F.coalesce(owns, F.lit(False)), "fenced").when(asked & (F.col("__a") != F.col("attempt_count")), "invalid").when(asked, "applied")
    rows = rows.withColumn("outcome", outcome)
    gone = F.coalesce(F.col("outcome") == "applied", F.lit(False))
    clear = lambda c: F.when(~gone, F.col(c))
    reason = F.when(gone, F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TERMINAL.items() for x in kv]), F.col("cause")), F.lit("internal")))
    return rows.withColumns({"state": F.when(gone, "failed").otherwise(F.col("state")), "worker_id": clear("worker_id"), "lease_until": clear("lease_until"), "next_attempt_at": clear("next_attempt_at"), "failure_reason": reason}).drop("__w", "__f", "__a", "cause")


def reprocess(requests: DataFrame, current: DataFrame, sources: DataFrame, records: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """`requests` (request_id, workspace_id, key, fingerprint, document_id, version_id, configuration) with outcome and job_id.

    In this order: the version must be its document's current one and have its source object; a live record of the key
    replays its job or conflicts; else a running or finished job of the version and configuration is reused (the earliest),
    or one is created. Every request that ends in a job is an audit row.
    """
    live = records.filter(F.col("expires_at") > now).select("workspace_id", "key", F.col("fingerprint").alias("__known"), F.col("job_id").alias("__replay"))
    running = jobs.filter(F.col("state").isin("processing", "succeeded")).groupBy("version_id", "configuration").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("__job"))
    rows = requests.join(current.select("document_id", F.col("version_id").alias("__current")), "document_id", "left").join(sources.select("version_id", F.lit(True).alias("__source")).distinct(), "version_id", "left")
    rows = rows.join(live, ["workspace_id", "key"], "left").join(running, ["version_id", "configuration"], "left")
    outcome = (
        F.when(F.col("__current").isNull(), "DOCUMENT_VERSION_NOT_FOUND")
        .when(F.col("__current") != F.col("version_id"), "DOCUMENT_VERSION_NOT_CURRENT")
        .when(F.col("__source").isNull(), "SOURCE_OBJECT_NOT_AVAILABLE")
        .when(F.col("__known").isNotNull() & (F.col("__known") != F.col("fingerprint")), "IDEMPOTENCY_KEY_CONFLICT")
        .when(F.col("__known").isNotNull(), "idempotency_replay")
        .when(F.col("__job").isNotNull(), "reused")
        .otherwise("created")
    )
    rows = rows.withColumn("outcome", outcome)
    job = F.when(F.col("outcome") == "idempotency_replay", F.col("__replay")).when(F.col("outcome") == "reused", F.col("__job"))
    return rows.withColumn("job_id", job).drop("__current", "__source", "__known", "__replay", "__job")


def correspondence_breaches(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """subject, rule: processing jobs without exactly one open attempt that matches them, and others with one open."""
    open_ = attempts.filter(F.col("closed_at").isNull()).groupBy("job_id").agg(F.count("*").alias("n"), F.max("attempt_number").alias("a"), F.max("worker_id").alias("w"), F.max("fence").alias("f"))
    rows = jobs.join(open_, "job_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    running = F.col("state") == "processing"
    same = F.col("a").eqNullSafe(F.col("attempt_count")) & F.col("w").eqNullSafe(F.col("worker_id")) & F.col("f").eqNullSafe(F.col("fence"))
    rule = F.when(running & (F.col("n") != 1), "ONE_OPEN_ATTEMPT").when(running & ~same, "PROJECTION_MISMATCH").when(~running & (F.col("n") > 0), "OPEN_ATTEMPT_OF_IDLE_JOB")
    return rows.select(F.col("job_id").cast("string").alias("subject"), rule.alias("rule")).filter(F.col("rule").isNotNull())
