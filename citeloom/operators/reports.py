"""Parts of an evaluation report and the contracts they keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ALERT_CLASSES, METRICS


def latency(column: str) -> list[Column]:
    """Mean, least and most of a latency: aggregates, null without values."""
    return [F.avg(column).alias(f"{column}_mean"), F.min(column).alias(f"{column}_min"), F.max(column).alias(f"{column}_max")]


def included(cases: DataFrame) -> DataFrame:
    """`cases` (applicable, status, failure_code) with included and exclusion_reason: what does not apply or failed is not scored."""
    reason = F.when(~F.col("applicable"), "RETRIEVAL_RELEVANCE_NOT_APPLICABLE").when(F.col("status") != "observed", F.coalesce("failure_code", F.lit("OBSERVATION_FAILURE")))
    return cases.withColumn("exclusion_reason", reason).withColumn("included", F.col("exclusion_reason").isNull())


def structural_checks() -> dict[str, Column]:
    """The five checks of one observation beside its case.

    decision, answer, refusal_reason, evidence_ids, marker_ids, cited and retrieved (chunk references), expected_sources,
    candidate_workspaces, workspace_id, trace_id. A refusal has no answer text, as the public contract demands.
    """
    cited, ids = F.col("cited"), F.col("evidence_ids")
    answer = (F.length(F.trim("answer")) > 0) & F.col("refusal_reason").isNull() & (F.size(ids) > 0) & (F.col("marker_ids") == ids)
    answer = answer & (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(cited) == F.size(ids))
    nothing = (F.size(cited) == 0) & (F.size(ids) == 0) & (F.size("marker_ids") == 0)
    refusal = (F.col("refusal_reason") == "INSUFFICIENT_EVIDENCE") & F.col("answer").isNull() & nothing
    sources = F.array_distinct(F.transform(cited, lambda r: F.regexp_extract(r, r"(?s)^(.*)#[0-9]+$", 1)))
    no = F.lit(False)
    return {
        "decision_contract": F.when(F.col("decision") == "ANSWER", F.coalesce(answer, no)).when(F.col("decision") == "REFUSAL", F.coalesce(refusal, no)).otherwise(no),
        "expected_source_documents": F.when(F.col("decision") == "REFUSAL", F.size(cited) == 0).otherwise((F.size(sources) > 0) & (F.size(F.array_except(sources, "expected_sources")) == 0)),
        "citation_in_evidence_set": F.size(F.array_except(cited, "retrieved")) == 0,
        "workspace_isolation": F.forall("candidate_workspaces", lambda w: w == F.col("workspace_id")),
        "trace_persisted": F.coalesce(F.length("trace_id") > 0, no),
    }


def structural_report(observations: DataFrame) -> DataFrame:
    """One row: n, how many pass each check and all of them, the rate, and whether the hard gate holds."""
    checks = structural_checks()
    rows = observations.select(*[ok.alias(name) for name, ok in checks.items()])
    everything = reduce(Column.__and__, [F.col(n) for n in checks])
    done = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(n)).alias(n) for n in checks], F.count_if(everything).alias("passed"))
    return done.withColumn("rate", F.try_divide(F.col("passed").cast("double"), F.col("n"))).withColumn("hard_gate", (F.col("n") > 0) & (F.col("passed") == F.col("n")))


def system_report(observations: DataFrame, deterministic: bool = False) -> DataFrame:
    """One row over observations (latency_ms, usage: map, cost_usd: decimal, error): latency, usage by name, cost and their status."""
    absent = F.lit("zero_by_contract" if deterministic else "unavailable")
    one = observations.agg(F.count("*").alias("n"), *latency("latency_ms"), F.sum("cost_usd").alias("cost_usd"), F.count("error").alias("provider_errors"))
    named = observations.select(F.explode("usage").alias("name", "value")).groupBy("name").agg(F.sum("value").alias("total"))
    usage = named.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "total")))).alias("token_usage"))  # names are few
    done = one.crossJoin(usage)
    return done.withColumn("usage_status", F.when(F.size("token_usage") > 0, "observed").otherwise(absent)).withColumn("cost_status", F.when(F.col("cost_usd").isNotNull(), "observed").otherwise(absent))


def semantic_scores(evaluations: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, denominator, mean, problems over evaluations (scores: map, error): each metric over the cases that have it.

    A problem is a score outside 0 to 1, or one that is missing where the evaluation had no error.
    """
    rows = evaluations.select("error", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.element_at("scores", F.lit(m)).alias("score")) for m in metrics])).alias("x")).select("error", "x.*")
    wrong = F.when(F.col("score").isNull(), F.col("error").isNull()).otherwise((F.col("score") < 0) | (F.col("score") > 1) | F.isnan("score"))
    return rows.groupBy("metric").agg(F.count("score").alias("denominator"), F.avg("score").alias("mean"), F.count_if(wrong).alias("problems"))


def consensus(observations: DataFrame, columns: list[str]) -> DataFrame:
    """name, distinct, value: what all traced observations (trace_id not null) must agree on; value where they do."""
    one = observations.filter(F.col("trace_id").isNotNull()).agg(*[x for c in columns for x in (F.count_distinct(c).alias(f"n_{c}"), F.min(F.col(c).cast("string")).alias(f"v_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n_{c}").alias("distinct"), F.when(F.col(f"n_{c}") == 1, F.col(f"v_{c}")).alias("value")) for c in columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def category_metric_rules() -> dict[str, Column]:
    """Arithmetic of one category and metric: case_count, applicable, inapplicable, failures, numerator, denominator, value."""
    p, q = F.col("numerator"), F.col("denominator")
    counts = [F.col(c) for c in ("applicable", "inapplicable", "failures", "denominator")]
    return {
        "counts": reduce(Column.__and__, [c >= 0 for c in counts]),
        "applicable": F.col("applicable") + F.col("inapplicable") == F.col("case_count"),
        "failures": F.col("failures") <= F.col("applicable"),
        "denominator": q == F.col("applicable") - F.col("failures"),
        "numerator": (p >= 0) & (p <= q) & ~F.isnan(p.cast("double")),
        "value": F.when(q == 0, F.col("value").isNull() & (p == 0)).otherwise(F.coalesce(F.col("value") == p.cast("double") / q, F.lit(False))),
    }


def observation_set_rules(configuration: str, chunk_set: str) -> dict[str, Column]:
    """One observation of a report: status, latencies, provenance, decision, guardrails, failure code."""
    seen = F.col("status") == "observed"
    timely = lambda c: F.coalesce((F.col(c) >= 0) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    flags = F.col("structural_validity").isNotNull() & F.col("citation_correctness").isNotNull() & F.col("refusal_correctness").isNotNull()
    return {
        "OBSERVATION_STATUS_INVALID": F.col("status").isin("observed", "failure", "observation_failure"),
        "OBSERVATION_LATENCY_INVALID": ~seen | (timely("retrieval_latency_ms") & timely("end_to_end_latency_ms")),
        "OBSERVATION_FAILURE_CODE_INVALID": F.when(seen, F.col("failure_code").isNull()).otherwise(F.coalesce(F.length("failure_code") > 0, F.lit(False))),
        "OBSERVATION_PROVENANCE_INVALID": ~seen | ((F.col("retrieval_configuration_id") == configuration) & (F.col("chunk_set_provenance_id") == chunk_set)),
        "OBSERVATION_RESPONSE_INVALID": ~seen | F.col("decision").isin("ANSWER", "REFUSAL"),
        "GUARDRAIL_FAILURE": ~seen | flags,
    }


def same_cases(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """subject, rule: cases that only one of two runs has, and cases a run has more than once."""
    rows = a.select(F.col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(F.col(key), F.lit(0), F.lit(1)))
    counts = rows.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rule = F.when((F.col("a") > 1) | (F.col("b") > 1), "DUPLICATE_CASE_ID").when(F.col("a") != F.col("b"), "CASE_SET_MISMATCH")
    return counts.select(F.col("k").cast("string").alias("subject"), rule.alias("rule")).filter(F.col("rule").isNotNull())


def guardrails(observations: DataFrame) -> DataFrame:
    """One row of the three report guardrails: none holds without an observation it is about."""
    seen = F.col("status") == "observed"
    answer = seen & (F.col("decision") == "ANSWER")
    whole = lambda on, ok: (F.count_if(on) > 0) & (F.count_if(on & ~F.coalesce(ok, F.lit(False))) == 0)
    refusal = F.coalesce(F.col("refusal_correctness"), F.col("decision") == "ANSWER")
    return observations.agg(
        (whole(seen, F.col("structural_validity")) & (F.count_if(seen) == F.count("*"))).alias("structural_validity"),
        whole(answer, F.col("citation_correctness")).alias("citation_correctness"),
        whole(seen, refusal).alias("refusal_correctness"),
        F.count_if(~seen).alias("observation_failure_count"),
        F.count_if(seen).alias("observed"),
        (F.count_if(seen) == F.count_if(seen & F.col("retrieval_latency_ms").isNotNull() & F.col("end_to_end_latency_ms").isNotNull())).alias("latency_observed"),
    )


def select_improvement(comparisons: DataFrame, by: str) -> DataFrame:
    """by, run, decision: of each group's comparisons (run, decision, rank_key) the claim with the greatest key, ties to the first run; NO_CLAIM without any."""
    claim = F.col("decision") == "CLAIM"
    best = comparisons.groupBy(by).agg(F.max_by("run", F.when(claim, F.struct("rank_key", (-F.col("order")).alias("o")))).alias("run"), F.count_if(claim).alias("claims"))
    return best.select(by, F.when(F.col("claims") > 0, F.col("run")).alias("run"), F.when(F.col("claims") > 0, "CLAIM").otherwise("NO_CLAIM").alias("decision"), "claims")


def canonical_projection(candidates: DataFrame, bindings: DataFrame, provenance: str) -> tuple[DataFrame, DataFrame]:
    """(references, breaches) of trace candidates (query_id, rank, source_key, ordinal, version_id, chunk_set_id) under source bindings."""
    rows = candidates.join(bindings.select("source_key", F.col("version_id").alias("v"), F.col("chunk_set_id").alias("s")), "source_key", "left")
    rule = F.when(F.col("source_key").isNull() | F.col("ordinal").isNull(), "CANONICAL_CHUNK_REFERENCE_INVALID").when(~F.coalesce((F.col("version_id") == F.col("v")) & (F.col("chunk_set_id") == F.col("s")), F.lit(False)), "SOURCE_BINDING_MISMATCH")
    rows = rows.withColumn("rule", rule).withColumn("reference", F.concat_ws("#", "source_key", F.col("ordinal").cast("string")))
    good = rows.filter(F.col("rule").isNull()).select("query_id", "rank", F.lit(provenance).alias("provenance"), "reference")
    twice = good.groupBy("query_id", "reference").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("query_id"), F.lit("DUPLICATE_CANONICAL_CHUNK_REFERENCE").alias("rule"))
    return good, rows.filter(F.col("rule").isNotNull()).select("query_id", "rule").union(twice)


def calibration_rules(least_distractors: int = 8) -> dict[str, Column]:
    """One calibration case: gold, near and unrelated references (arrays), known (all references there are)."""
    gold, near, far, known = (F.col(c) for c in ("gold", "near", "unrelated", "known"))
    return {
        "resolved": (F.size(gold) > 0) & (F.size(F.array_except(F.concat(gold, near, far), known)) == 0),
        "disjoint": ~F.arrays_overlap(gold, near) & ~F.arrays_overlap(gold, far) & ~F.arrays_overlap(near, far),
        "distractors": F.size(F.array_except(known, gold)) >= least_distractors,
    }


def corpus_closure(active: DataFrame, manifest: DataFrame, bindings: DataFrame) -> DataFrame:
    """source_key, rule: where the active corpus (source_key, version_id, chunk_set_id, ordinal), a manifest (source_key, ordinal) and bindings differ."""
    held = active.groupBy("source_key").agg(F.count_distinct("version_id", "chunk_set_id").alias("n_sets"), F.min("version_id").alias("v"), F.min("chunk_set_id").alias("s"))
    both = held.withColumn("a", F.lit(True)).join(manifest.select("source_key").distinct().withColumn("m", F.lit(True)), "source_key", "full_outer")
    both = both.join(bindings.select("source_key", F.col("version_id").alias("bv"), F.col("chunk_set_id").alias("bs")), "source_key", "full_outer")
    rule = F.when(F.col("a").isNull(), "NOT_ACTIVE").when(F.col("m").isNull(), "NOT_IN_MANIFEST").when(F.col("n_sets") > 1, "AMBIGUOUS").when(~((F.col("v") == F.col("bv")) & (F.col("s") == F.col("bs"))).eqNullSafe(F.lit(True)), "BINDING_MISMATCH")
    sources = both.select("source_key", rule.alias("rule")).filter(F.col("rule").isNotNull())
    key = ["source_key", "ordinal"]
    marked = active.select(*key, F.lit(1).alias("a"), F.lit(0).alias("m")).union(manifest.select(*key, F.lit(0), F.lit(1))).groupBy(*key).agg(F.max("a").alias("a"), F.max("m").alias("m")).filter("a <> m")
    return sources.union(marked.select("source_key", F.lit("CHUNKS_DIFFER").alias("rule")).distinct())


def alert_configuration_breaches(definitions: DataFrame) -> DataFrame:
    """subject, rule: what an alert configuration (alert_class, metric, threshold, recovery, sustain_seconds, version) lacks or has wrong."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    rules = {
        "name": (F.length("alert_class") > 0) & (F.length("metric") > 0) & (F.length("version") > 0),
        "metric": F.col("metric").isin(*METRICS),
        "bounds": finite(F.col("threshold")) & finite(F.col("recovery")),
        "sustain": F.col("sustain_seconds") >= 0,
    }
    said = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    rows = definitions.select(F.col("alert_class").alias("subject"), F.explode(said).alias("rule"))
    twice = definitions.groupBy("alert_class").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("alert_class"), F.lit("once"))
    held = definitions.agg(F.collect_set(F.when(F.col("alert_class").isin(*ALERT_CLASSES), F.col("alert_class"))).alias("h"))
    lacking = held.select(F.explode(F.array_except(F.array(*[F.lit(x) for x in ALERT_CLASSES]), "h")).alias("subject"), F.lit("missing").alias("rule"))
    return rows.union(twice).union(lacking)
