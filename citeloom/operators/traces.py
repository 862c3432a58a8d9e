"""Question traces: assembly, timing, and the contracts that traces, observations and public responses keep.

A trace is one nested row; its arrays hold at most the two branches' candidates, so contracts are checked inside the row with
higher-order functions and nothing is exploded or joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PRESETS, RRF_CONSTANT, Retrieval
from ..functions import text as tx
from .evidence import final_decision

PHASES = ("query_embedding", "candidate_retrieval", "evidence_selection", "generation")
STATUSES = {"vector": ("ELIGIBLE", "BELOW_THRESHOLD", "NO_CONTRIBUTION"), "fts": ("ELIGIBLE", "INELIGIBLE", "NO_CONTRIBUTION")}
TOLERANCE = 1e-12


def phase_timings(ticks: list[Column], resolution_ms: float) -> Column:
    """Timing of the four phases from five clock readings in seconds: each phase starts where the one before ended."""
    phase = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.alias("start_tick"), b.alias("end_tick"), ((b - a) * 1000).alias("duration_ms"))
    return F.struct(F.lit(resolution_ms).alias("clock_resolution_ms"), F.array(*[phase(n, a, b) for n, a, b in zip(PHASES, ticks, ticks[1:], strict=False)]).alias("phases"))


def query_embedding_rules(vectors: Column, provider: Column, model: Column, dimensions: int, expected: tuple[str, str]) -> dict[str, Column]:
    """A question has one vector of the configured size, from the configured provider and model."""
    return {
        "one vector": F.size(vectors) == 1,
        "dimensions": F.forall(vectors, lambda v: F.size(v) == dimensions),
        "configuration": (provider == expected[0]) & (model == expected[1]),
    }


def assemble(queries: DataFrame, fused: DataFrame, decisions: DataFrame, observations: DataFrame, answered: DataFrame, preset: Retrieval) -> DataFrame:
    """A nested row per question with everything its answer rests on.

    `queries`: query_id, question; `fused`: candidates with both ranks and scores; `decisions`: select_evidence's rows;
    `observations`: the branches' rows; `answered`: answers' rows. Aliases number the selected chunks; budgets are kept
    where they decided; retrieved ids are in rank order.
    """
    final, reason = final_decision(F.col("outcome"))
    budget = F.struct(F.lit(preset.max_evidence_chunks).alias("max_evidence_chunks"), F.lit(preset.max_evidence_tokens).alias("max_evidence_tokens"), "selected_chunk_count", "selected_token_count", F.col("token_count").alias("candidate_token_count"), "token_total")
    vector = F.when(F.col("vector_rank").isNotNull(), F.struct(F.col("vector_rank").alias("branch_rank"), (1 - F.col("similarity")).alias("cosine_distance"), "similarity"))
    fts = F.when(F.col("fts_rank").isNotNull(), F.struct(F.col("fts_rank").alias("branch_rank"), "native_rank"))
    item = F.struct("final_rank", "chunk_id", "fusion_score", final.alias("final_decision"), reason.alias("decision_reason"), F.when(reason.isNotNull(), budget).alias("budget_evidence"), vector.alias("vector_contribution"), fts.alias("fts_contribution"))
    listed = decisions.join(fused, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("candidate_decisions"))
    seen = F.struct("branch", "chunk_id", "status", F.col("branch_rank").cast("int").alias("branch_rank"))
    watched = observations.groupBy("query_id").agg(F.array_sort(F.collect_list(seen)).alias("branch_observations"))
    rows = queries.select("query_id", "question").join(listed, "query_id", "left").join(watched, "query_id", "left").join(answered, "query_id", "left")
    chosen = F.filter("candidate_decisions", lambda d: d["final_decision"] == "SELECTED")
    aliases = F.map_from_entries(F.transform(chosen, lambda d, i: F.struct(F.concat(F.lit("E"), (i + 1).cast("string")), d["chunk_id"])))
    lexical = F.transform(F.array(tx.full_fold(F.col("question"))), lambda q: F.struct(tx.lexemes(q, True).alias("normalized"), tx.omitted(q, True).alias("omitted")))
    rows = rows.withColumns({
        "trace_schema_version": F.lit(2),
        "retrieval_configuration_id": F.lit(preset.id),
        "fusion_policy_version": F.lit(preset.fusion_policy),
        "lexical_policy_id": F.lit(preset.lexical_policy),
        "retrieved_chunk_ids": F.transform("candidate_decisions", lambda d: d["chunk_id"]),
        "alias_mapping": aliases,
        "parsed_markers": F.coalesce(tx.markers(F.col("answer")), F.array().cast("array<string>")),
    })
    return rows.withColumn("lexical", F.get(lexical, 0))


def trace_rules(presets: dict[str, Retrieval] | None = None) -> dict[str, Column]:
    """Metadata, ordering, scores, decisions, observations and lexical provenance of one trace row."""
    known = presets or PRESETS
    policy = F.create_map(*[F.lit(x) for p in known.values() for x in (p.id, p.fusion_policy or "none")])
    d, o = F.col("candidate_decisions"), F.col("branch_observations")
    rank = lambda c: F.coalesce(1.0 / (RRF_CONSTANT + c["branch_rank"]), F.lit(0.0))
    score = lambda x: F.abs(x["fusion_score"] - rank(x["vector_contribution"]) - rank(x["fts_contribution"])) <= TOLERANCE
    budget = lambda x: x["budget_evidence"]
    sums = lambda x: budget(x)["token_total"] == budget(x)["selected_token_count"] + budget(x)["candidate_token_count"]
    full = lambda x: budget(x)["selected_chunk_count"] >= budget(x)["max_evidence_chunks"]
    over = lambda x: ~full(x) & (budget(x)["token_total"] > budget(x)["max_evidence_tokens"])
    exceeded = lambda x: F.coalesce(sums(x) & F.when(x["decision_reason"] == "TOKEN_BUDGET", over(x)).otherwise((x["decision_reason"] == "CHUNK_COUNT_LIMIT") & full(x)), F.lit(False))
    reasoned = lambda x: F.when(x["final_decision"] == "BUDGET_EXCEEDED", exceeded(x)).otherwise(x["final_decision"].isin("SELECTED", "REDUNDANT_OVERLAP") & x["decision_reason"].isNull() & budget(x).isNull())
    pair = lambda branch, chunk, rank: F.concat_ws("/", F.lit(branch), chunk.cast("string"), rank.cast("string"))
    said = lambda branch, field: F.transform(F.filter(d, lambda x: x[field].isNotNull()), lambda x: pair(branch, x["chunk_id"], x[field]["branch_rank"]))
    contributions = F.array_sort(F.concat(said("vector", "vector_contribution"), said("fts", "fts_contribution")))
    eligible = F.array_sort(F.transform(F.filter(o, lambda x: x["status"] == "ELIGIBLE"), lambda x: F.concat_ws("/", x["branch"], x["chunk_id"].cast("string"), x["branch_rank"].cast("string"))))
    answered = (F.col("decision") == "ANSWER") & F.col("answer").isNotNull() & (F.length(F.trim("answer")) > 0) & F.col("refusal_reason").isNull()
    refused = (F.col("decision") == "REFUSAL") & F.col("answer").isNull() & (F.col("refusal_reason") == "INSUFFICIENT_EVIDENCE")
    lexical = F.col("lexical")
    return {
        "version": F.col("trace_schema_version") == 2,
        "policy": F.coalesce("fusion_policy_version", F.lit("none")) == F.element_at(policy, F.col("retrieval_configuration_id")),
        "decision": answered | refused,
        "ordering": F.forall(F.transform(d, lambda x, i: x["final_rank"] == i + 1), lambda ok: ok) & (F.size(F.array_distinct("retrieved_chunk_ids")) == F.size(d)),
        "branch": F.forall(d, lambda x: x["vector_contribution"].isNotNull() | x["fts_contribution"].isNotNull()),
        "score": F.forall(d, score),
        "reason": F.forall(d, reasoned),
        "observed": contributions == eligible,
        "lexemes": (F.size(F.array_distinct(lexical["normalized"])) == F.size(lexical["normalized"])) & (F.size(F.array_intersect(lexical["normalized"], lexical["omitted"])) == 0),
        "markers": F.forall("parsed_markers", lambda m: F.map_contains_key("alias_mapping", m)),
    }


def observation_rules() -> dict[str, Column]:
    """One branch observation row: branch, status, chunk_id, branch_rank, cosine_distance, similarity, native_rank."""
    vector, ranked = F.col("branch") == "vector", F.col("status") == "ELIGIBLE"
    allowed = F.when(vector, F.col("status").isin(*STATUSES["vector"])).otherwise((F.col("branch") == "fts") & F.col("status").isin(*STATUSES["fts"]))
    scored, native = F.col("cosine_distance").isNotNull() & F.col("similarity").isNotNull(), F.col("native_rank").isNotNull()
    unscored = F.col("cosine_distance").isNull() & F.col("similarity").isNull()
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(True))
    return {
        "status": allowed,
        "chunk": F.col("chunk_id").isNotNull() | ~ranked,
        "rank": F.when(ranked, F.coalesce(F.col("branch_rank") >= 1, F.lit(False))).otherwise(F.col("branch_rank").isNull()),
        "scores": F.when(vector, ~native & F.when(F.col("status") == "NO_CONTRIBUTION", unscored).otherwise(scored)).otherwise(unscored & (native == ranked)),
        "finite": finite(F.col("cosine_distance")) & finite(F.col("similarity")) & finite(F.col("native_rank").cast("double")),
    }


def timing_rules(timing: Column, retrieval_ms: Column) -> dict[str, Column]:
    """Phases follow each other without gaps, durations match their ticks, retrieval is the sum of its two phases."""
    phases, resolution = timing["phases"], timing["clock_resolution_ms"]
    at = lambda i: F.get(phases, i)
    chain = at(0)["end_tick"] == at(1)["start_tick"]
    for i in (1, 2):
        chain = chain & (at(i)["end_tick"] == at(i + 1)["start_tick"])
    names = F.transform(phases, lambda p: p["name"]) == F.array(*[F.lit(n) for n in PHASES])
    exact = F.forall(phases, lambda p: (p["end_tick"] >= p["start_tick"]) & (F.abs(p["duration_ms"] - (p["end_tick"] - p["start_tick"]) * 1000) <= resolution))
    return {
        "phases": (resolution > 0) & names,
        "chain": chain,
        "durations": exact,
        "retrieval latency": (retrieval_ms >= 0) & (F.abs(retrieval_ms - at(1)["duration_ms"] - at(2)["duration_ms"]) <= resolution),
    }


def response_rules() -> dict[str, Column]:
    """The public answer or refusal: decision, answer, refusal_reason, trace_id and citations (evidence_id, source_key, excerpt, start_line, end_line)."""
    c, answer = F.col("citations"), F.col("answer")
    is_answer, is_refusal = F.col("decision") == "ANSWER", F.col("decision") == "REFUSAL"
    full = lambda s: s.isNotNull() & (F.length(F.trim(s)) > 0)
    ids = F.transform(c, lambda x: x["evidence_id"])
    return {
        "decision": is_answer | is_refusal,
        "trace": full(F.col("trace_id")),
        "answer": ~is_answer | (full(answer) & F.col("refusal_reason").isNull()),
        "refusal": ~is_refusal | (answer.isNull() & (F.size(c) == 0) & F.coalesce(F.col("refusal_reason") == "INSUFFICIENT_EVIDENCE", F.lit(False))),
        "citation fields": F.forall(c, lambda x: full(x["evidence_id"]) & full(x["source_key"]) & full(x["excerpt"])),
        "citation lines": F.forall(c, lambda x: (x["start_line"] >= 1) & (x["end_line"] >= x["start_line"])),
        "markers": ~is_answer | ((F.size(c) > 0) & (F.size(F.array_distinct(ids)) == F.size(c)) & tx.markers_well_formed(answer) & (tx.markers(answer) == ids)),
    }


def citation_breaches(citations: DataFrame, mapping: DataFrame, candidates: DataFrame) -> DataFrame:
    """subject, rule: public citations (query_id, evidence_id, source_key, excerpt, locator) that their trace does not bear out.

    `mapping`: query_id, evidence_id, chunk_id; `candidates`: query_id, chunk_id, final_decision, source_key, content,
    locator. An alias maps to one selected chunk of the question, and key, excerpt and locator are the chunk's.
    """
    rows = citations.join(mapping, ["query_id", "evidence_id"], "left").join(candidates.select("query_id", "chunk_id", "final_decision", F.col("source_key").alias("k"), F.col("content").alias("t"), F.col("locator").alias("l")), ["query_id", "chunk_id"], "left")
    rules = {
        "selected": F.col("final_decision") == "SELECTED",
        "source": F.col("source_key") == F.col("k"),
        "excerpt": F.col("excerpt") == F.substring("t", 1, 500),
        "locator": F.col("locator") == F.col("l"),
    }
    said = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    twice = mapping.groupBy("query_id", "chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("query_id").cast("string").alias("subject"), F.lit("alias once").alias("rule"))
    return rows.select(F.concat_ws("/", "query_id", "evidence_id").alias("subject"), F.explode(said).alias("rule")).union(twice)
