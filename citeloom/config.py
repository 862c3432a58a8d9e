"""Versioned presets. The values are part of the semantics and fixed."""

from __future__ import annotations

from dataclasses import dataclass

# The retrieval presets, limits and policies that queries and results depend on.
RRF_CONSTANT = 60
REDUNDANCY_OVERLAP = 0.5
INDEPENDENCE_OVERLAP = 0.8
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or",
    "that", "the", "to", "was", "what", "when", "where", "which", "who", "why", "with",
)
LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
RETRY_WINDOW_MICROS = {1: 5_000_000, 2: 30_000_000, 3: 120_000_000}
MAX_ATTEMPTS = 4
LEASE_SECONDS, RUNTIME_SECONDS, HEARTBEAT_SECONDS = 120, 900, 30
IDEMPOTENCY_HOURS = 24
DIAGNOSTIC_HOURS = 24
ORPHAN_MIN_AGE_SECONDS = 86_400
RETRY_RATE_WINDOW_SECONDS = 300
# The closed failure taxonomy, by fixture: (class, stage it needs).
TAXONOMY = {
    "fixture-lexical-branch-miss": ("LEXICAL_MISS", "branch"),
    "fixture-semantic-branch-miss": ("SEMANTIC_MISS", "branch"),
    "fixture-fusion-union-ranked-low": ("FUSION_RANKING_ERROR", "fusion"),
    "fixture-evidence-selection-excluded": ("EVIDENCE_SELECTION_ERROR", "evidence_selection"),
    "fixture-answer-refused": ("FALSE_REFUSAL", None),
    "fixture-citation-structure-invalid": ("CITATION_STRUCTURAL_ERROR", None),
    "fixture-citation-semantic-unsupported": ("CITATION_SEMANTIC_UNSUPPORTED", None),
    "fixture-corpus-or-config-mismatch": ("CORPUS_OR_CONFIGURATION_MISMATCH", None),
    "fixture-observation-invalid": ("EVALUATION_OBSERVATION_FAILURE", None),
    "fixture-provider-failure": ("PROVIDER_ERROR", None),
    "fixture-infrastructure-failure": ("INFRASTRUCTURE_ERROR", None),
    "fixture-insufficient-evidence-correct": ("INSUFFICIENT_EVIDENCE_CORRECT", None),
}
# The failure kinds a handler may report, with the safe codes of each.
SAFE_CODES = {
    "invalid_input": ("invalid_input", "PDF_TEXT_INSUFFICIENT", "PDF_MALFORMED"),
    "unsupported_input": ("unsupported_input", "PDF_ENCRYPTED", "PDF_UNSUPPORTED"),
    "configuration_invalid": ("configuration_invalid",),
    "resource_limit": ("resource_limit", "PDF_RESOURCE_LIMIT_EXCEEDED"),
    "vector_mismatch": ("vector_mismatch",),
    "provider_transient": ("provider_transient",),
    "database_transient": ("database_transient",),
    "storage_transient": ("storage_transient",),
    "worker_unexpected": ("worker_unexpected", "PDF_EXTRACTOR_UNAVAILABLE"),
}
# The alert classes a configuration has to define, and the metrics they may watch.
ALERT_CLASSES = ("queue_age_contention", "repeated_lease_expiry_recovery", "cleanup_backlog", "unreconciled_orphan_growth")
METRICS = (
    "queue_depth", "oldest_job_age", "claim_latency_count", "claim_latency_sum", "retry_rate", "lease_expiry_recovery_total",
    "cleanup_attempt_total", "cleanup_failure_total", "orphan_discovery_total", "orphan_reconciliation_total",
)
MAX_SYNC_BYTES, MAX_SYNC_TOKENS, MAX_SYNC_CHUNKS = 1 << 20, 50_000, 100


@dataclass(frozen=True)
class Retrieval:
    """One retrieval preset."""

    id: str
    strategy: str
    lexical_policy: str | None
    fusion_policy: str | None
    min_similarity: float
    vector_k: int = 8
    fts_k: int = 8
    max_evidence_chunks: int = 5
    max_evidence_tokens: int = 3000


@dataclass(frozen=True)
class Chunking:
    """One chunking preset; the tokenizer is named, not contained."""

    id: str = "chunking-m1-v1"
    tokenizer: str = "whitespace"
    target_tokens: int = 500
    overlap_tokens: int = 75
    max_tokens: int = 650


@dataclass(frozen=True)
class Calibration:
    """Gates of the threshold calibration."""

    mean_recall: float = 0.90
    top_two: float = 0.90
    percentile: float = 0.10
    decimals: int = 12


PRESETS = {
    p.id: p
    for p in (
        Retrieval("retrieval-m1-v1", "vector", None, None, 0.65),
        Retrieval("retrieval-m3-rrf-v1", "hybrid", "fts-v1", "rrf-v1", 0.65),
        Retrieval("retrieval-m3-vector-v2", "vector", None, None, 0.657410732025),
        Retrieval("retrieval-m3-rrf-v2", "hybrid", "fts-m3-or-v2", "rrf-v2", 0.657410732025),
    )
}
