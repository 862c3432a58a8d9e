"""Fail-closed contracts as violation frames: a row for each breach, none where all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION = "subject string, rule string"


def violations(rows: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """subject, rule for each row and rule that does not hold (null does not hold); one pass over the rows."""
    said = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(subject.cast("string").alias("subject"), F.explode(said).alias("rule"))


def dangling(rows: DataFrame, key: str, known: DataFrame, rule: str) -> DataFrame:
    """References to nothing."""
    return rows.filter(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti").select(F.col(key).cast("string").alias("subject"), F.lit(rule).alias("rule"))


def not_once(rows: DataFrame, key: str, rule: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(key).cast("string").alias("subject"), F.lit(rule).alias("rule"))


def contradictions(rows: DataFrame, key: str, values: list[str], rule: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*values)).alias("n")).filter("n > 1").select(F.col(key).cast("string").alias("subject"), F.lit(rule).alias("rule"))


def set_difference(a: DataFrame, b: DataFrame, key: str, rules: tuple[str, str]) -> DataFrame:
    """What only one of two key sets has."""
    return dangling(a, key, b, rules[0]).union(dangling(b, key, a, rules[1]))


def disjoint(a: DataFrame, b: DataFrame, key: str, rule: str) -> DataFrame:
    """Keys that two sets which must be apart have in common."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi").select(F.col(key).cast("string").alias("subject"), F.lit(rule).alias("rule"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts)


def require_none(found: DataFrame, limit: int = 20) -> None:
    """Raise with the first violations, if there are any."""
    first = found.limit(limit).collect()
    if first:
        raise ValueError("contract violated: " + "; ".join(f"{r['subject']}: {r['rule']}" for r in first))


def out_of_order(rows: DataFrame, by: str, rank: str, rule: str) -> DataFrame:
    """Groups whose ranks are not exactly 1, 2, ... n: by counts, sums and extremes, without sorting."""
    n = F.count("*")
    whole = (F.min(rank) == 1) & (F.max(rank) == n) & (F.count_distinct(rank) == n)
    return rows.groupBy(by).agg(whole.alias("ok")).filter("NOT ok").select(F.col(by).cast("string").alias("subject"), F.lit(rule).alias("rule"))


def embedding_rules(vector: Column, dimensions: int) -> dict[str, Column]:
    return {
        "dimensions": F.size(vector) == dimensions,
        "finite": F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
        "not zero": F.exists(vector, lambda x: x != 0),
    }


def fused_rules() -> dict[str, Column]:
    """Fusion scores follow from the branch ranks within 1e-12."""
    part = lambda c: F.coalesce(1.0 / (60 + F.col(c)), F.lit(0.0))
    return {
        "has a branch": F.col("vector_rank").isNotNull() | F.col("fts_rank").isNotNull(),
        "score": F.abs(F.col("fusion_score") - part("vector_rank") - part("fts_rank")) <= 1e-12,
        "similarity with rank": F.col("similarity").isNotNull() == F.col("vector_rank").isNotNull(),
    }


def histogram_rules(hist: DataFrame) -> DataFrame:
    """Cumulative counts never fall, bounds rise and the last is unbounded."""
    listed = hist.agg(F.array_sort(F.collect_list(F.struct("bound", "count"))).alias("h"))
    rising = F.aggregate("h", F.struct(F.lit(True).alias("ok"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct((s["ok"] & (x["count"] >= s["n"])).alias("ok"), x["count"].alias("n")), lambda s: s["ok"])
    return violations(listed, F.lit("histogram"), {"cumulative": rising, "unbounded": F.element_at("h", -1)["bound"] == float("inf")})


def case_breaches(cases: DataFrame) -> DataFrame:
    """subject, rule: what is wrong with evaluation cases (the nested schema of `sources.files.M3_CASE`).

    An answer needs relevance, facts and evidence and no refusal; a refusal needs none of them and its reason; ids are unique.
    """
    answer, refusal = F.col("expected_behavior") == "ANSWER", F.col("expected_behavior") == "REFUSAL"
    named = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    relevant, facts = F.col("retrieval_relevance.acceptable_relevant_chunks"), F.col("answer_expectations.required_facts")
    sources, cited = F.col("evidence_expectations.expected_source_documents"), F.col("evidence_expectations.acceptable_cited_chunks")
    applicable = F.coalesce(F.col("retrieval_relevance.applicable"), F.lit(False))
    rules = {
        "scalars": named("id") & named("category") & named("workspace_id") & named("question"),
        "behavior": answer | refusal,
        "applicability": F.col("retrieval_relevance.applicable").isNotNull(),
        "answer": ~answer | (applicable & some(relevant) & some(facts) & some(sources) & some(cited) & F.col("refusal_expectation").isNull()),
        "refusal": ~refusal | (~applicable & ~some(relevant) & ~some(facts) & F.coalesce(F.col("refusal_expectation") == "INSUFFICIENT_EVIDENCE", F.lit(False))),
    }
    return violations(cases, F.col("id"), rules).union(not_once(cases, "id", "case once"))
