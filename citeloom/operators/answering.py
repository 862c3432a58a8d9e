"""Deterministic answers, refusals, citations and the checks on generated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

EXCERPT = 500


def answers(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, decision, answer, refusal_reason: the first evidence with its marker, or a refusal without any.

    `evidence`: query_id, alias, final_rank, content.
    """
    first = evidence.groupBy("query_id").agg(F.min_by(F.struct("alias", "content"), "final_rank").alias("e"))
    rows = queries.select("query_id").join(first, "query_id", "left")
    answer = F.concat(F.col("e.content"), F.lit(" [["), F.col("e.alias"), F.lit("]]"))
    found = F.col("e").isNotNull()
    return rows.select("query_id", F.when(found, "ANSWER").otherwise("REFUSAL").alias("decision"), F.when(found, answer).alias("answer"), F.when(~found, "INSUFFICIENT_EVIDENCE").alias("refusal_reason"))


def valid_answer(answer: Column, cited: Column, available: Column) -> Column:
    """Markers well formed, distinct, all available, and exactly the cited aliases in order."""
    said = tx.markers(answer)
    return (
        answer.isNotNull()
        & (F.length(F.trim(answer)) > 0)
        & tx.markers_well_formed(answer)
        & (F.size(said) > 0)
        & (F.size(F.array_distinct(said)) == F.size(said))
        & (F.size(F.array_except(said, available)) == 0)
        & (said == cited)
    )


def citations(answered: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, position, alias, reference, excerpt: in order of the first marker."""
    said = answered.filter(F.col("answer").isNotNull()).select("query_id", F.posexplode(F.array_distinct(tx.markers(F.col("answer")))).alias("position", "alias"))
    rows = said.join(evidence, ["query_id", "alias"])
    return rows.select("query_id", "position", "alias", tx.chunk_reference(F.col("source_key"), F.col("ordinal")).alias("reference"), F.substring("content", 1, EXCERPT).alias("excerpt"))
