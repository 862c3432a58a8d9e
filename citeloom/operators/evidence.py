"""Greedy evidence selection as a fold over ranked candidates, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import REDUNDANCY_OVERLAP
from ..functions import text as tx

STATE = "array<struct<chunk_set:string,ordinal:bigint,words:array<string>>>"
DECISION = "array<struct<chunk_id:bigint,final_rank:int,outcome:string,selected_chunk_count:int,selected_token_count:bigint,token_count:bigint,token_total:bigint>>"


def redundant(candidate: Column, kept: Column) -> Column:
    """Neighbours in one chunk set that share at least half of the smaller word set."""
    smaller = F.least(F.size(candidate["words"]), F.size(kept["words"]))
    near = (candidate["chunk_set"] == kept["chunk_set"]) & (F.abs(candidate["ordinal"] - kept["ordinal"]) == 1)
    return near & (smaller > 0) & (F.size(F.array_intersect(candidate["words"], kept["words"])) >= REDUNDANCY_OVERLAP * smaller)


def select_evidence(candidates: DataFrame, max_chunks: int = 5, max_tokens: int = 3000) -> DataFrame:
    """A row per candidate: query_id, chunk_id, final_rank, outcome and the budget at its turn.

    `candidates`: query_id, fused_rank, chunk_id, chunk_set, ordinal, content, token_count. Tests in order:
    redundant, too many chunks, too many tokens, selected; what is skipped uses no budget. A query has at most
    the two branches' k candidates, so its list is short however large the corpus.
    """
    item = F.struct(F.col("fused_rank"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("chunk_set").cast("string").alias("chunk_set"), F.col("ordinal").cast("long").alias("ordinal"), tx.word_set(tx.full_fold(F.col("content")), folded=True).alias("words"), F.col("token_count").cast("long").alias("tokens"))
    listed = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.array().cast(STATE).alias("kept"), F.lit(0).cast("bigint").alias("tokens"), F.array().cast(DECISION).alias("decisions"))

    def step(acc: Column, x: Column) -> Column:
        count = F.size(acc["kept"])
        outcome = (
            F.when(F.exists(acc["kept"], lambda k: redundant(x, k)), "REDUNDANT_OVERLAP")
            .when(count >= max_chunks, "CHUNK_COUNT_LIMIT")
            .when(acc["tokens"] + x["tokens"] > max_tokens, "TOKEN_BUDGET_EXCEEDED")
            .otherwise("SELECTED")
        )
        taken = outcome == "SELECTED"
        kept = F.struct(x["chunk_set"].alias("chunk_set"), x["ordinal"].alias("ordinal"), x["words"].alias("words"))
        said = F.struct(x["chunk_id"].alias("chunk_id"), (F.size(acc["decisions"]) + 1).alias("final_rank"), outcome.alias("outcome"), count.alias("selected_chunk_count"), acc["tokens"].alias("selected_token_count"), x["tokens"].alias("token_count"), (acc["tokens"] + x["tokens"]).alias("token_total"))
        return F.struct(
            F.when(taken, F.concat(acc["kept"], F.array(kept))).otherwise(acc["kept"]).cast(STATE).alias("kept"),
            F.when(taken, acc["tokens"] + x["tokens"]).otherwise(acc["tokens"]).alias("tokens"),
            F.concat(acc["decisions"], F.array(said)).cast(DECISION).alias("decisions"),
        )

    folded = listed.select("query_id", F.aggregate("items", start, step, lambda acc: acc["decisions"]).alias("decisions"))
    return folded.select("query_id", F.explode("decisions").alias("d")).select("query_id", "d.*")


def final_decision(outcome: Column) -> tuple[Column, Column]:
    """(final decision, reason) of an outcome: both budgets end in BUDGET_EXCEEDED with a reason, others stand for themselves."""
    reason = F.when(outcome == "TOKEN_BUDGET_EXCEEDED", "TOKEN_BUDGET").when(outcome == "CHUNK_COUNT_LIMIT", "CHUNK_COUNT_LIMIT")
    return F.when(reason.isNotNull(), "BUDGET_EXCEEDED").otherwise(outcome), reason


def aliases(decisions: DataFrame) -> DataFrame:
    """The selected candidates with their aliases E1, E2, ... in rank order."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("final_rank"))
    return decisions.filter(F.col("outcome") == "SELECTED").withColumn("alias", F.concat(F.lit("E"), place.cast("string")))


def reconcile_budget(decisions: DataFrame, max_chunks: int, max_tokens: int) -> DataFrame:
    """Violations of the running totals: a row for each decision whose budget does not follow from those before."""
    before = Window.partitionBy("query_id").orderBy("final_rank").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.when(F.col("outcome") == "SELECTED", 1).otherwise(0)
    rows = decisions.withColumn("n", F.coalesce(F.sum(taken).over(before), F.lit(0))).withColumn("t", F.coalesce(F.sum(taken * F.col("token_count")).over(before), F.lit(0)))
    wrong = (F.col("n") != F.col("selected_chunk_count")) | (F.col("t") != F.col("selected_token_count")) | (F.col("token_total") != F.col("t") + F.col("token_count"))
    over = (F.col("outcome") == "SELECTED") & ((F.col("n") >= max_chunks) | (F.col("token_total") > max_tokens))
    return rows.filter(wrong | over).select("query_id", "chunk_id", "final_rank")
