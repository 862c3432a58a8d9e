"""Retrieval metrics, breakdowns, calibration and comparisons."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TAXONOMY, Calibration
from ..functions import rational as ra
from ..sources.versions import shared_folder


def case_metrics(cases: DataFrame, k: int = 8) -> DataFrame:
    """`cases` (gold, retrieved: arrays) with hits, recall as hits/size and first_rank (over the whole list; null: none)."""
    top = F.slice("retrieved", 1, k)
    hits = F.size(F.array_intersect(top, "gold"))
    first = F.array_min(F.filter(F.transform("retrieved", lambda x, i: F.when(F.array_contains("gold", x), i + 1)), lambda r: r.isNotNull()))
    return cases.withColumns({"hits": hits.cast("long"), "gold_size": F.size("gold").cast("long"), "first_rank": first.cast("long")})


def retrieval_scores(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, recall, mrr, hit_rate over scored cases; a miss counts as 0."""
    recall, rr = F.col("hits") / F.col("gold_size"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0))
    return cases.filter("gold_size > 0").groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(recall).alias("recall"), F.avg(rr).alias("mrr"), F.avg(F.col("first_rank").isNotNull().cast("double")).alias("hit_rate"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the fractions p/q and of n, as one row."""
    sys.set_int_max_str_digits(0)
    n, total = 0, Fraction(0)
    for b in batches:
        for k, p, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n, total = n + k, total + Fraction(int(p), int(q))
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([str(total.numerator)]), pa.array([str(total.denominator)])], names=["n", "p", "q"])


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _fold(batches):
        n, p, q = (c[0].as_py() for c in b.columns)
        if n:
            mean = Fraction(int(p), int(q)) / n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([str(mean.numerator)]), pa.array([str(mean.denominator)])], names=b.schema.names)


def exact_mean_text(rows: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """n, numerator, denominator (decimal digits): the mean of fractions as a reduced fraction, exact for any denominators.

    Numerators are added by denominator first, so what is folded in big integers is a row for each different denominator; each
    task folds its own, and one task the folds. A null or a denominator below 1 is an error; no rows give no row.
    """
    bad = F.col(numerator).isNull() | F.col(denominator).isNull() | (F.col(denominator) < 1)
    checked = F.when(bad, F.raise_error(F.lit("a fraction needs a numerator and a denominator of 1 or more"))).otherwise(F.col(denominator).cast("long"))
    added = rows.groupBy(checked.alias("q")).agg(F.count("*").alias("n"), F.sum(F.col(numerator).cast("decimal(38,0)")).alias("p"))
    folds = added.select("n", F.col("p").cast("string").alias("p"), F.col("q").cast("string").alias("q")).mapInArrow(_fold, "n long, p string, q string")
    done = folds.repartition(1).mapInArrow(_mean, "n long, p string, q string")
    return done.select("n", F.col("p").alias("numerator"), F.col("q").alias("denominator"))


def exact_mean(rows: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """`exact_mean_text` in longs; a mean that does not fit is an error, never another number."""
    return exact_mean_text(rows, numerator, denominator).select("n", *[F.col(c).cast("decimal(38,0)").cast("long").alias(c) for c in ("numerator", "denominator")])


def breakdown(rows: DataFrame, by: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates a category and over all in one pass (grouping sets); the total has a null category and is_total true."""
    return rows.groupingSets([[by], []], by).agg(F.grouping(by).cast("boolean").alias("is_total"), *aggregates)


def calibrate(cases: DataFrame, hard_negatives: DataFrame, policy: Calibration | None = None) -> DataFrame:
    """One row: passed, threshold, the four gates. `cases`: case_id, gold (array), top: array of (chunk_id, similarity) best first.

    Candidates for the threshold are the distinct rounded scores; one qualifies if cutting there loses no gold and
    all hard negatives stay below. Instead of trying every boundary on every case: a boundary keeps a case's recall
    exactly if it is at most the case's lowest gold score, so the best is the largest boundary at most the least of
    those.
    """
    policy = policy or Calibration()
    gold = F.filter("top", lambda t: F.array_contains("gold", t["chunk_id"]))
    rows = cases.withColumn("found", gold)
    rows = rows.select("case_id", "top", (F.size("found") / F.size("gold")).alias("recall"), F.array_max(F.transform("found", lambda t: t["similarity"])).alias("best_gold"), F.array_min(F.transform("found", lambda t: t["similarity"])).alias("worst_gold"), F.exists(F.slice("top", 1, 2), lambda t: F.array_contains("gold", t["chunk_id"])).alias("top_two"))
    one = rows.agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg(F.col("top_two").cast("double")).alias("top_two"), F.count("best_gold").alias("n_found"), F.expr(f"percentile_disc({policy.percentile}) WITHIN GROUP (ORDER BY best_gold)").alias("p"), F.min("worst_gold").alias("limit"))
    hard = hard_negatives.agg(F.coalesce(F.max("similarity"), F.lit(float("-inf"))).alias("hard"))
    scores = cases.select(F.explode("top").alias("t")).select(F.round("t.similarity", policy.decimals).alias("score"))
    limits = one.crossJoin(hard)
    kept = scores.join(limits.select("limit", "hard"), (F.col("score") <= F.coalesce("limit", F.lit(float("inf")))) & (F.col("score") > F.col("hard"))).agg(F.max("score").alias("threshold"))
    done = limits.crossJoin(kept)
    low = F.when(F.col("n_found") == F.col("n"), F.col("p")).otherwise(F.lit(float("-inf")))
    gates = [F.col("recall") >= policy.mean_recall, F.col("top_two") >= policy.top_two, F.col("hard") < low, F.col("threshold").isNotNull()]
    done = done.select(*[g.alias(f"gate_{i}") for i, g in enumerate(gates, 1)], "threshold")
    passed = F.col("gate_1") & F.col("gate_2") & F.col("gate_3") & F.col("gate_4")
    return done.select(passed.alias("passed"), F.when(passed, F.col("threshold")).alias("threshold"), "gate_1", "gate_2", "gate_3", "gate_4")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written to the shared folder and read back, for steps that read them several times."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def overlap_pairs(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """left_id, right_id, common, smaller, exact: pairs of token sets that share at least `least` of the smaller set.

    `left` and `right`: id, words (distinct tokens) and said (the normalized text, where equal ones are to be told as exact). Prefix
    filtering instead of a cross join: in any order of its tokens, a set that shares that much of itself has one of its
    first size - ceil(least * size) + 1 tokens in common, so the prefix of the smaller set meets all tokens of the larger.
    Tokens that are rare on the other side come first. Only the smaller set of a pair is ranked: of the left side those that are
    smaller than some set of the right side, so a large left side is counted by token but never sorted. Sets are folded
    once and written; whole ones are looked at for the pairs found, and texts are compared by their hash.
    """
    said = lambda x: F.col("said") if "said" in x.columns else F.array_join(F.array_sort("words"), " ")
    sized = lambda x: x.filter(F.size("words") > 0).select("id", F.sha2(said(x), 256).alias("said"), F.size("words").alias("n"), "words")
    a, b = stored(sized(left), "overlap-left"), stored(sized(right), "overlap-right")
    tokens = lambda x: x.select("id", "n", F.explode("words").alias("token"))
    one, two = tokens(a), tokens(b)
    in_right = two.groupBy("token").agg(F.count("*").alias("df"))
    in_left = one.join(in_right.select("token"), "token").groupBy("token").agg(F.count("*").alias("df"))

    def prefixes(rows: DataFrame, elsewhere: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
        need = F.col("n") - F.ceil(F.round(F.col("n") * least, 9)).cast("int") + 1
        ranked = rows.join(elsewhere, "token", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("in_prefix", place <= need)
        return ranked.filter("in_prefix AND df > 0").select("id", "n", "token")

    largest = F.broadcast(b.agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest")))  # one row
    short = tokens(a.crossJoin(largest).filter("n < largest"))
    from_right = prefixes(two, in_left).toDF("right_id", "right_n", "token").join(one.toDF("left_id", "left_n", "token"), "token").filter("right_n <= left_n")
    from_left = prefixes(short, in_right).toDF("left_id", "left_n", "token").join(two.toDF("right_id", "right_n", "token"), "token").filter("left_n < right_n")
    pairs = from_right.select("left_id", "right_id").union(from_left.select("left_id", "right_id")).distinct()
    full = pairs.join(a.select(F.col("id").alias("left_id"), F.col("words").alias("wa"), F.col("said").alias("sa")), "left_id")
    full = full.join(b.select(F.col("id").alias("right_id"), F.col("words").alias("wb"), F.col("said").alias("sb")), "right_id")
    full = full.select("left_id", "right_id", F.size(F.array_intersect("wa", "wb")).alias("common"), F.least(F.size("wa"), F.size("wb")).alias("smaller"), (F.col("sa") == F.col("sb")).alias("exact"))
    return full.filter(F.col("common") >= F.round(least * F.col("smaller"), 9))


def paired(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Both runs a case with the differences b - a; a case that one run lacks has nulls, which validation reports."""
    left = a.select(key, *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(key, *[F.col(v).alias(f"{v}_b") for v in values])
    return left.join(right, key, "full_outer").withColumns({f"{v}_delta": F.col(f"{v}_b") - F.col(f"{v}_a") for v in values})


def exact_delta(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """b - a of two fractions (numerator, denominator) as a reduced fraction, by cross multiplication; no rounding decides its sign."""
    return ra.reduced(b[0] * a[1] - a[0] * b[1], a[1] * b[1])


def claim_decision(deltas: list[Column], guardrails: Column) -> Column:
    """CLAIM if no delta (a number, or the numerator of an exact one) is negative, one is positive and the guardrails hold."""
    none_below = ~sum(((d < 0).cast("int") for d in deltas[1:]), (deltas[0] < 0).cast("int")).cast("boolean")
    some_above = sum(((d > 0).cast("int") for d in deltas[1:]), (deltas[0] > 0).cast("int")) > 0
    return F.when(~guardrails, "GUARDRAIL_FAILURE").when(none_below & some_above, "CLAIM").otherwise("NO_QUALIFYING_DELTA")


def summed_maps(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """by, name, total: the sum of map values by key."""
    return rows.select(*by, F.explode(column).alias("name", "value")).groupBy(*by, "name").agg(F.sum("value").alias("total"))


def cost(tokens: Column, price_per_million: str) -> Column:
    """Exact decimal cost of tokens."""
    return (tokens.cast("decimal(20,0)") * F.lit(price_per_million).cast("decimal(12,6)") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(38,12)")


def single_or_mixed(column: str) -> Column:
    """The only value of a group, else mixed: an aggregate."""
    return F.when(F.min(column) == F.max(column), F.min(column).cast("string")).otherwise(F.lit("mixed"))


def classify_findings(findings: DataFrame) -> DataFrame:
    """`findings` (fixture, stage, gold_present, miss_confirmed) with class of the closed taxonomy, or problem.

    Fixtures of a stage need that stage, others none; a branch's miss also needs its evidence.
    """
    rows = [F.struct(F.lit(k).alias("fixture"), F.lit(v[0]).alias("class"), F.lit(v[1]).cast("string").alias("wanted")) for k, v in TAXONOMY.items()]
    known = F.filter(F.array(*rows), lambda x: x["fixture"] == F.col("fixture"))
    found = findings.withColumn("__t", F.get(known, 0))
    wanted = F.col("__t.wanted")
    proven = F.coalesce(F.col("gold_present") & F.col("miss_confirmed"), F.lit(False))
    problem = F.when(F.col("__t").isNull(), "UNKNOWN_TAXONOMY_FIXTURE").when(~F.col("stage").eqNullSafe(wanted) | ((wanted == "branch") & ~proven), "STAGE_PRECONDITION_INVALID")
    return found.withColumn("problem", problem).withColumn("class", F.when(F.col("problem").isNull(), F.col("__t.class"))).drop("__t")


def review_verdict(findings: DataFrame, by: str) -> DataFrame:
    """by, criticals, majors and verdict: BLOCK on any critical finding, REQUEST_CHANGES on any major one, else APPROVE."""
    rows = findings.groupBy(by).agg(F.count_if(F.col("severity") == "critical").alias("criticals"), F.count_if(F.col("severity") == "major").alias("majors"))
    return rows.withColumn("verdict", F.when(F.col("criticals") > 0, "BLOCK").when(F.col("majors") > 0, "REQUEST_CHANGES").otherwise("APPROVE"))
