"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document draws an exponential key, -ln(u) divided by its quality weight, u a hash of its id and a seed.
Within a source, documents in key order form a weighted sample without replacement (Efraimidis and Spirakis,
2006). A source's budget is first spent on complete epochs; what is left goes to documents in key order until
their prefix sum reaches the budget, the last one in part.

A source may hold any share of the rows, so no prefix sum runs over a whole source in one task: keys are cut
into ranges of at most about `bucket_rows` documents, ranges are summed, and a document adds the sum of the
ranges before its own to its prefix within the range. Ranges are cut evenly in log2 of the key: a factor of two
holds at most 0.26 of the keys of a source wherever it lies, as x exp(-x) is at most 1/e for every weight, so the
bound holds for any weights and any mixture of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
QUALITY_WEIGHT = {1: 1.0, 0: 0.25, None: 0.5}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, target: one row per source.

    Sources in code point order (null last) weigh `weights`, repeating, and share `share` of all words by weight,
    none above `most` times its own; what is above is shared again. That is water filling: with sources in order
    of the level at which they are full, the level follows from the sums of those before.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int"))
    rows = totals.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    by_level = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent, gone = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (share * F.sum("source_size").over(everything) - spent) / (F.sum("w").over(everything) - gone)
    rows = rows.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("full_at"), F.col("level"))
    rows = rows.withColumn("level", F.first(fits, ignorenulls=True).over(everything))
    return rows.select("source", "source_size", "n_docs", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", bucket_rows: int = 512) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted) for `sized`.

    `sized`: doc_id, source, size (words), weight (quality, above 0; null counts as 1) and, if present, draw: what
    the key of a row without an id is drawn from (without it all null ids draw one key). Repeated rows are
    documents of their own with the same key, ordered by size; a null source is a source, the last. Documents
    without words take nothing. Other columns are not looked at. An empty table gives an empty mix.
    """
    nameless = F.coalesce("draw", F.lit("null")) if "draw" in sized.columns else F.lit("null")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), nameless))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    sized = sized.select("doc_id", "source", "size", (-F.log(u) / F.coalesce(F.col("weight"), F.lit(1.0))).alias("key"))
    sized = materialize(sized, "mix-sizes")
    targets = materialize(source_targets(sized, weights, share, most), "mix-targets").withColumnRenamed("source", "s")
    docs = sized.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    docs = docs.withColumn("range", F.floor(F.log2("key") * F.ceil(F.col("n_docs") / (4 * bucket_rows))).cast("long"))
    sums = docs.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("before"))
    docs = docs.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor(F.col("target")) - epochs * F.col("source_size") - before
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return docs.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def sized_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Word counts and quality weights: 1 for a document labelled good, 0.25 for bad, 0.5 without a label.

    A row for each row of `docs`, however often its id is labelled (good if any label says so). Null texts have no
    words; texts of any length are counted whole; rows without an id get the digest of their text as draw. Other
    columns are not looked at; an empty table gives none.
    """
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    draw = F.when(F.col("doc_id").isNull(), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("draw")).join(good, "doc_id", "left")
    weight = F.when(F.col("quality") == 1, QUALITY_WEIGHT[1]).when(F.col("quality") == 0, QUALITY_WEIGHT[0]).otherwise(QUALITY_WEIGHT[None])
    return sized.select("doc_id", "source", "size", weight.alias("weight"), "draw")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(sized_documents(docs, labels)).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS size,
    (-ln((CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null:' || md5(coalesce(d.text, '')))), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0))
      / CASE WHEN l.quality = 1 THEN 1.0 WHEN l.quality = 0 THEN 0.25 ELSE 0.5 END AS k
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS full_at FROM s),
v AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lvl
  FROM f WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, w * (SELECT arg_min(lvl, full_at) FROM v WHERE lvl <= full_at)) AS target FROM v),
m AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target / t.source_size) AS epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM m
"""
