"""Frames and SQL fragments that the registered queries share.

The tables stand in for the domain: a document is a document, its source the workspace, its non-blank lines
the chunks; vectors are those of `embeddings`; questions are the benchmark's texts; events are the attempts of
jobs (a user is a job). Vectors and texts of the tables are unrelated, so queries use a low threshold where a
preset's would select nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STOP_WORDS
from ..sources.files import table

MIN_SIMILARITY = 0.05
K = 8


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20; its label is its workspace."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("workspace_id"), F.col("embedding").alias("query_vector"))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("workspace_id"), F.col("embedding").alias("chunk_vector"))


def hybrid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector, as chunks."""
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    rows = docs.join(vecs, docs["doc_id"] == vecs["vec_id"])
    return rows.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("workspace_id"), F.concat(F.lit("doc/"), F.lpad((F.col("doc_id") % 97).cast("string"), 3, "0")).alias("source_key"), F.col("doc_id").alias("ordinal"), F.col("text").alias("content"), F.col("embedding").alias("chunk_vector"))


def hybrid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts with a vector, asked in the workspace of the document of the same number."""
    items, vecs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    homes = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("workspace_id"))
    rows = items.join(vecs, items["item_id"] == vecs["vec_id"]).join(homes, F.col("item_id") == homes["doc_id"])
    return rows.select(F.col("item_id").alias("query_id"), "workspace_id", F.col("text").alias("question"), F.col("embedding").alias("query_vector"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def sql_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_tokens(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace({sql_fold(x)}, '[\p{{P}}\p{{Z}}\p{{C}}\p{{S}}]', ' ', 'g'), ' +'), lambda t: t <> '')"


SQL_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def sql_is_lexeme(t: str) -> str:
    return rf"({t} NOT IN {SQL_STOP} AND regexp_matches({t}, '^[\p{{L}}\p{{N}}]+$'))"


def sql_lexemes(x: str) -> str:
    return f"list_distinct(list_filter({sql_tokens(x)}, lambda t: {sql_is_lexeme('t')}))"


SQL_COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 9)"

SQL_HYBRID = """
chunks AS (
  SELECT doc_id AS chunk_id, source AS workspace_id, 'doc/' || lpad(CAST(doc_id % 97 AS VARCHAR), 3, '0') AS source_key,
    doc_id AS ordinal, text AS content, embedding AS cv
  FROM documents JOIN embeddings ON doc_id = vec_id),
queries AS (
  SELECT item_id AS query_id, d.source AS workspace_id, b.text AS question, e.embedding AS qv
  FROM benchmark b JOIN embeddings e ON item_id = vec_id JOIN documents d ON d.doc_id = item_id),
sims AS (
  SELECT query_id, chunk_id, source_key, ordinal, """ + SQL_COS.format(a="qv", b="cv") + """ AS similarity
  FROM queries JOIN chunks USING (workspace_id)),
lex AS (SELECT query_id, workspace_id, unnest(""" + sql_lexemes("question") + """) AS token FROM queries),
said AS (SELECT chunk_id, workspace_id, source_key, ordinal, unnest(""" + sql_tokens("content") + """) AS token FROM chunks),
matches AS (
  SELECT query_id, chunk_id, source_key, ordinal, count(*) AS native_rank
  FROM said JOIN lex USING (workspace_id, token) GROUP BY ALL),
vec AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, source_key, ordinal, chunk_id) AS vector_rank
  FROM sims WHERE similarity >= 0.05 QUALIFY vector_rank <= 8),
below AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, source_key, ordinal, chunk_id) AS r
  FROM sims WHERE similarity < 0.05 QUALIFY r <= 8),
fts AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY native_rank DESC, {ties}chunk_id) AS fts_rank
  FROM matches QUALIFY fts_rank <= 8)"""

SQL_FUSED = SQL_HYBRID + """,
merged AS (
  SELECT query_id, chunk_id, coalesce(v.source_key, f.source_key) AS source_key, coalesce(v.ordinal, f.ordinal) AS ordinal,
    vector_rank, similarity, fts_rank, native_rank,
    round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + fts_rank), 0), 12) AS fusion_score
  FROM vec v FULL JOIN fts f USING (query_id, chunk_id)),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, {ties}chunk_id) AS fused_rank FROM merged)"""


def tied(sql: str, ties: str) -> str:
    """`sql` with the order that breaks ties of full-text and fused ranks."""
    return sql.replace("{ties}", ties)
