"""Retrieval queries: branches, fusion, observations, isolation and provenance."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRESETS
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import index as ix
from ..operators import retrieval as rt
from ..sources.files import table
from ..sources.versions import shared_folder
from . import common as c

HOME = ["workspace_id"]


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunks of each query vector's workspace at or above the threshold."""
    found = rt.vector_branch(c.vector_queries(spark, sf_dir), c.vector_chunks(spark, sf_dir), c.K, c.MIN_SIMILARITY, HOME)
    return found.select("query_id", "chunk_id", "similarity", F.col("branch_rank").cast("long").alias("branch_rank"))


VECTOR_SQL = (
    "SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, "
    + c.SQL_COS.format(a="q.embedding", b="c.embedding")
    + " AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, c.vec_id) AS branch_rank"
    " FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 20 = 0 AND similarity {op} 0.05 QUALIFY branch_rank <= 8"
)


def vector_below_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunks below the threshold."""
    found = rt.vector_below(c.vector_queries(spark, sf_dir), c.vector_chunks(spark, sf_dir), c.K, c.MIN_SIMILARITY, HOME)
    return found.select("query_id", "chunk_id", "similarity", F.col("branch_rank").cast("long").alias("branch_rank"))


def vector_norm_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions, norm and finiteness of every vector."""
    v = vx.doubles(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(vx.norm(v), 9).alias("norm"), vx.finite(v).alias("is_finite"))


def lexeme_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search lexemes and omitted tokens of every benchmark text."""
    q = c.questions(spark, sf_dir).withColumn("folded", tx.full_fold(F.col("question")))
    return q.select("query_id", F.array_join(F.array_sort(tx.lexemes(F.col("folded"), True)), " ").alias("lexemes"), F.array_join(F.array_sort(tx.omitted(F.col("folded"), True)), " ").alias("omitted"))


def tsvector_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and distinct tokens of every document."""
    t = tx.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def fts_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 documents with most occurrences of each benchmark text's lexemes."""
    return rt.fts_branch(c.questions(spark, sf_dir), _whole(spark, sf_dir), c.K, False, []).select("query_id", "chunk_id", "native_rank", F.col("branch_rank").cast("long").alias("branch_rank"))


def fts_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with every lexeme of a benchmark text, the 8 best by cover density."""
    return rt.fts_branch(c.questions(spark, sf_dir), _whole(spark, sf_dir), c.K, True, []).select("query_id", "chunk_id", "native_rank", F.col("branch_rank").cast("long").alias("branch_rank"))


def _indexed(spark: SparkSession, sf_dir: str, every: bool) -> DataFrame:
    """The same from an index that is written to the shared folder first and read by the questions' buckets."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    ix.write_index(_whole(spark, sf_dir), path)
    found = ix.search(ix.read_index(spark, path), c.questions(spark, sf_dir), c.K, every)
    return found.select("query_id", "chunk_id", "native_rank", F.col("branch_rank").cast("long").alias("branch_rank"))


def index_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`fts_or_topk` from the kept index."""
    return _indexed(spark, sf_dir, False)


def index_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`fts_and_topk` from the kept index."""
    return _indexed(spark, sf_dir, True)


FTS_SQL = (
    "WITH lex AS (SELECT item_id AS query_id, unnest(" + c.sql_lexemes("text") + ") AS token FROM benchmark), "
    "said AS (SELECT doc_id AS chunk_id, unnest(" + c.sql_tokens("text") + ") AS token FROM documents), "
    "m AS (SELECT query_id, chunk_id, count(*) AS native_rank FROM said JOIN lex USING (token) GROUP BY ALL) "
    "SELECT query_id, chunk_id, native_rank, row_number() OVER (PARTITION BY query_id ORDER BY native_rank DESC, chunk_id) AS branch_rank FROM m QUALIFY branch_rank <= 8"
)


COVER_SQL = (
    "WITH lex AS (SELECT item_id AS query_id, unnest(" + c.sql_lexemes("text") + ") AS token FROM benchmark), "
    "toks AS (SELECT doc_id AS chunk_id, " + c.sql_tokens("text") + " AS t FROM documents), "
    "said AS (SELECT chunk_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM toks), "
    "h AS (SELECT query_id, chunk_id, token, pos, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS k FROM said JOIN lex USING (token)), "
    "n AS (SELECT query_id, count(*) AS n FROM lex GROUP BY query_id), "
    "ok AS (SELECT query_id, chunk_id FROM h JOIN n USING (query_id) GROUP BY query_id, chunk_id, n HAVING count(DISTINCT token) = n), "
    "e AS (SELECT h.query_id, h.chunk_id, h.k, h.pos, max(CASE WHEN h.token = l.token THEN h.k END) OVER (PARTITION BY h.query_id, h.chunk_id, l.token ORDER BY h.k) AS seen "
    "FROM h JOIN ok ON h.query_id = ok.query_id AND h.chunk_id = ok.chunk_id JOIN lex l ON l.query_id = h.query_id), "
    "b AS (SELECT query_id, chunk_id, k, pos, min(seen) AS first FROM e GROUP BY query_id, chunk_id, k, pos HAVING count(seen) = count(*)), "
    "v AS (SELECT query_id, chunk_id, first, min(k) AS k, min(pos) AS pos FROM b GROUP BY query_id, chunk_id, first), "
    "m AS (SELECT v.query_id, v.chunk_id, round(sum(0.1::DOUBLE / (1 + (v.pos - h.pos) - (v.k - v.first))), 9) AS native_rank "
    "FROM v JOIN h ON h.query_id = v.query_id AND h.chunk_id = v.chunk_id AND h.k = v.first GROUP BY v.query_id, v.chunk_id) "
    "SELECT query_id, chunk_id, native_rank, row_number() OVER (PARTITION BY query_id ORDER BY native_rank DESC, chunk_id) AS branch_rank FROM m QUALIFY branch_rank <= 8"
)


def branches(spark: SparkSession, sf_dir: str, preset_id: str = "retrieval-m3-rrf-v1") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(vector, below, full text, all matches) of the hybrid queries, as the preset `preset` names them.

    Vector ties go by source key, ordinal and chunk (one document a key here); full-text ties by chunk under fts-v1 and by
    source key, ordinal and chunk under fts-m3-or-v2. A preset of strategy vector has an empty full-text branch.
    """
    preset = PRESETS[preset_id]
    q, chunks = c.hybrid_queries(spark, sf_dir), c.hybrid_chunks(spark, sf_dir)
    sides = rt.vector_sides(q, chunks, preset.vector_k, c.MIN_SIMILARITY, HOME, ["source_key", "ordinal", "chunk_id"])
    vector, below = sides.filter("eligible").drop("eligible"), sides.filter("NOT eligible").drop("eligible")
    keys = chunks.select("chunk_id", "source_key", "ordinal")
    matches = rt.fts_matches(q, chunks, False, HOME).join(keys, "chunk_id")
    if preset.strategy == "vector":
        matches = matches.filter("false")
    ties = ["source_key", "ordinal", "chunk_id"] if preset.lexical_policy == "fts-m3-or-v2" else ["chunk_id"]
    return vector, below, rt.top_k(matches, [F.desc("native_rank"), *[F.asc(t) for t in ties]], preset.fts_k), matches


def fused(spark: SparkSession, sf_dir: str, preset_id: str) -> DataFrame:
    """The candidates of a hybrid preset, ranked by its fusion policy."""
    vector, _, fts, _ = branches(spark, sf_dir, preset_id)
    return rt.fuse(vector, fts, ["source_key", "ordinal"] if PRESETS[preset_id].fusion_policy == "rrf-v2" else None)


def _fused_columns(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "chunk_id", *[F.col(x).cast("long").alias(x) for x in ("vector_rank", "fts_rank", "fused_rank")], "fusion_score")


def rrf_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion, ties by chunk."""
    return _fused_columns(fused(spark, sf_dir, "retrieval-m3-rrf-v1"))


def rrf_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion, ties by source key, ordinal and chunk."""
    return _fused_columns(fused(spark, sf_dir, "retrieval-m3-rrf-v2"))


def preset_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every preset: vector presets keep a fusion score of 0, hybrid ones fuse."""
    rows = []
    for preset in PRESETS.values():
        if preset.strategy == "hybrid":
            found = fused(spark, sf_dir, preset.id).select("query_id", "chunk_id", "fused_rank", "fusion_score")
        else:
            found = branches(spark, sf_dir, preset.id)[0].select("query_id", "chunk_id", F.col("branch_rank").alias("fused_rank"), F.lit(0.0).alias("fusion_score"))
        rows.append(found.select(F.lit(preset.id).alias("preset"), "query_id", "chunk_id", F.col("fused_rank").cast("long").alias("rank"), "fusion_score"))
    return reduce(DataFrame.union, rows)


RRF_SQL = "WITH " + c.SQL_FUSED + " SELECT query_id, chunk_id, vector_rank, fts_rank, fused_rank, fusion_score FROM fused"


def branch_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What either branch says of each candidate."""
    rows = rt.observations(*branches(spark, sf_dir))
    return rows.withColumn("branch_rank", F.col("branch_rank").cast("long"))


_RANKED = "SELECT '{p}' AS preset, query_id, chunk_id, fused_rank AS rank, fusion_score FROM ({q})"
_NEAREST = "WITH " + c.SQL_HYBRID + " SELECT query_id, chunk_id, vector_rank AS fused_rank, 0.0::DOUBLE AS fusion_score FROM vec"
PRESETS_SQL = " UNION ALL ".join(
    _RANKED.format(p=p.id, q=_NEAREST.replace("{ties}", "") if p.strategy == "vector" else c.tied(RRF_SQL, "source_key, ordinal, " if p.fusion_policy == "rrf-v2" else ""))
    for p in PRESETS.values()
)

OBSERVATIONS_SQL = (
    "WITH " + c.SQL_HYBRID.replace("{ties}", "") + """
SELECT query_id, chunk_id, 'vector' AS branch, 'ELIGIBLE' AS status, vector_rank AS branch_rank FROM vec
UNION ALL SELECT query_id, chunk_id, 'vector', 'BELOW_THRESHOLD', NULL FROM below
UNION ALL SELECT query_id, chunk_id, 'vector', 'NO_CONTRIBUTION', NULL FROM fts f
  WHERE NOT EXISTS (SELECT 1 FROM vec v WHERE v.query_id = f.query_id AND v.chunk_id = f.chunk_id)
    AND NOT EXISTS (SELECT 1 FROM below v WHERE v.query_id = f.query_id AND v.chunk_id = f.chunk_id)
UNION ALL SELECT query_id, chunk_id, 'fts', 'ELIGIBLE', fts_rank FROM fts
UNION ALL SELECT v.query_id, v.chunk_id, 'fts', CASE WHEN m.chunk_id IS NULL THEN 'INELIGIBLE' ELSE 'NO_CONTRIBUTION' END, NULL
  FROM vec v LEFT JOIN matches m ON m.query_id = v.query_id AND m.chunk_id = v.chunk_id
  WHERE NOT EXISTS (SELECT 1 FROM fts f WHERE f.query_id = v.query_id AND f.chunk_id = v.chunk_id)"""
)


def fts_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the vector branch's candidates match the query's text."""
    vector, _, _, matches = branches(spark, sf_dir)
    rows = vector.join(matches.select("query_id", "chunk_id", F.lit(True).alias("m")), ["query_id", "chunk_id"], "left")
    return rows.select("query_id", "chunk_id", F.coalesce("m", F.lit(False)).alias("eligible"))


ELIGIBLE_SQL = "WITH " + c.SQL_HYBRID.replace("{ties}", "") + " SELECT v.query_id, v.chunk_id, m.chunk_id IS NOT NULL AS eligible FROM vec v LEFT JOIN matches m ON m.query_id = v.query_id AND m.chunk_id = v.chunk_id"


def workspace_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of either branch by query, and those from another workspace (none)."""
    vector, _, fts, _ = branches(spark, sf_dir)
    home = c.hybrid_queries(spark, sf_dir).select("query_id", F.col("workspace_id").alias("home"))
    where = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("found_in"))
    rows = vector.select("query_id", "chunk_id").union(fts.select("query_id", "chunk_id")).join(home, "query_id").join(where, "chunk_id")
    return rows.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("home") != F.col("found_in")).alias("leaks"))


ISOLATION_SQL = "WITH " + c.SQL_HYBRID.replace("{ties}", "") + " SELECT query_id, count(*) AS candidates, CAST(count_if(k.source <> q.source) AS BIGINT) AS leaks FROM (SELECT query_id, chunk_id FROM vec UNION ALL SELECT query_id, chunk_id FROM fts) JOIN documents q ON q.doc_id = query_id JOIN documents k ON k.doc_id = chunk_id GROUP BY query_id"


def active_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct configurations (labels) of the active vectors of each workspace, with documents and latest id."""
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    rows = docs.join(vecs, docs["doc_id"] == vecs["vec_id"])
    return rows.groupBy(F.col("source").alias("workspace_id"), F.col("label").cast("long").alias("configuration")).agg(F.count_distinct("doc_id").alias("documents"), F.max("doc_id").alias("latest"))


def v2_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the workspaces whose vectors are complete for all their documents of the vectors' range."""
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    rows = docs.join(vecs.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has")), "doc_id", "left")
    cut = rows.groupBy(F.col("source").alias("workspace_id")).agg(F.count("*").alias("n"), F.count("has").alias("done"))
    cut = cut.withColumn("state", F.when(2 * F.col("done") >= F.col("n"), "completed").otherwise("pending"))
    return rt.gated(c.hybrid_queries(spark, sf_dir), cut).select("query_id", "workspace_id")


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old retriever: the first 3 documents with any longer word of a benchmark text."""
    return rt.keyword_search(c.questions(spark, sf_dir), _whole(spark, sf_dir)).select("query_id", "chunk_id", F.col("branch_rank").cast("long").alias("branch_rank"))


KEYWORD_SQL = (
    "WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(" + c.sql_tokens("text") + ", lambda t: length(t) >= 4))) AS token FROM benchmark), "
    "d AS (SELECT doc_id AS chunk_id, unnest(list_distinct(" + c.sql_tokens("text") + ")) AS token FROM documents), "
    "m AS (SELECT DISTINCT query_id, chunk_id FROM d JOIN q USING (token)) "
    "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS branch_rank FROM m QUALIFY branch_rank <= 3"
)

QUERIES = {f.__name__: f for f in (vector_topk, vector_below_threshold, vector_norm_audit, lexeme_normalize, tsvector_tokens, fts_or_topk, fts_and_topk, index_or_topk, index_and_topk, rrf_v1, rrf_v2, preset_strategies, branch_observations, fts_eligibility, workspace_isolation, active_provenance, v2_gate, keyword_search)}

ORACLE_SQL = {
    "vector_topk": VECTOR_SQL.replace("{op}", ">="),
    "vector_below_threshold": VECTOR_SQL.replace("{op}", "<"),
    "vector_norm_audit": "SELECT vec_id, len(embedding) AS dims, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS norm, len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS is_finite FROM embeddings",
    "lexeme_normalize": "SELECT item_id AS query_id, array_to_string(list_sort(" + c.sql_lexemes("text") + "), ' ') AS lexemes, array_to_string(list_sort(list_distinct(list_filter(" + c.sql_tokens("text") + ", lambda t: NOT " + c.sql_is_lexeme("t") + "))), ' ') AS omitted FROM benchmark",
    "tsvector_tokens": "SELECT doc_id, len(" + c.sql_tokens("text") + ") AS n_tokens, len(list_distinct(" + c.sql_tokens("text") + ")) AS n_distinct FROM documents",
    "fts_or_topk": FTS_SQL,
    "fts_and_topk": COVER_SQL,
    "index_or_topk": FTS_SQL,
    "index_and_topk": COVER_SQL,
    "rrf_v1": c.tied(RRF_SQL, ""),
    "rrf_v2": c.tied(RRF_SQL, "source_key, ordinal, "),
    "preset_strategies": PRESETS_SQL,
    "branch_observations": OBSERVATIONS_SQL,
    "fts_eligibility": ELIGIBLE_SQL,
    "workspace_isolation": ISOLATION_SQL,
    "active_provenance": "SELECT source AS workspace_id, CAST(label AS BIGINT) AS configuration, count(DISTINCT doc_id) AS documents, max(doc_id) AS latest FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY ALL",
    "v2_gate": "WITH cut AS (SELECT source AS workspace_id FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY source HAVING 2 * count(vec_id) >= count(*)) SELECT item_id AS query_id, source AS workspace_id FROM benchmark JOIN embeddings ON item_id = vec_id JOIN documents ON doc_id = item_id WHERE source IN (SELECT workspace_id FROM cut)",
    "keyword_search": KEYWORD_SQL,
}
