"""Evidence, answers, citations, chunks, digests and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions import text as tx
from ..functions import tokens as tk
from ..operators import answering as an
from ..operators import chunking as ch
from ..operators import derivation as de
from ..operators import evidence as ev
from ..sources.files import table
from . import common as c
from .retrieval_queries import COVER_SQL, fts_and_topk, fused

WINDOWS = Chunking(target_tokens=100, overlap_tokens=20, max_tokens=130)
MAX_CHUNKS, MAX_TOKENS = 5, 3000


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused candidates with what selection looks at: chunks are whole documents, their set is the workspace.

    Ordinals number a question's candidates by id, so that neighbours, which may be redundant, occur.
    """
    chunks = c.hybrid_chunks(spark, sf_dir).select("chunk_id", F.col("workspace_id").alias("chunk_set"), "source_key", "content")
    rows = fused(spark, sf_dir, "retrieval-m3-rrf-v1").select("query_id", "chunk_id", "fused_rank").join(chunks, "chunk_id")
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    return rows.withColumn("token_count", F.size(F.filter(F.split("content", r"\s+"), lambda t: t != "")))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.select_evidence(candidates(spark, sf_dir), MAX_CHUNKS, MAX_TOKENS)


def evidence_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome and budget of every candidate of every question."""
    rows = decisions(spark, sf_dir)
    final, reason = ev.final_decision(F.col("outcome"))
    return rows.select("query_id", "chunk_id", F.col("final_rank").cast("long").alias("final_rank"), "outcome", final.alias("final_decision"), reason.alias("decision_reason"), F.col("selected_chunk_count").cast("long").alias("selected_chunk_count"), "selected_token_count", "token_total")


EVIDENCE_SQL = (
    "WITH RECURSIVE " + c.tied(c.SQL_FUSED, "") + r""",
cand AS (
  SELECT f.query_id, f.chunk_id, f.fused_rank AS n, row_number() OVER (PARTITION BY f.query_id ORDER BY f.chunk_id) AS ordinal,
    list_distinct(list_transform(list_filter(string_split_regex(k.content, '\s+'), lambda t: t <> ''), lambda t: trim(""" + c.sql_fold("t") + r""", '.,!?;:()[]{}'))) AS words,
    len(list_filter(string_split_regex(k.content, '\s+'), lambda t: t <> '')) AS tokens
  FROM fused f JOIN chunks k USING (chunk_id)),
alike AS (
  SELECT a.query_id, a.n, b.n AS other FROM cand a JOIN cand b ON a.query_id = b.query_id AND b.n < a.n AND abs(a.ordinal - b.ordinal) = 1
  WHERE least(len(a.words), len(b.words)) > 0 AND len(list_intersect(a.words, b.words)) >= 0.5 * least(len(a.words), len(b.words))),
near AS (SELECT query_id, n, list(other) AS others FROM alike GROUP BY ALL),
steps AS (SELECT d.*, coalesce(others, []::BIGINT[]) AS others FROM cand d LEFT JOIN near USING (query_id, n)),
fold AS (
  SELECT query_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS chunk_id, CAST(NULL AS VARCHAR) AS outcome,
    CAST(0 AS BIGINT) AS kept, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS kept_before, CAST(0 AS BIGINT) AS used_before, CAST(0 AS BIGINT) AS tokens, []::BIGINT[] AS chosen
  FROM (SELECT DISTINCT query_id FROM cand)
  UNION ALL
  SELECT f.query_id, d.n, d.chunk_id, o.outcome, f.kept + CASE WHEN o.outcome = 'SELECTED' THEN 1 ELSE 0 END,
    f.used + CASE WHEN o.outcome = 'SELECTED' THEN d.tokens ELSE 0 END, f.kept, f.used, d.tokens,
    CASE WHEN o.outcome = 'SELECTED' THEN list_append(f.chosen, d.n) ELSE f.chosen END
  FROM fold f JOIN steps d ON d.query_id = f.query_id AND d.n = f.n + 1,
    LATERAL (SELECT CASE WHEN list_has_any(f.chosen, d.others) THEN 'REDUNDANT_OVERLAP' WHEN f.kept >= 5 THEN 'CHUNK_COUNT_LIMIT'
      WHEN f.used + d.tokens > 3000 THEN 'TOKEN_BUDGET_EXCEEDED' ELSE 'SELECTED' END AS outcome) o)
SELECT query_id, chunk_id, n AS final_rank, outcome,
  CASE WHEN outcome IN ('TOKEN_BUDGET_EXCEEDED', 'CHUNK_COUNT_LIMIT') THEN 'BUDGET_EXCEEDED' ELSE outcome END AS final_decision,
  CASE outcome WHEN 'TOKEN_BUDGET_EXCEEDED' THEN 'TOKEN_BUDGET' WHEN 'CHUNK_COUNT_LIMIT' THEN 'CHUNK_COUNT_LIMIT' END AS decision_reason,
  kept_before AS selected_chunk_count, used_before AS selected_token_count, used_before + tokens AS token_total
FROM fold WHERE n > 0"""
)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, alias, final_rank and the chunk of each selected candidate."""
    chosen = ev.aliases(decisions(spark, sf_dir)).select("query_id", "chunk_id", "final_rank", "alias")
    return chosen.join(c.hybrid_chunks(spark, sf_dir).select("chunk_id", "source_key", "ordinal", "content"), "chunk_id")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic answer of every benchmark question, or its refusal (questions without a vector have no evidence)."""
    rows = an.answers(c.questions(spark, sf_dir), evidence(spark, sf_dir))
    return rows.select("query_id", "decision", F.sha2("answer", 256).alias("answer_sha256"), "refusal_reason")


_CHOSEN = EVIDENCE_SQL.rpartition("SELECT query_id, chunk_id, n AS final_rank")[0] + ",\nchosen AS (SELECT query_id, chunk_id, n, row_number() OVER (PARTITION BY query_id ORDER BY n) AS a FROM fold WHERE outcome = 'SELECTED')\n"

ANSWERS_SQL = _CHOSEN + """SELECT b.item_id AS query_id, CASE WHEN a.content IS NULL THEN 'REFUSAL' ELSE 'ANSWER' END AS decision,
  sha256(a.content || ' [[E1]]') AS answer_sha256, CASE WHEN a.content IS NULL THEN 'INSUFFICIENT_EVIDENCE' END AS refusal_reason
FROM benchmark b LEFT JOIN (SELECT query_id, content FROM chosen JOIN chunks USING (chunk_id) WHERE a = 1) a ON a.query_id = b.item_id"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of answers that cite all their evidence, the last first: alias, reference and excerpt in order of the markers."""
    found = evidence(spark, sf_dir)
    last_first = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("final_rank", "alias")))), lambda x: F.concat(F.lit("[["), x["alias"], F.lit("]]"))), " and ")
    answered = found.groupBy("query_id").agg(F.concat(F.lit("see "), last_first).alias("answer"))
    rows = an.citations(answered, found)
    source, ordinal = tx.parse_reference(F.col("reference"))
    return rows.select("query_id", F.col("position").cast("long").alias("position"), "alias", "reference", source.alias("source_key"), ordinal.alias("ordinal"), F.sha2("excerpt", 256).alias("excerpt_sha256"))


CITATIONS_SQL = _CHOSEN + """SELECT query_id, max(a) OVER (PARTITION BY query_id) - a AS position, 'E' || CAST(a AS VARCHAR) AS alias,
  source_key || '#' || CAST(ordinal AS VARCHAR) AS reference, source_key, ordinal, sha256(substring(content, 1, 500)) AS excerpt_sha256
FROM chosen JOIN chunks USING (chunk_id)"""


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without any document that has all their lexemes are refused."""
    best = fts_and_topk(spark, sf_dir).filter("branch_rank = 1").select("query_id", F.col("chunk_id").alias("best"))
    rows = c.questions(spark, sf_dir).join(best, "query_id", "left")
    return rows.select("query_id", F.when(F.col("best").isNull(), "REFUSAL").otherwise("ANSWER").alias("decision"), "best")


REFUSALS_SQL = (
    "WITH t AS (SELECT query_id, chunk_id FROM (" + COVER_SQL + ") WHERE branch_rank = 1) "
    "SELECT item_id AS query_id, CASE WHEN t.chunk_id IS NULL THEN 'REFUSAL' ELSE 'ANSWER' END AS decision, t.chunk_id AS best FROM benchmark LEFT JOIN t ON t.query_id = item_id"
)


def marker_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers appended to every turn, well formed or not, parsed and validated against two available aliases."""
    turns = table(spark, sf_dir, "conversations").withColumn("k", (F.col("conv_id") + F.col("turn")) % 5)
    tail = F.when(F.col("k") == 0, " [[E1]]").when(F.col("k") == 1, " [[E1]] [[E2]]").when(F.col("k") == 2, " [[E01]]").when(F.col("k") == 3, " [[E1]] [[E1]]").otherwise(" [[E9]]")
    turns = turns.withColumn("answer", F.concat("text", tail))
    said = tx.markers(F.col("answer"))
    available = F.array(F.lit("E1"), F.lit("E2"))
    return turns.select("conv_id", "turn", F.array_join(said, ",").alias("markers"), tx.markers_well_formed(F.col("answer")).alias("well_formed"), an.valid_answer(F.col("answer"), said, available).alias("valid"))


MARKERS_SQL = r"""
WITH a AS (SELECT conv_id, turn, text || CASE (conv_id + turn) % 5 WHEN 0 THEN ' [[E1]]' WHEN 1 THEN ' [[E1]] [[E2]]' WHEN 2 THEN ' [[E01]]' WHEN 3 THEN ' [[E1]] [[E1]]' ELSE ' [[E9]]' END AS answer FROM conversations),
m AS (SELECT *, regexp_extract_all(answer, '\[\[(E[1-9][0-9]*)\]\]', 1) AS said, NOT contains(regexp_replace(answer, '\[\[E[1-9][0-9]*\]\]', '', 'g'), '[[') AS well_formed FROM a)
SELECT conv_id, turn, array_to_string(said, ',') AS markers, well_formed,
  well_formed AND len(said) > 0 AND len(list_distinct(said)) = len(said) AND len(list_filter(said, lambda x: x NOT IN ('E1', 'E2'))) = 0 AS valid FROM m"""


def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line chunks of every document with their checksums."""
    return ch.line_chunks(table(spark, sf_dir, "documents")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.sha2("content", 256).alias("checksum"), F.length("content").cast("long").alias("n_chars"))


_LINES = "SELECT doc_id, source, unnest(list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x) <> '')) AS content, generate_subscripts(list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x) <> ''), 1) - 1 AS ordinal FROM documents"


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping word windows of every document."""
    return ch.token_windows(table(spark, sf_dir, "documents"), WINDOWS).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.sha2("content", 256).alias("checksum"), F.col("token_count").cast("long").alias("token_count"))


WINDOWS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) <= 130 THEN [0] ELSE list_filter(range(0, len(words), 80), lambda x: x = 0 OR len(words) - x > 20) END) AS start FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS ordinal,
  sha256(array_to_string(CASE WHEN len(words) <= 130 THEN words ELSE words[start + 1 : start + 100] END, ' ')) AS checksum,
  len(CASE WHEN len(words) <= 130 THEN words ELSE words[start + 1 : start + 100] END) AS token_count FROM s"""


def page_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as normalized page text."""
    text = tx.page_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text, 256).alias("checksum"), F.length(text).cast("long").alias("n_chars"))


PAGES_SQL = r"""
WITH p AS (SELECT page_id, regexp_replace(replace(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), '[\x00-\x08\x0b-\x1f\x7f-\x9f]', '', 'g') AS t FROM pages),
l AS (SELECT page_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x0b\f]+', ' ', 'g'))), chr(10)) AS t FROM p),
n AS (SELECT page_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS t FROM l)
SELECT page_id, sha256(t) AS checksum, length(t) AS n_chars FROM n"""


def chunk_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document's chunks."""
    return de.chunk_set_digests(ch.line_chunks(table(spark, sf_dir, "documents")))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with chunks as a member of its workspace's population: source key, chunk set and digest."""
    sets = chunk_set_digest(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    number = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    return sets.select("doc_id", F.col("source").alias("workspace_id"), F.concat(F.lit("doc/"), number).alias("source_key"), F.concat(F.lit("set-"), number).alias("chunk_set_id"), "digest")


def population_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every workspace's documents."""
    return de.population_digests(members(spark, sf_dir), "workspace_id")


_DIGEST = "WITH l AS (" + _LINES + "), d AS (SELECT doc_id, count(*) AS n_chunks, sha256(string_agg(CAST(ordinal AS VARCHAR) || chr(0) || sha256(content) || chr(10), '' ORDER BY ordinal)) AS digest FROM l GROUP BY doc_id) "


def dedupe_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal text share one identity."""
    return de.identities(table(spark, sf_dir, "documents"))


def reuse_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivations of all documents against those of labelled ones: reused or created."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return de.reuse_or_create(docs, known, ["checksum"]).select("doc_id", "outcome")


def deterministic_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic vectors of the benchmark: their number of components and norm."""
    rows = de.embed(table(spark, sf_dir, "benchmark"), "text")
    return rows.select("item_id", F.size("vector").cast("long").alias("dims"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 9).alias("norm"))


def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents by the heading chunker, which for plain text are runs of non-blank lines."""
    docs = table(spark, sf_dir, "documents").withColumn("media_type", F.lit("text/plain"))
    return ch.heading_chunks(docs).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the normalized pages, packed from blocks."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), tx.page_text(F.col("html")).alias("text"))
    return ch.page_chunks(pages, WINDOWS).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "start_offset", "end_offset", "token_count", "content_checksum")


HEADINGS_SQL = r"""
WITH p AS (SELECT doc_id, unnest(string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\s*\n')) AS t FROM documents),
n AS (SELECT doc_id, len(regexp_extract_all(t, '\S+')) AS n FROM p),
w AS (SELECT doc_id, CASE WHEN n <= 650 THEN [n] ELSE list_transform(list_filter(range(0, n, 425), lambda s: s = 0 OR n - s > 75), lambda s: least(500, n - s)) END AS w FROM n WHERE n > 0)
SELECT doc_id, CAST(sum(len(w)) AS BIGINT) AS n_chunks, CAST(sum(list_sum(w)) AS BIGINT) AS n_tokens FROM w GROUP BY doc_id"""


def byte_pairs(spark: SparkSession) -> tk.BytePairs:
    """The byte-pair vocabulary that the session names."""
    return tk.BytePairs.load(spark, spark.conf.get("spark.citeloom.ranks", tk.RANKS))


def bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte pairs of every whole document: their number, a digest of the ids and whether they spell the text again."""
    rows = tk.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text", byte_pairs(spark))
    return rows.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "exact")


def bpe_heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents, sized and cut in byte pairs."""
    docs = table(spark, sf_dir, "documents").withColumn("media_type", F.lit("text/plain"))
    return ch.heading_chunks(docs, WINDOWS, byte_pairs(spark)).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "token_count", "content_checksum")


def bpe_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the normalized pages, packed by their number of byte pairs."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), tx.page_text(F.col("html")).alias("text"))
    return ch.page_chunks(pages, WINDOWS, byte_pairs(spark)).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "start_offset", "end_offset", "token_count", "content_checksum")


def corpus_cutover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the corpus of line chunks can be cut over to the vectors that exist."""
    sets = chunk_set_digest(spark, sf_dir).select(F.col("doc_id"), F.col("digest").alias("before_digest"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has"))
    rows = sets.join(vecs, "doc_id", "left").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("source_key"), "before_digest", F.col("before_digest").alias("after_digest"), F.coalesce("has", F.lit(False)).alias("complete"), F.lit(True).alias("vectors_new"), (F.col("doc_id") % 100 != 7).alias("v1_immutable"))
    return de.cutover(rows)


QUERIES = {f.__name__: f for f in (evidence_selection, answers, citations, refusals, marker_parse, paragraph_chunks, token_windows, page_normalize, chunk_set_digest, population_digest, dedupe_identity, reuse_outcome, deterministic_embedding, heading_chunks, page_chunks, bpe_tokens, bpe_heading_chunks, bpe_page_chunks, corpus_cutover)}

ORACLE_SQL = {
    "evidence_selection": EVIDENCE_SQL,
    "answers": ANSWERS_SQL,
    "citations": CITATIONS_SQL,
    "refusals": REFUSALS_SQL,
    "marker_parse": MARKERS_SQL,
    "paragraph_chunks": "SELECT doc_id, ordinal, sha256(content) AS checksum, length(content) AS n_chars FROM (" + _LINES + ")",
    "token_windows": WINDOWS_SQL,
    "heading_chunks": HEADINGS_SQL,
    "page_normalize": PAGES_SQL,
    "chunk_set_digest": _DIGEST + "SELECT * FROM d",
    "population_digest": _DIGEST + "SELECT source AS workspace_id, count(*) AS n_documents, sha256(string_agg('doc/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || chr(0) || 'set-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || chr(0) || digest || chr(10), '' ORDER BY doc_id)) AS digest FROM d JOIN documents USING (doc_id) GROUP BY source",
    "dedupe_identity": "SELECT doc_id, sha256(coalesce(text, '')) AS checksum, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_doc_id, doc_id <> first_doc_id AS is_duplicate FROM documents",
    "reuse_outcome": "SELECT doc_id, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) THEN 'reused' ELSE 'created' END AS outcome FROM documents",
    "corpus_cutover": "WITH m AS (SELECT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS complete FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) > 0) SELECT count_if(NOT complete) = 0 AND count_if(doc_id % 100 = 7) = 0 AS allowed, count(*) AS n_members, CAST(count_if(NOT complete) AS BIGINT) AS n_pending, CAST(count_if(doc_id % 100 = 7) AS BIGINT) AS n_violations FROM m",
}
