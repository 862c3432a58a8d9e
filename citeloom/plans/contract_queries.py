"""Traces, contracts, report parts and coordination steps over tables that are damaged here and there, so that every rule has breaches.

Remainders of ids decide what is damaged; the SQL counts the same remainders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ALERT_CLASSES, METRICS, PRESETS, SAFE_CODES
from ..functions import canonical as ca
from ..operators import answering as an
from ..operators import derivation as de
from ..operators import lifecycle as li
from ..operators import operations as op
from ..operators import reports as rp
from ..operators import retrieval as rt
from ..operators import traces as tr
from ..operators import validation as va
from ..sources.files import table
from . import answering_queries as aq
from . import common as c
from . import evaluation_queries as eq
from .operations_queries import ALERT_SQL
from .retrieval_queries import OBSERVATIONS_SQL, branches

PRESET = "retrieval-m3-rrf-v1"


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n"))


def sql_rules(counts: dict[str, str]) -> str:
    """A row for each rule that has breaches."""
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{rule}' AS rule, ({n}) AS n" for rule, n in counts.items()) + ") WHERE n > 0"


def mod(column: str, m: int, r: int = 0) -> Column:
    return F.col(column) % m == r


# --- canonical forms ---------------------------------------------------------------------------------------------


def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivation identity, fingerprint and name-based identifier of every benchmark item."""
    item = F.col("item_id")
    identity = de.derivation_identity(tokenizer=F.lit("whitespace"), item=item, chunking=F.lit(None).cast("string"), characters=F.length("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", identity.alias("identity"), ca.digest(ca.fingerprint(item, F.lit(None), F.col("text"))).alias("fingerprint"), ca.uuid5(F.concat(F.col("text"), F.lit(":prepare"))).alias("operation_id"))


CANONICAL_SQL = f"""
WITH h AS (SELECT item_id, text, sha1(unhex('{ca.NAMESPACE_URL}') || encode(text || ':prepare')) AS h FROM benchmark)
SELECT item_id, sha256('{{"characters":' || length(text) || ',"chunking":null,"item":' || item_id || ',"tokenizer":"whitespace"}}') AS identity,
  sha256(item_id || chr(10) || chr(10) || text) AS fingerprint,
  h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS operation_id FROM h"""


def json_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often identifiers occur as values anywhere in nested metadata of the events; keys do not count."""
    doc = lambda x: F.concat(F.lit("doc-"), (x % 40).cast("string"))
    text = F.format_string('{"trace": ["%s", {"deep": {"%s": "%s"}}], "n": %d}', doc(F.col("user_id")), doc(F.col("event_id") + 7), doc(F.col("event_id")), F.col("event_id"))
    return table(spark, sf_dir, "events").select(F.explode(ca.json_strings(text)).alias("identifier")).groupBy("identifier").agg(F.count("*").alias("n"))


JSON_SQL = """
WITH j AS (SELECT '{"trace": ["doc-' || user_id % 40 || '", {"deep": {"doc-' || (event_id + 7) % 40 || '": "doc-' || event_id % 40 || '"}}], "n": ' || event_id || '}' AS j FROM events)
SELECT json_extract_string(j, p) AS identifier, count(*) AS n FROM (SELECT j, unnest(['$.trace[0]', '$.trace[1].deep.*']) AS p0, CASE WHEN p0 = '$.trace[0]' THEN p0 ELSE '$.trace[1].deep."' || json_keys(j, '$.trace[1].deep')[1] || '"' END AS p FROM j) GROUP BY 1"""


def next_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least value above all values of each event type, and the mean, least and most of them."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(*rp.latency("value"))
    return rows.select("event_type", F.round("value_mean", 6).alias("mean"), F.col("value_min").alias("least"), F.col("value_max").alias("most"), (ca.next_up(F.col("value_max")) > F.col("value_max")).alias("above"), ca.next_up(F.col("value_max")).alias("next_up"))


NEXT_SQL = "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, true AS above, nextafter(max(value), 'inf'::DOUBLE) AS next_up FROM events GROUP BY event_type"


def provenance_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which two provenances of each source differ: language, labels and documents, of which the first may."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars")
    one = docs.groupBy("source").agg(F.max("lang").alias("lang"), F.count("*").alias("documents"), F.max("n_chars").alias("longest"))
    two = docs.filter("doc_id % 10 <> 3").groupBy("source").agg(F.min("lang").alias("lang"), F.count("*").alias("documents"), F.max("n_chars").alias("longest"))
    return ca.differing_fields(one, two, "source", ["lang"])


DIFFERENCES_SQL = """
WITH a AS (SELECT source, count(*) AS n, max(n_chars) AS m FROM documents GROUP BY source), b AS (SELECT source, count(*) AS n, max(n_chars) AS m FROM documents WHERE doc_id % 10 <> 3 GROUP BY source)
SELECT coalesce(a.source, b.source) AS source, 'documents' AS field FROM a FULL JOIN b USING (source) WHERE a.n IS DISTINCT FROM b.n
UNION ALL SELECT coalesce(a.source, b.source), 'longest' FROM a FULL JOIN b USING (source) WHERE a.m IS DISTINCT FROM b.m"""


# --- traces ------------------------------------------------------------------------------------------------------


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traces of all hybrid questions that have candidates."""
    vector, below, fts, matches = branches(spark, sf_dir, PRESET)
    fused = rt.fuse(vector, fts).select("query_id", "chunk_id", "vector_rank", "fts_rank", "similarity", "native_rank", "fusion_score")
    chosen = aq.decisions(spark, sf_dir)
    answered = an.answers(c.hybrid_queries(spark, sf_dir), aq.evidence(spark, sf_dir))
    return tr.assemble(c.hybrid_queries(spark, sf_dir), fused, chosen, rt.observations(vector, below, fts, matches), answered, PRESETS[PRESET]).filter(F.col("candidate_decisions").isNotNull())


def trace_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the trace of every hybrid question holds."""
    d = F.col("candidate_decisions")
    count = lambda what: F.size(F.filter(d, what)).cast("long")
    return traces(spark, sf_dir).select(
        "query_id", "decision", F.size(d).cast("long").alias("candidates"), count(lambda x: x["final_decision"] == "SELECTED").alias("selected"),
        count(lambda x: x["budget_evidence"].isNotNull()).alias("over_budget"), count(lambda x: x["vector_contribution"].isNotNull() & x["fts_contribution"].isNotNull()).alias("both_branches"),
        F.size("branch_observations").cast("long").alias("observations"), F.array_join(F.transform("retrieved_chunk_ids", lambda x: x.cast("string")), ",").alias("retrieved"),
        F.element_at("alias_mapping", F.lit("E1")).alias("first_evidence"),
    )


ASSEMBLY_SQL = aq.EVIDENCE_SQL.rpartition("SELECT query_id, chunk_id, n AS final_rank")[0] + """,
o AS (SELECT query_id, count(*) AS observations FROM (""" + OBSERVATIONS_SQL + """) GROUP BY query_id),
d AS (SELECT f.query_id, count(*) AS candidates, CAST(count_if(outcome = 'SELECTED') AS BIGINT) AS selected, CAST(count_if(outcome IN ('TOKEN_BUDGET_EXCEEDED', 'CHUNK_COUNT_LIMIT')) AS BIGINT) AS over_budget,
  CAST(count_if(vector_rank IS NOT NULL AND fts_rank IS NOT NULL) AS BIGINT) AS both_branches, string_agg(CAST(f.chunk_id AS VARCHAR), ',' ORDER BY f.n) AS retrieved, arg_min(f.chunk_id, f.n) FILTER (outcome = 'SELECTED') AS first_evidence
  FROM fold f JOIN fused u ON u.query_id = f.query_id AND u.chunk_id = f.chunk_id WHERE n > 0 GROUP BY f.query_id)
SELECT query_id, CASE WHEN selected > 0 THEN 'ANSWER' ELSE 'REFUSAL' END AS decision, candidates, selected, over_budget, both_branches, observations, retrieved, first_evidence FROM d JOIN o USING (query_id)"""


def trace_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches by rule of the questions' traces, after damage to versions, ranks, scores, answers and markers."""
    q = F.col("query_id")
    shifted = F.transform("candidate_decisions", lambda x: x.withField("final_rank", x["final_rank"] + 1))
    rescored = F.transform("candidate_decisions", lambda x: x.withField("fusion_score", x["fusion_score"] + 1e-6))
    rows = traces(spark, sf_dir).withColumns({
        "trace_schema_version": F.when(q % 11 == 0, 1).otherwise(F.col("trace_schema_version")),
        "fusion_policy_version": F.when(q % 7 == 3, "rrf-v2").otherwise(F.col("fusion_policy_version")),
        "candidate_decisions": F.when(q % 5 == 0, shifted).when(q % 5 == 1, rescored).otherwise(F.col("candidate_decisions")),
        "refusal_reason": F.when(q % 9 == 0, "NO_REASON").otherwise(F.col("refusal_reason")),
        "parsed_markers": F.when(q % 4 == 0, F.array(F.lit("E99"))).otherwise(F.col("parsed_markers")),
        "branch_observations": F.when(q % 6 == 0, F.filter("branch_observations", lambda x: x["branch"] == "fts")).otherwise(F.col("branch_observations")),
    })
    return by_rule(va.violations(rows, q, tr.trace_rules()))


_QUERIES = "SELECT count(DISTINCT query_id) FROM fused WHERE query_id % {m} = {r}"
TRACE_RULES_SQL = "WITH " + c.tied(c.SQL_FUSED, "") + " " + sql_rules({
    "version": _QUERIES.format(m=11, r=0), "policy": _QUERIES.format(m=7, r=3), "ordering": _QUERIES.format(m=5, r=0), "score": _QUERIES.format(m=5, r=1),
    "decision": _QUERIES.format(m=9, r=0), "markers": _QUERIES.format(m=4, r=0), "observed": "SELECT count(DISTINCT query_id) FROM vec WHERE query_id % 6 = 0",
})


def observation_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches by rule of the branches' observations with their scores, after damage."""
    vector, below, fts, matches = branches(spark, sf_dir, PRESET)
    key = ["query_id", "chunk_id"]
    scores = vector.select(*key, "similarity").union(below.select(*key, "similarity")).withColumn("b", F.lit("vector"))
    native = fts.select(*key, "native_rank").withColumn("b", F.lit("fts"))
    rows = rt.observations(vector, below, fts, matches).withColumn("b", F.col("branch")).join(scores, [*key, "b"], "left").join(native, [*key, "b"], "left")
    rows = rows.withColumn("cosine_distance", 1 - F.col("similarity"))
    rows = rows.withColumns({
        "status": F.when(mod("chunk_id", 13), "ELIGIBLE_NOT_SELECTED").otherwise(F.col("status")),
        "branch_rank": F.when(mod("chunk_id", 13, 1), 0).otherwise(F.col("branch_rank")),
        "cosine_distance": F.when(mod("chunk_id", 13, 2) & (F.col("branch") == "vector"), float("nan")).otherwise(F.col("cosine_distance")),
        "chunk_id": F.when(~mod("chunk_id", 13, 3), F.col("chunk_id")),
    })
    return by_rule(va.violations(rows, F.col("query_id"), {k: v for k, v in tr.observation_rules().items() if k in ("chunk", "rank", "finite")} | {"known status": tr.observation_rules()["status"]}))


OBSERVATION_SQL = "WITH obs AS (" + OBSERVATIONS_SQL + ") " + sql_rules({
    "known status": "SELECT count(*) FROM obs WHERE chunk_id % 13 = 0",
    "rank": "SELECT count(*) FROM obs WHERE chunk_id % 13 = 1 OR (chunk_id % 13 = 0 AND status = 'ELIGIBLE')",
    "finite": "SELECT count(*) FROM obs WHERE chunk_id % 13 = 2 AND branch = 'vector'",
    "chunk": "SELECT count(*) FROM obs WHERE chunk_id % 13 = 3 AND status = 'ELIGIBLE'",
})


def timing_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches by rule of phase timings made from the events' ids, after damage to chains, durations and latencies."""
    k = F.col("event_id")
    ticks = [F.lit(10.0), F.lit(10.0) + (k % 3) * 0.25, F.lit(11.0) + (k % 5) * 0.125, F.lit(12.0), F.lit(12.5)]
    e = table(spark, sf_dir, "events").select("event_id", tr.phase_timings(ticks, 0.001).alias("timing"), ((ticks[3] - ticks[1]) * 1000).alias("retrieval_ms"))
    phases = F.col("timing.phases")
    gap = F.transform(phases, lambda p: F.when(p["name"] == "generation", p.withField("start_tick", p["start_tick"] + 0.25).withField("duration_ms", p["duration_ms"] - 250)).otherwise(p))
    long = F.transform(phases, lambda p: F.when(p["name"] == "query_embedding", p.withField("duration_ms", p["duration_ms"] + 1)).otherwise(p))
    e = e.withColumn("timing", F.col("timing").withField("phases", F.when(k % 7 == 0, gap).when(k % 7 == 1, long).when(k % 7 == 2, F.slice(phases, 1, 3)).otherwise(phases)))
    e = e.withColumn("retrieval_ms", F.when(k % 7 == 3, -1.0).otherwise(F.col("retrieval_ms")))
    return by_rule(va.violations(e, k, tr.timing_rules(F.col("timing"), F.col("retrieval_ms"))))


_EVENTS = "SELECT count(*) FROM events WHERE {w}"
TIMING_SQL = sql_rules({"chain": _EVENTS.format(w="event_id % 7 IN (0, 2)"), "durations": _EVENTS.format(w="event_id % 7 = 1"), "phases": _EVENTS.format(w="event_id % 7 = 2"), "retrieval latency": _EVENTS.format(w="event_id % 7 = 3")})


def query_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches by rule of question embeddings: how many, how long, from where."""
    v = table(spark, sf_dir, "embeddings")
    one = F.col("embedding")
    vectors = F.when(mod("vec_id", 6), F.array(one, one)).when(mod("vec_id", 6, 1), F.array(F.slice(one, 1, 10))).otherwise(F.array(one))
    rows = v.select("vec_id", vectors.alias("vectors"), F.when(mod("vec_id", 8, 2), "other").otherwise("deterministic").alias("provider"), F.lit("shake").alias("model"))
    return by_rule(va.violations(rows, F.col("vec_id"), tr.query_embedding_rules(F.col("vectors"), F.col("provider"), F.col("model"), 64, ("deterministic", "shake"))))


QUERY_EMBEDDING_SQL = sql_rules({"one vector": "SELECT count(*) FROM embeddings WHERE vec_id % 6 = 0", "dimensions": "SELECT count(*) FROM embeddings WHERE vec_id % 6 = 1", "configuration": "SELECT count(*) FROM embeddings WHERE vec_id % 8 = 2"})


def response_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches by rule of public responses made from the orders, after damage to answers, refusals, citations and markers."""
    k = F.col("o_orderkey")
    cite = lambda i, start: F.struct(F.lit(f"E{i}").alias("evidence_id"), F.concat(F.lit("doc/"), k.cast("string")).alias("source_key"), F.lit("an excerpt").alias("excerpt"), start.alias("start_line"), F.lit(9).alias("end_line"))
    two = F.array(cite(1, F.when(k % 7 == 1, 0).otherwise(3)), cite(2, F.lit(4)))
    refused = k % 5 == 0
    text = F.when(k % 7 == 2, "text [[E1]]").when(k % 7 == 3, "text [[E1]] [[E2").when(k % 7 == 4, "  ").otherwise("text [[E1]] and [[E2]]")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(refused, "REFUSAL").otherwise("ANSWER").alias("decision"), F.when(~refused | (k % 7 == 5), text).alias("answer"),
        F.when(refused, F.when(k % 7 == 6, "OTHER").otherwise("INSUFFICIENT_EVIDENCE")).alias("refusal_reason"), F.when(refused, F.array().cast(CITATION)).otherwise(two.cast(CITATION)).alias("citations"), F.when(k % 11 > 0, "trace").alias("trace_id"),
    )
    return by_rule(va.violations(rows, F.col("k"), tr.response_rules()))


CITATION = "array<struct<evidence_id:string,source_key:string,excerpt:string,start_line:int,end_line:int>>"
_ORDERS = "SELECT count(*) FROM orders WHERE {w}"
RESPONSE_SQL = sql_rules({
    "trace": _ORDERS.format(w="o_orderkey % 11 = 0"), "answer": _ORDERS.format(w="o_orderkey % 5 <> 0 AND o_orderkey % 7 = 4"), "refusal": _ORDERS.format(w="o_orderkey % 5 = 0 AND o_orderkey % 7 IN (5, 6)"),
    "citation lines": _ORDERS.format(w="o_orderkey % 5 <> 0 AND o_orderkey % 7 = 1"), "markers": _ORDERS.format(w="o_orderkey % 5 <> 0 AND o_orderkey % 7 IN (2, 3, 4)"),
})


def citation_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches by rule between citations of all selected evidence and the traces, after damage to keys, excerpts and locators."""
    key = F.col("chunk_id")
    rows = aq.decisions(spark, sf_dir).join(c.hybrid_chunks(spark, sf_dir).select("chunk_id", "source_key", "content"), "chunk_id")
    rows = rows.withColumn("final_decision", F.col("outcome")).withColumn("locator", F.concat_ws(":", "source_key", F.lit("1"), F.lit("9")))
    said = aq.evidence(spark, sf_dir).select("query_id", "chunk_id", F.col("alias").alias("evidence_id"), "source_key", F.substring("content", 1, 500).alias("excerpt"))
    cited = said.withColumn("locator", F.concat_ws(":", "source_key", F.lit("1"), F.when(key % 7 == 0, "8").otherwise("9")))
    cited = cited.withColumn("excerpt", F.when(key % 7 == 1, "other words").otherwise(F.col("excerpt"))).withColumn("source_key", F.when(key % 7 == 2, "doc/none").otherwise(F.col("source_key")))
    mapping = said.filter(key % 7 != 3).select("query_id", "evidence_id", "chunk_id")
    return by_rule(tr.citation_breaches(cited.drop("chunk_id"), mapping, rows))


_CITED = "SELECT count(*) FROM chosen WHERE chunk_id % 7 IN ({r})"
CITATION_SQL = aq._CHOSEN + sql_rules({"selected": _CITED.format(r="3"), "source": _CITED.format(r="2, 3"), "excerpt": _CITED.format(r="1, 3"), "locator": _CITED.format(r="0, 3")})


# --- report parts ------------------------------------------------------------------------------------------------


def structural_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structural checks over observations made from the orders, damaged by their keys."""
    k = F.col("o_orderkey")
    strings = lambda *x: F.array(*x).cast("array<string>")
    refused = k % 4 == 0
    chunk = F.concat(F.lit("doc/"), k.cast("string"), F.lit("#3"))
    rows = table(spark, sf_dir, "orders").select(
        F.when(refused, "REFUSAL").otherwise("ANSWER").alias("decision"), F.when(~refused, "said").alias("answer"), F.when(refused, "INSUFFICIENT_EVIDENCE").alias("refusal_reason"),
        F.when(refused, strings()).otherwise(strings(F.lit("E1"))).alias("evidence_ids"), F.when(refused, strings()).when(k % 7 == 0, strings(F.lit("E2"))).otherwise(strings(F.lit("E1"))).alias("marker_ids"),
        F.when(refused, strings()).otherwise(strings(chunk)).alias("cited"), F.when(k % 9 == 0, strings()).otherwise(strings(chunk)).alias("retrieved"),
        F.when(k % 11 == 0, strings(F.lit("doc/other"))).otherwise(strings(F.concat(F.lit("doc/"), k.cast("string")))).alias("expected_sources"),
        F.when(k % 13 == 0, strings(F.lit("a"), F.lit("b"))).otherwise(strings(F.lit("a"))).alias("candidate_workspaces"), F.lit("a").alias("workspace_id"), F.when(k % 17 > 0, "t").alias("trace_id"),
    )
    return rp.structural_report(rows).withColumn("rate", F.round("rate", 9))


STRUCTURAL_SQL = """
WITH o AS (SELECT o_orderkey % 4 = 0 OR o_orderkey % 7 <> 0 AS a, o_orderkey % 4 = 0 OR o_orderkey % 11 <> 0 AS b, o_orderkey % 4 = 0 OR o_orderkey % 9 <> 0 AS c, o_orderkey % 13 <> 0 AS d, o_orderkey % 17 <> 0 AS e FROM orders)
SELECT count(*) AS n, CAST(count_if(a) AS BIGINT) AS decision_contract, CAST(count_if(b) AS BIGINT) AS expected_source_documents, CAST(count_if(c) AS BIGINT) AS citation_in_evidence_set,
  CAST(count_if(d) AS BIGINT) AS workspace_isolation, CAST(count_if(e) AS BIGINT) AS trace_persisted, CAST(count_if(a AND b AND c AND d AND e) AS BIGINT) AS passed,
  round(count_if(a AND b AND c AND d AND e) / count(*), 9) AS rate, count_if(a AND b AND c AND d AND e) = count(*) AS hard_gate FROM o"""


def retrieval_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that are scored and those that are not, by reason, with the exact mean recall of the scored ones."""
    q = F.col("query_id")
    rows = eq.metrics(spark, sf_dir).withColumn("applicable", q % 3 > 0).withColumn("status", F.when(q % 5 == 0, "failure").otherwise("observed")).withColumn("failure_code", F.when(q % 5 == 0, F.when(q % 2 == 0, "PROVIDER_ERROR")))
    rows = rp.included(rows)
    return rows.groupBy(F.coalesce("exclusion_reason", F.lit("INCLUDED")).alias("reason")).agg(F.count("*").alias("n"), F.sum("hits").alias("hits"), F.sum("gold_size").alias("gold"))


EXCLUSION_SQL = "WITH " + eq._CASES + " SELECT CASE WHEN query_id % 3 = 0 THEN 'RETRIEVAL_RELEVANCE_NOT_APPLICABLE' WHEN query_id % 5 = 0 THEN CASE WHEN query_id % 2 = 0 THEN 'PROVIDER_ERROR' ELSE 'OBSERVATION_FAILURE' END ELSE 'INCLUDED' END AS reason, count(*) AS n, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(gold_size) AS BIGINT) AS gold FROM m GROUP BY 1"


def system_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency, usage, cost and errors over the events as observations."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("value").alias("latency_ms"), F.from_json("props", "map<string,bigint>").alias("usage"), F.when(F.col("event_type") == "purchase", (F.col("event_id") % 100).cast("decimal(20,0)")).alias("cost_usd"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    done = rp.system_report(rows)
    said = F.array_join(F.transform(F.map_entries("token_usage"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return done.select("n", F.round("latency_ms_mean", 6).alias("mean"), F.col("latency_ms_min").alias("least"), F.col("latency_ms_max").alias("most"), F.col("cost_usd").cast("double").alias("cost_usd"), "provider_errors", said.alias("usage"), "usage_status", "cost_status")


SYSTEM_SQL = """
WITH u AS (SELECT string_agg(name || '=' || n, ',' ORDER BY name) AS usage FROM (SELECT name, CAST(sum(CAST(json_extract_string(props, '$."' || name || '"') AS BIGINT)) AS BIGINT) AS n FROM (SELECT props, unnest(json_keys(props)) AS name FROM events) GROUP BY name))
SELECT count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, CAST(sum(CASE WHEN event_type = 'purchase' THEN event_id % 100 END) AS DOUBLE) AS cost_usd,
  CAST(count_if(event_type = 'error') AS BIGINT) AS provider_errors, any_value(usage) AS usage, 'observed' AS usage_status, 'observed' AS cost_status FROM events, u"""


def semantic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity labels as scores of two metrics, some out of range, missing or excused by an error."""
    rows = table(spark, sf_dir, "labels").select(
        F.when(mod("doc_id", 9), F.lit(None).cast("map<string,double>")).otherwise(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double") + F.when(mod("doc_id", 10, 1), 1.5).otherwise(0.0))).alias("scores"),
        F.when(mod("doc_id", 18), "failed").alias("error"),
    )
    return rp.semantic_scores(rows, ["quality", "toxic"]).withColumn("mean", F.round("mean", 9))


SEMANTIC_SUMMARY_SQL = """
WITH l AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN quality::DOUBLE END AS quality, CASE WHEN doc_id % 9 <> 0 THEN toxic + CASE WHEN doc_id % 10 = 1 THEN 1.5::DOUBLE ELSE 0 END END AS toxic FROM labels)
SELECT 'quality' AS metric, count(quality) AS denominator, round(avg(quality), 9) AS mean, CAST(count_if(doc_id % 9 = 0 AND doc_id % 18 <> 0 OR quality > 1) AS BIGINT) AS problems FROM l
UNION ALL SELECT 'toxic', count(toxic), round(avg(toxic), 9), CAST(count_if(doc_id % 9 = 0 AND doc_id % 18 <> 0 OR toxic > 1) AS BIGINT) FROM l"""


def runtime_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the traced events agree on: one configuration, no single provider."""
    rows = table(spark, sf_dir, "events").select(F.when(mod("event_id", 3), F.col("event_id")).alias("trace_id"), F.when(mod("event_id", 3), "retrieval-m3-rrf-v2").otherwise("other").alias("configuration"), F.col("event_type").alias("provider"))
    return rp.consensus(rows, ["configuration", "provider"])


CONSENSUS_SQL = """
WITH e AS (SELECT event_type FROM events WHERE event_id % 3 = 0)
SELECT 'configuration' AS name, CAST(1 AS BIGINT) AS distinct, 'retrieval-m3-rrf-v2' AS value UNION ALL SELECT 'provider', count(DISTINCT event_type), CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END FROM e"""


def category_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of category arithmetic over the customers, damaged by their keys."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k, F.lit(10).alias("case_count"), F.when(k % 11 == 0, 9).otherwise(8).alias("applicable"), F.lit(2).alias("inapplicable"), F.when(k % 7 == 0, -1).otherwise(2).alias("failures"),
        F.when(k % 5 == 0, 0).otherwise(6).alias("denominator"), F.when(k % 5 == 0, 0).when(k % 3 == 0, 7).otherwise(3).alias("numerator"), F.when(k % 5 > 0, F.when(k % 3 == 0, 7 / 6).when(k % 2 == 0, 0.51).otherwise(0.5)).alias("value"),
    )
    return by_rule(va.violations(rows, k, rp.category_metric_rules()))


_CUST = "SELECT count(*) FROM customer WHERE {w}"
CATEGORY_SQL = sql_rules({
    "counts": _CUST.format(w="c_custkey % 7 = 0"), "applicable": _CUST.format(w="c_custkey % 11 = 0"), "numerator": _CUST.format(w="c_custkey % 5 > 0 AND c_custkey % 3 = 0"),
    "denominator": _CUST.format(w="CASE WHEN c_custkey % 11 = 0 THEN 9 ELSE 8 END - CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE 2 END <> CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 6 END"),
    "value": _CUST.format(w="c_custkey % 5 > 0 AND c_custkey % 3 > 0 AND c_custkey % 2 = 0"),
})


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the observations of a report, damaged by their keys."""
    k = F.col("o_orderkey")
    seen = k % 6 > 0
    return table(spark, sf_dir, "orders").select(
        k.alias("case_id"), F.when(k % 19 == 0, "lost").when(seen, "observed").otherwise("failure").alias("status"), F.when(k % 7 == 0, -1.0).otherwise(1.0).alias("retrieval_latency_ms"), F.lit(2.0).alias("end_to_end_latency_ms"),
        F.when(~seen & (k % 12 == 0), "PROVIDER_ERROR").alias("failure_code"), F.when(k % 11 == 0, "other").otherwise("r").alias("retrieval_configuration_id"), F.lit("s").alias("chunk_set_provenance_id"),
        F.when(k % 13 > 0, F.when(k % 2 == 0, "ANSWER").otherwise("REFUSAL")).alias("decision"), (k % 5 > 0).alias("structural_validity"), F.when(k % 17 > 0, True).alias("citation_correctness"), F.lit(True).alias("refusal_correctness"),
    )


def observation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of the observation contract, and cases that one of two reports lacks or has twice."""
    rows = _report(spark, sf_dir)
    other = rows.filter("case_id % 23 <> 0")
    return by_rule(va.together(va.violations(rows, F.col("case_id"), rp.observation_set_rules("r", "s")), rp.same_cases(rows.union(rows.filter("case_id % 29 = 0")), other, "case_id")))


_SEEN = "o_orderkey % 6 > 0 AND o_orderkey % 19 > 0"
OBSERVATION_SET_SQL = sql_rules({
    "OBSERVATION_STATUS_INVALID": _ORDERS.format(w="o_orderkey % 19 = 0"), "OBSERVATION_LATENCY_INVALID": _ORDERS.format(w=_SEEN + " AND o_orderkey % 7 = 0"),
    "OBSERVATION_FAILURE_CODE_INVALID": _ORDERS.format(w=f"NOT ({_SEEN}) AND o_orderkey % 12 > 0"), "OBSERVATION_PROVENANCE_INVALID": _ORDERS.format(w=_SEEN + " AND o_orderkey % 11 = 0"),
    "OBSERVATION_RESPONSE_INVALID": _ORDERS.format(w=_SEEN + " AND o_orderkey % 13 = 0"), "GUARDRAIL_FAILURE": _ORDERS.format(w=_SEEN + " AND o_orderkey % 17 = 0"),
    "DUPLICATE_CASE_ID": _ORDERS.format(w="o_orderkey % 29 = 0"), "CASE_SET_MISMATCH": _ORDERS.format(w="o_orderkey % 23 = 0 AND o_orderkey % 29 > 0"),
})


def report_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guardrails of the whole report and of its sound part, with the digest of each report's canonical form."""
    rows = _report(spark, sf_dir)
    sound = rows.filter("status = 'observed' AND structural_validity AND citation_correctness")
    done = rp.guardrails(rows).withColumn("report", F.lit("all")).unionByName(rp.guardrails(sound).withColumn("report", F.lit("sound")))
    names = ["structural_validity", "citation_correctness", "refusal_correctness", "observation_failure_count", "observed", "latency_observed"]
    return done.select("report", *names, ca.digest(ca.canonical_object(**{n: F.col(n) for n in names})).alias("digest"))


_GUARD = """SELECT '{name}' AS report, count_if(seen) > 0 AND count_if(seen AND NOT valid) = 0 AND count_if(seen) = count(*) AS structural_validity,
  count_if(seen AND d = 'ANSWER') > 0 AND count_if(seen AND d = 'ANSWER' AND NOT cited) = 0 AS citation_correctness, count_if(seen) > 0 AS refusal_correctness,
  CAST(count_if(NOT seen) AS BIGINT) AS observation_failure_count, CAST(count_if(seen) AS BIGINT) AS observed, true AS latency_observed FROM o {where}"""
GUARDRAILS_SQL = "WITH o AS (SELECT " + _SEEN + " AS seen, o_orderkey % 5 > 0 AS valid, o_orderkey % 17 > 0 AS cited, CASE WHEN o_orderkey % 13 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ANSWER' ELSE 'REFUSAL' END END AS d FROM orders), g AS (" + _GUARD.format(name="all", where="") + " UNION ALL " + _GUARD.format(name="sound", where="WHERE seen AND valid AND cited") + """)
SELECT *, sha256('{"citation_correctness":' || citation_correctness || ',"latency_observed":' || latency_observed || ',"observation_failure_count":' || observation_failure_count || ',"observed":' || observed || ',"refusal_correctness":' || refusal_correctness || ',"structural_validity":' || structural_validity || '}') AS digest FROM g"""


def improvement_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best claim of each customer's orders read as comparisons."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "CLAIM").otherwise("NO_QUALIFYING_DELTA").alias("decision"), F.col("o_totalprice").alias("rank_key"), F.col("o_orderkey").alias("order"))
    return rp.select_improvement(rows, "o_custkey")


SELECTION_SQL = "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) FILTER (o_orderstatus = 'F') AS run, CASE WHEN count_if(o_orderstatus = 'F') > 0 THEN 'CLAIM' ELSE 'NO_CLAIM' END AS decision, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS claims FROM orders GROUP BY o_custkey"


def canonical_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of order lines read as trace candidates under the parts' bindings, and the references that are left."""
    k = F.col("p_partkey")
    bindings = table(spark, sf_dir, "part").filter("p_partkey % 9 > 0").select(k.cast("string").alias("source_key"), F.concat(F.lit("v"), k).alias("version_id"), F.concat(F.lit("s"), k).alias("chunk_set_id"))
    n = F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), n.cast("string").alias("source_key"), F.when(F.col("l_linenumber") < 6, (F.col("l_linenumber") / 2).cast("int")).alias("ordinal"), F.concat(F.lit("v"), n).alias("version_id"), F.concat(F.lit("s"), F.when(n % 10 == 1, n + 1).otherwise(n)).alias("chunk_set_id"))
    good, bad = rp.canonical_projection(lines, bindings, "m3")
    return by_rule(bad.union(good.select("query_id", F.lit("projected"))))


REFERENCES_SQL = """
WITH l AS (SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber < 6 THEN l_linenumber // 2 END AS o, l_partkey % 9 = 0 OR l_partkey % 10 = 1 OR l_partkey NOT IN (SELECT p_partkey FROM part) AS unbound FROM lineitem)
SELECT * FROM (SELECT 'CANONICAL_CHUNK_REFERENCE_INVALID' AS rule, CAST(count_if(o IS NULL) AS BIGINT) AS n FROM l UNION ALL SELECT 'SOURCE_BINDING_MISMATCH', CAST(count_if(o IS NOT NULL AND unbound) AS BIGINT) FROM l
  UNION ALL SELECT 'projected', CAST(count_if(o IS NOT NULL AND NOT unbound) AS BIGINT) FROM l
  UNION ALL SELECT 'DUPLICATE_CANONICAL_CHUNK_REFERENCE', count(*) FROM (SELECT 1 FROM l WHERE o IS NOT NULL AND NOT unbound GROUP BY l_orderkey, l_partkey, o HAVING count(*) > 1)) WHERE n > 0"""


def calibration_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of the judgement contract over the parts read as calibration cases."""
    k = F.col("p_partkey")
    known = F.sequence(F.lit(0), F.when(k % 5 == 0, 8).otherwise(11))
    rows = table(spark, sf_dir, "part").select(k, known.alias("known"), F.when(k % 7 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(0), F.lit(1))).alias("gold"), F.array(F.when(k % 11 == 0, 1).otherwise(2)).alias("near"), F.array(F.when(k % 13 == 0, 99).otherwise(3)).alias("unrelated"))
    return by_rule(va.violations(rows, k, rp.calibration_rules()))


_PART = "SELECT count(*) FROM part WHERE {w}"
CALIBRATION_RULES_SQL = sql_rules({"resolved": _PART.format(w="p_partkey % 7 = 0 OR p_partkey % 13 = 0"), "disjoint": _PART.format(w="p_partkey % 7 > 0 AND p_partkey % 11 = 0"), "distractors": _PART.format(w="p_partkey % 5 = 0 AND p_partkey % 7 > 0")})


def corpus_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the orders' lines (active corpus), a manifest and the bindings differ, by rule."""
    k = F.col("l_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(k.alias("source_key"), F.concat(F.lit("v"), k).alias("version_id"), F.concat(F.lit("s"), F.when((k % 31 == 0) & (F.col("l_linenumber") > 1), k + 1).otherwise(k)).alias("chunk_set_id"), F.col("l_linenumber").alias("ordinal"))
    manifest = lines.filter("source_key % 17 > 0 AND NOT (source_key % 23 = 0 AND ordinal = 1)").select("source_key", "ordinal")
    bindings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_key"), F.concat(F.lit("v"), F.when(mod("o_orderkey", 29), 0).otherwise(F.col("o_orderkey"))).alias("version_id"), F.concat(F.lit("s"), "o_orderkey").alias("chunk_set_id"))
    return by_rule(rp.corpus_closure(lines.filter("source_key % 19 > 0"), manifest, bindings))


CLOSURE_RULES_SQL = """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS o FROM lineitem), a AS (SELECT * FROM l WHERE k % 19 > 0), m AS (SELECT * FROM l WHERE k % 17 > 0 AND NOT (k % 23 = 0 AND o = 1)),
s AS (SELECT o_orderkey AS k, o_orderkey IN (SELECT k FROM a) AS active, o_orderkey IN (SELECT k FROM m) AS listed, (SELECT count(DISTINCT CASE WHEN o > 1 THEN 1 ELSE 0 END) FROM a WHERE a.k = o_orderkey) AS parts, (SELECT min(o) FROM a WHERE a.k = o_orderkey) AS low FROM orders),
r AS (SELECT CASE WHEN NOT active THEN 'NOT_ACTIVE' WHEN NOT listed THEN 'NOT_IN_MANIFEST' WHEN k % 31 = 0 AND parts > 1 THEN 'AMBIGUOUS' WHEN k % 29 = 0 OR (k % 31 = 0 AND low > 1) THEN 'BINDING_MISMATCH' END AS rule FROM s),
d AS (SELECT DISTINCT coalesce(a.k, m.k) AS k FROM (SELECT DISTINCT k, o FROM a) a FULL JOIN (SELECT DISTINCT k, o FROM m) m ON a.k = m.k AND a.o = m.o WHERE a.k IS NULL OR m.k IS NULL)
SELECT rule, count(*) AS n FROM (SELECT rule FROM r UNION ALL SELECT 'CHUNKS_DIFFER' FROM d) WHERE rule IS NOT NULL GROUP BY rule"""


def alert_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of alert configurations: nations as definitions, the first of the four required classes left out."""
    k = F.col("n_nationkey")
    names = F.array(*[F.lit(x) for x in ALERT_CLASSES[1:]])
    metrics = F.array(*[F.lit(x) for x in METRICS])
    rows = table(spark, sf_dir, "nation").select(
        F.when(k < 3, F.get(names, (k % 3).cast("int"))).when(k % 6 == 0, "again").otherwise(F.col("n_name")).alias("alert_class"), F.when(k % 7 == 3, "unknown").otherwise(F.get(metrics, (k % 10).cast("int"))).alias("metric"),
        F.when(k % 5 == 1, float("nan")).otherwise(1.0).alias("threshold"), F.lit(0.5).alias("recovery"), F.when(k % 8 == 2, -1).otherwise(60).alias("sustain_seconds"), F.when(k % 9 > 0, "v1").otherwise("").alias("version"),
    )
    return by_rule(rp.alert_configuration_breaches(rows))


_NATION = "SELECT count(*) FROM nation WHERE {w}"
ALERT_RULES_SQL = sql_rules({
    "name": _NATION.format(w="n_nationkey % 9 = 0"), "metric": _NATION.format(w="n_nationkey % 7 = 3"), "bounds": _NATION.format(w="n_nationkey % 5 = 1"), "sustain": _NATION.format(w="n_nationkey % 8 = 2"),
    "once": "SELECT CASE WHEN count_if(n_nationkey >= 3 AND n_nationkey % 6 = 0) > 1 THEN 1 ELSE 0 END FROM nation", "missing": "SELECT 4 - count_if(n_nationkey < 3) FROM nation",
})


# --- coordination ------------------------------------------------------------------------------------------------


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lifecycle work of their own objects."""
    k = F.col("p_partkey")
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    return table(spark, sf_dir, "part").select(
        k.alias("work_id"), (k % 3).alias("workspace_id"), k.alias("object_key"), F.when(k % 5 == 0, "retry_scheduled").when(k % 7 == 0, "succeeded").otherwise("queued").alias("state"), (k % 6).cast("int").alias("attempt_count"), F.lit(4).alias("max_attempts"),
        at(k % 1000).alias("created_at"), F.when(k % 5 == 0, at(k % 400)).alias("next_attempt_at"), F.when(k % 4 == 0, at(k % 700)).alias("eligible_at"), F.when(k % 8 == 0, "failed_upload_diagnostic").otherwise("chunk").alias("artifact_class"), F.when(k % 8 == 0, at(k % 700 - 86_400 + k % 3 - 1)).alias("discovered_at"),
    )


NOW_S = 1_700_000_300


def lifecycle_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over all lifecycle work, with its place in the queue where it is due."""
    work, now = _work(spark, sf_dir), F.timestamp_seconds(F.lit(NOW_S))
    keys = lambda m, r: work.filter(f"work_id % {m} < {r}").select("workspace_id", "object_key")
    done = li.work_pass(work, keys(9, 7), keys(10, 2), now)
    bad = va.violations(work, F.col("work_id"), li.work_rules()).groupBy(F.col("subject").cast("long").alias("work_id")).agg(F.count("*").alias("breaches"))
    return done.join(bad, "work_id", "left").select("work_id", "outcome", F.coalesce("breaches", F.lit(0)).alias("breaches"))


PASS_SQL = """
WITH w AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 400 <= 300 ELSE p_partkey % 7 <> 0 END AND p_partkey % 6 < 4 AND (p_partkey % 4 <> 0 OR p_partkey % 700 <= 300) AS due FROM part)
SELECT k AS work_id, CASE WHEN NOT due THEN 'not_eligible' WHEN k % 10 < 2 THEN 'suppressed' WHEN k % 9 < 7 THEN 'deleted' ELSE 'succeeded' END AS outcome,
  CAST(CASE WHEN k % 6 > 4 THEN 1 ELSE 0 END + CASE WHEN k % 8 = 0 AND k % 3 = 2 THEN 1 ELSE 0 END AS BIGINT) AS breaches FROM w"""


def lifecycle_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten due items of every workspace, first in, first out."""
    work = _work(spark, sf_dir).filter(li.lifecycle_due(F.timestamp_seconds(F.lit(NOW_S))))
    return rt.top_k(work, li.lifecycle_order(), 10, "place", "workspace_id").select("workspace_id", "work_id", F.col("place").cast("long").alias("place"))


QUEUE_SQL = """
WITH w AS (SELECT p_partkey AS k FROM part WHERE CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 400 <= 300 ELSE p_partkey % 7 <> 0 END AND p_partkey % 6 < 4 AND (p_partkey % 4 <> 0 OR p_partkey % 700 <= 300))
SELECT k % 3 AS workspace_id, k AS work_id, row_number() OVER (PARTITION BY k % 3 ORDER BY k % 1000, k) AS place FROM w QUALIFY place <= 10"""


def lifecycle_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all order lines, read as work on their parts, add to the work that the first parts have."""
    key = lambda k: [(k % 3).alias("workspace_id"), k.alias("object_key"), F.lit("chunk").alias("artifact_class"), (k % 2).alias("generation")]
    known = table(spark, sf_dir, "part").filter("p_partkey % 4 = 0").select(*key(F.col("p_partkey")))
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("work_id"), *key(F.col("l_partkey")))
    return li.enqueue(known, items).select("object_key", "work_id")


ENQUEUE_SQL = "SELECT l_partkey AS object_key, min(l_orderkey * 10 + l_linenumber) AS work_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 4 = 0) GROUP BY l_partkey"


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs, two thirds of them processing."""
    k = F.col("o_orderkey")
    lease = F.timestamp_seconds(F.lit(NOW_S) + k % 50 - 10)
    return table(spark, sf_dir, "orders").select(k.alias("job_id"), F.when(k % 3 == 0, "queued").otherwise("processing").alias("state"), (k % 4 + 1).cast("int").alias("attempt_count"), F.when(k % 3 > 0, "w").alias("worker_id"), (k % 2).alias("fence"), F.when(k % 3 > 0, lease).alias("lease_until"), F.lit(None).cast("timestamp").alias("next_attempt_at"))


def terminal_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of all jobs after terminal failures of four fifths of them, some from stale or wrong attempts."""
    jobs = _held(spark, sf_dir)
    k = F.col("job_id")
    failures = jobs.filter("job_id % 5 > 0").select("job_id", F.when(k % 7 == 0, "other").otherwise("w").alias("worker_id"), (k % 2 + (k % 11 == 0).cast("int")).alias("fence"), F.when(k % 13 == 0, 9).otherwise(F.col("attempt_count")).alias("attempt"), F.when(k % 2 == 0, "invalid_input").otherwise("configuration_invalid").alias("cause"))
    done = li.fail_terminally(jobs, failures, F.timestamp_seconds(F.lit(NOW_S)))
    return done.groupBy("state", "outcome", "failure_reason").agg(F.count("*").alias("n"), F.count("worker_id").alias("held"))


FAILURES_SQL = """
WITH j AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 50 <= 10 THEN 'fenced' WHEN o_orderkey % 13 = 0 THEN 'invalid' ELSE 'applied' END AS outcome FROM orders)
SELECT CASE WHEN outcome = 'applied' THEN 'failed' WHEN k % 3 = 0 THEN 'queued' ELSE 'processing' END AS state, outcome, CASE WHEN outcome = 'applied' THEN CASE WHEN k % 2 = 0 THEN 'terminal_input' ELSE 'terminal_config' END END AS failure_reason,
  count(*) AS n, CAST(count_if(k % 3 > 0 AND outcome IS DISTINCT FROM 'applied') AS BIGINT) AS held FROM j GROUP BY ALL"""


def reprocess_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of requests to process every order's customer again: customers are documents, nations configurations."""
    k = F.col("o_orderkey")
    requests = table(spark, sf_dir, "orders").select(k.alias("request_id"), (k % 3).alias("workspace_id"), k.alias("key"), F.col("o_orderpriority").alias("fingerprint"), F.col("o_custkey").alias("document_id"), F.when(k % 10 == 0, -1).otherwise(F.col("o_custkey")).alias("version_id"), (k % 4).alias("configuration"))
    cust = F.col("c_custkey")
    current = table(spark, sf_dir, "customer").filter("c_custkey % 17 > 0").select(cust.alias("document_id"), cust.alias("version_id"))
    sources = table(spark, sf_dir, "customer").filter("c_custkey % 13 > 0").select(cust.alias("version_id"))
    records = requests.filter("request_id % 6 = 0").select("workspace_id", "key", F.when(mod("request_id", 12), "other").otherwise(F.col("fingerprint")).alias("fingerprint"), (F.col("request_id") + 1_000_000).alias("job_id"), F.when(mod("request_id", 18), F.lit("2020-01-01")).otherwise("2030-01-01").cast("timestamp").alias("expires_at"))
    jobs = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(cust.alias("job_id"), cust.alias("version_id"), F.lit(1).cast("long").alias("configuration"), F.when(cust % 4 == 0, "succeeded").otherwise("queued").alias("state"), F.lit(0).alias("created_at"))
    return li.reprocess(requests, current, sources, records, jobs, F.lit("2024-01-01").cast("timestamp")).select("request_id", "outcome", "job_id")


REPROCESS_SQL = """
WITH r AS (SELECT o_orderkey AS k, o_custkey AS d, o_orderkey % 10 = 0 AS old, d IN (SELECT c_custkey FROM customer) AS there, o_orderkey % 6 = 0 AND o_orderkey % 18 > 0 AS live FROM orders),
o AS (SELECT k, d, CASE WHEN NOT there OR d % 17 = 0 THEN 'DOCUMENT_VERSION_NOT_FOUND' WHEN old THEN 'DOCUMENT_VERSION_NOT_CURRENT' WHEN d % 13 = 0 THEN 'SOURCE_OBJECT_NOT_AVAILABLE' WHEN live AND k % 12 = 0 THEN 'IDEMPOTENCY_KEY_CONFLICT'
  WHEN live THEN 'idempotency_replay' WHEN d % 4 = 0 AND k % 4 = 1 THEN 'reused' ELSE 'created' END AS outcome FROM r)
SELECT k AS request_id, outcome, CASE outcome WHEN 'idempotency_replay' THEN k + 1000000 WHEN 'reused' THEN d END AS job_id FROM o"""


def attempt_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches between jobs and their open attempts, by rule."""
    jobs = _held(spark, sf_dir)
    k = F.col("job_id")
    attempts = jobs.filter((k % 3 > 0) & (k % 7 > 0) | (k % 9 == 0)).select("job_id", F.col("attempt_count").alias("attempt_number"), F.when(k % 11 == 0, "other").otherwise(F.col("worker_id")).alias("worker_id"), "fence", F.lit(None).cast("timestamp").alias("closed_at"))
    return by_rule(li.correspondence_breaches(jobs, attempts.union(attempts.filter("job_id % 13 = 0"))))


CORRESPONDENCE_SQL = sql_rules({
    "ONE_OPEN_ATTEMPT": _ORDERS.format(w="o_orderkey % 3 > 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 13 = 0)"), "PROJECTION_MISMATCH": _ORDERS.format(w="o_orderkey % 3 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 13 > 0 AND o_orderkey % 11 = 0"),
    "OPEN_ATTEMPT_OF_IDLE_JOB": _ORDERS.format(w="o_orderkey % 9 = 0"),
})


# --- derivation --------------------------------------------------------------------------------------------------


def derivation_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of pages and chunks made of the web pages, damaged by their ids."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select(k.alias("doc_id"), F.when(k % 7 == 0, 0).otherwise(1).alias("page_number"), F.col("html").alias("text"), F.when(k % 11 == 0, "x").otherwise(F.sha2("html", 256)).alias("checksum"))
    piece = lambda i: F.struct(F.lit(i).alias("ordinal"), F.lit(i * 10).alias("start"), F.lit(i * 10 + 10).alias("end"))
    chunks = pages.filter(F.length("text") >= 20).select("doc_id", "page_number", "text", F.explode(F.array(piece(0), piece(1))).alias("p")).select("doc_id", "page_number", "text", "p.*")
    content = F.substring("text", F.col("start") + 1, F.lit(10))
    d = F.col("doc_id")
    chunks = chunks.select("doc_id", F.when(d % 5 == 0, F.col("ordinal") + 1).otherwise(F.col("ordinal")).alias("ordinal"), F.when(d % 13 == 0, 9).otherwise(F.col("page_number")).alias("page_number"), "start", "end", F.when(d % 6 == 1, F.concat(content, F.lit("!"))).otherwise(content).alias("content"), (F.col("ordinal") * (d % 8)).cast("int").alias("token_count"))
    return by_rule(de.derivation_breaches(pages, chunks.withColumn("checksum", F.sha2("content", 256))))


_PAGES = "SELECT count(*) FROM pages WHERE {w}"
DERIVATION_SQL = sql_rules({
    "page number": _PAGES.format(w="page_id % 7 = 0"), "page checksum": _PAGES.format(w="page_id % 11 = 0"), "ordinals": _PAGES.format(w="length(html) >= 20 AND page_id % 5 = 0"),
    "page": "SELECT 2 * count(*) FROM pages WHERE length(html) >= 20 AND page_id % 13 = 0", "offsets": "SELECT 2 * count(*) FROM pages WHERE length(html) >= 20 AND page_id % 13 = 0",
    "content": "SELECT 2 * count(*) FROM pages WHERE length(html) >= 20 AND (page_id % 13 = 0 OR page_id % 6 = 1)", "tokens": "SELECT sum(CASE WHEN page_id % 8 = 0 THEN 2 ELSE 1 END)::BIGINT FROM pages WHERE length(html) >= 20",
})


def _six(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as documents, each with a version, chunk set and embedding set, and their lines as chunks with vectors."""
    k, at = F.col("o_orderkey"), lambda p, x: F.concat(F.lit(p), x.cast("string"))
    o, li_ = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    chunk = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return {
        "documents": o.select(k.alias("document_id"), (k % 5).alias("workspace_id"), at("doc/", k).alias("source_key"), at("v", k).alias("version_id"), F.when(k % 7 > 0, at("e", k)).alias("embedding_set_id")),
        "versions": o.filter("o_orderkey % 11 > 0").select(at("v", k).alias("version_id"), k.alias("document_id")),
        "chunk_sets": o.select(at("s", k).alias("chunk_set_id"), at("v", k).alias("version_id")),
        "chunks": li_.select(chunk.alias("chunk_id"), at("s", F.col("l_orderkey")).alias("chunk_set_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").cast("string").alias("content")).distinct(),
        "embedding_sets": o.select(at("e", k).alias("embedding_set_id"), at("s", k).alias("chunk_set_id"), F.when(k % 3 == 0, "old").otherwise("new").alias("configuration_id"), F.when(k % 13 == 0, "pending").otherwise("completed").alias("status")),
        "embeddings": li_.filter("l_linenumber < 5").select(chunk.alias("chunk_id"), at("e", F.col("l_orderkey")).alias("embedding_set_id"), F.array(F.lit(1.0)).alias("vector")).distinct(),
    }


def active_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active corpus of six tables by workspace: documents, chunks and the last ordinal."""
    rows = de.active_corpus(**_six(spark, sf_dir), configuration="new")
    return rows.groupBy("workspace_id").agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("chunk_id").alias("chunks"), F.max("ordinal").cast("long").alias("last"))


_LIVE = "l_orderkey IN (SELECT o_orderkey FROM orders) AND l_orderkey % 7 > 0 AND l_orderkey % 11 > 0 AND l_orderkey % 3 > 0 AND l_orderkey % 13 > 0 AND l_linenumber < 5"
CORPUS_SQL = f"SELECT l_orderkey % 5 AS workspace_id, count(DISTINCT l_orderkey) AS documents, count(DISTINCT l_orderkey || '-' || l_linenumber) AS chunks, CAST(max(l_linenumber) AS BIGINT) AS last FROM lineitem WHERE {_LIVE} GROUP BY 1"


def unresolved_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trace candidates, some of a foreign workspace, that the active corpus does not hold, by workspace."""
    corpus = de.active_corpus(**_six(spark, sf_dir), configuration="new")
    k = F.col("l_orderkey")
    asked = table(spark, sf_dir, "lineitem").select(k.alias("query_id"), F.when(k % 17 == 0, (k + 1) % 5).otherwise(k % 5).alias("workspace_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"))
    return de.unresolved_candidates(asked, corpus).groupBy("workspace_id").agg(F.count("*").alias("n"))


UNRESOLVED_SQL = f"SELECT CASE WHEN l_orderkey % 17 = 0 THEN (l_orderkey + 1) % 5 ELSE l_orderkey % 5 END AS workspace_id, count(*) AS n FROM lineitem WHERE NOT ({_LIVE}) OR l_orderkey % 17 = 0 GROUP BY 1"


def reembedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to embed of every workspace and whether its activation may follow; source keys of two workspaces repeat."""
    six = _six(spark, sf_dir)
    members = six["documents"].select("workspace_id", F.when((F.col("workspace_id") == 1) & mod("document_id", 3), "doc/same").otherwise(F.col("source_key")).alias("source_key"), F.concat(F.lit("s"), "document_id").alias("chunk_set_id"))
    existing = six["embedding_sets"].join(six["documents"].select("embedding_set_id", "workspace_id"), "embedding_set_id", "left").filter("status = 'completed' OR workspace_id IN (1, 2)").select("chunk_set_id")
    existing = existing.union(six["chunk_sets"].filter(F.substring("chunk_set_id", 2, 20).cast("long") % 5 < 3).select("chunk_set_id"))
    return de.reembedding_plan(members, existing)


REEMBEDDING_SQL = """
WITH m AS (SELECT o_orderkey AS k, o_orderkey % 5 AS w, CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 3 = 0 THEN 'same' ELSE CAST(o_orderkey AS VARCHAR) END AS s, o_orderkey % 13 > 0 OR o_orderkey % 5 < 3 AS has FROM orders)
SELECT w AS workspace_id, count(*) AS n_members, CAST(count_if(NOT has) AS BIGINT) AS to_embed, count_if(NOT has) = 0 AND count(DISTINCT s) = count(*) AS may_activate FROM m GROUP BY w"""


def pair_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest over all overlapping pairs of documents and benchmark items."""
    found = eq.contamination_audit(spark, sf_dir)
    return de.pair_digest(found.select(F.col("doc_id").alias("left_id"), F.col("item_id").alias("right_id"), "exact", (F.col("common") / F.col("smaller")).alias("overlap")))


PAIR_SQL = "WITH c AS (" + eq.CONTAMINATION_SQL + """),
d AS (SELECT doc_id, item_id, sha256('{"calibration_item_id":' || doc_id || ',"development_item_id":' || item_id || ',"exact_normalized_copy":' || exact || ',"normalized_token_overlap":"' || printf('%.12f', common / smaller) || '"}') AS d FROM c)
SELECT count(*) AS n_pairs, sha256(coalesce(string_agg(d, chr(10) ORDER BY doc_id, item_id), '')) AS digest FROM d"""


# --- more coordination -------------------------------------------------------------------------------------------


def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes of failures made from the events, by kind and code; codes that are none of their kind's have none."""
    kinds, codes = list(SAFE_CODES), [x for v in SAFE_CODES.values() for x in v]
    k = F.col("event_id")
    pick = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), (at % len(names)).cast("int"))
    rows = table(spark, sf_dir, "events").select(pick(kinds, k).alias("kind"), pick(codes, F.floor(k / 3)).alias("code"))
    return rows.withColumn("cause", op.failure_cause(F.col("kind"), F.col("code"))).groupBy("kind", "cause").agg(F.count("*").alias("n"))


_KINDS = "[" + ", ".join(f"'{k}'" for k in SAFE_CODES) + "]"
_CODES = "[" + ", ".join(f"'{c}'" for v in SAFE_CODES.values() for c in v) + "]"
_OWNERS = "[" + ", ".join(f"'{k}'" for k, v in SAFE_CODES.items() for _ in v) + "]"
CAUSES_SQL = f"WITH e AS (SELECT {_KINDS}[event_id % {len(SAFE_CODES)} + 1] AS kind, {_OWNERS}[(event_id // 3) % len({_CODES}) + 1] AS owner FROM events) SELECT kind, CASE WHEN kind = owner THEN kind END AS cause, count(*) AS n FROM e GROUP BY ALL"


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as submissions: every third key has a record, every second customer a job of the same content."""
    k = F.col("o_orderkey")
    requests = table(spark, sf_dir, "orders").select(k.alias("request_id"), (k % 3).alias("workspace_id"), k.alias("key"), F.col("o_orderpriority").alias("fingerprint"), F.col("o_custkey").alias("content"))
    records = requests.filter("request_id % 6 = 0").select("workspace_id", "key", F.when(mod("request_id", 12), "other").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(mod("request_id", 18), F.lit("2020-01-01")).otherwise("2030-01-01").cast("timestamp").alias("expires_at"))
    jobs = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.lit(1).cast("long").alias("workspace_id"), F.col("c_custkey").alias("content"))
    return li.submit(requests, records, F.lit("2024-01-01").cast("timestamp"), "request_id", jobs).select("request_id", "outcome")


SUBMISSIONS_SQL = """
WITH r AS (SELECT *, o_orderkey % 3 AS ws, o_orderkey % 6 = 0 AND o_orderkey % 18 > 0 AS live FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY ws, o_custkey, live ORDER BY o_orderkey) AS nth FROM r)
SELECT o_orderkey AS request_id, CASE WHEN live THEN CASE WHEN o_orderkey % 12 = 0 THEN 'conflict' ELSE 'replayed' END
  WHEN nth > 1 OR ws = 1 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) THEN 'deduplicated' ELSE 'created' END AS outcome FROM f"""


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a beat of every order read as a job, some sent before, some with a stale fence."""
    jobs, k = _held(spark, sf_dir), F.col("job_id")
    beats = jobs.select((k * 2).alias("operation_id"), "job_id", (F.col("fence") + (k % 7 == 0).cast("int")).alias("fence"))
    applied = beats.filter("job_id % 5 = 0").select("operation_id")
    return li.heartbeat_outcomes(jobs, beats, applied, F.timestamp_seconds(F.lit(NOW_S))).groupBy("outcome").agg(F.count("*").alias("n"))


BEATS_SQL = "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'replayed' WHEN o_orderkey % 3 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 50 > 10 THEN 'extended' ELSE 'fenced' END AS outcome, count(*) AS n FROM orders GROUP BY 1"


def attempt_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recovery does with the open attempts of expired jobs, by outcome."""
    jobs = _held(spark, sf_dir)
    attempts = jobs.filter("job_id % 7 > 0").select("job_id", F.when(mod("job_id", 11), 9).otherwise(F.col("attempt_count")).alias("attempt_number"), F.when(mod("job_id", 13), F.lit("2020-01-01")).cast("timestamp").alias("closed_at"))
    return li.recover_attempts(jobs, attempts, F.timestamp_seconds(F.lit(NOW_S))).groupBy("outcome").agg(F.count("*").alias("n"), F.count("attempt_number").alias("attempts"))


RECOVERY_SQL = """
WITH e AS (SELECT o_orderkey AS k, o_orderkey % 7 > 0 AND o_orderkey % 13 > 0 AS opened FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 50 <= 10)
SELECT CASE WHEN NOT opened OR k % 11 = 0 THEN 'INCONSISTENT' WHEN k % 4 + 1 >= 4 THEN 'failed' ELSE 'retry_scheduled' END AS outcome, count(*) AS n, CAST(count_if(opened) AS BIGINT) AS attempts FROM e GROUP BY 1"""


def nested_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the events' traces refer to in arrays, map values and nested metadata, and those nothing refers to."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    said = F.format_string('{"a": [{"%s": {"deep": "%s"}}]}', (k % 31).cast("string"), (k % 37).cast("string"))
    ids = li.reference_ids([F.array(k % 11, F.col("user_id") % 13)], [F.create_map(F.lit("E1"), k % 17 + 20)], [said])
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    return li.blockers(docs, "doc_id", {"traces": e.select(ids.alias("ids"))})


NESTED_SQL = """
WITH r AS (SELECT event_id, unnest(list_distinct([event_id % 11, user_id % 13, event_id % 17 + 20, event_id % 37])) AS id FROM events), c AS (SELECT CAST(id AS VARCHAR) AS id, count(*) AS n FROM r GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(n, 0) AS traces, n IS NULL AS deletable FROM documents LEFT JOIN c ON c.id = CAST(doc_id AS VARCHAR)"""


def split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a training and a test half of the documents have in common, which have to be apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return va.disjoint(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "digest", "halves apart")


SPLIT_SQL = "SELECT DISTINCT sha256(text) AS subject, 'halves apart' AS rule FROM documents WHERE doc_id % 2 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 1)"


def alert_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert states by class and configuration version: users' samples under two versions do not mix."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 2).alias("version"), "event_id", F.col("ts").alias("at"), "value")
    rows = op.alert_states(e, 60.0, 30.0, 3600, ["event_type", "version"])
    return rows.groupBy("event_type", "version").agg(F.count("*").alias("n"), F.count("breach_started").alias("breached"), F.count_if("firing").alias("firing"))


VERSIONS_SQL = "WITH f AS (" + ALERT_SQL.replace("FROM events", "FROM (SELECT user_id % 2 AS version, event_type || '/' || user_id % 2 AS event_type, event_id, ts, value FROM events)").replace("SELECT event_id, epoch_us", "SELECT event_type, event_id, epoch_us") + """)
SELECT split_part(event_type, '/', 1) AS event_type, CAST(split_part(event_type, '/', 2) AS BIGINT) AS version, count(*) AS n, count(breach_started_us) AS breached, CAST(count_if(firing) AS BIGINT) AS firing FROM f GROUP BY 1, 2"""


_PAIRS = {
    canonical_digests: CANONICAL_SQL, json_references: JSON_SQL, next_threshold: NEXT_SQL, provenance_differences: DIFFERENCES_SQL, trace_assembly: ASSEMBLY_SQL, trace_contracts: TRACE_RULES_SQL,
    observation_contracts: OBSERVATION_SQL, timing_contracts: TIMING_SQL, query_embeddings: QUERY_EMBEDDING_SQL, response_contracts: RESPONSE_SQL, citation_contracts: CITATION_SQL, structural_report: STRUCTURAL_SQL,
    retrieval_exclusions: EXCLUSION_SQL, system_summary: SYSTEM_SQL, semantic_summary: SEMANTIC_SUMMARY_SQL, runtime_consensus: CONSENSUS_SQL, category_contracts: CATEGORY_SQL, observation_set: OBSERVATION_SET_SQL,
    report_guardrails: GUARDRAILS_SQL, improvement_selection: SELECTION_SQL, canonical_references: REFERENCES_SQL, calibration_contracts: CALIBRATION_RULES_SQL, corpus_closure: CLOSURE_RULES_SQL, alert_configuration: ALERT_RULES_SQL,
    lifecycle_pass: PASS_SQL, lifecycle_queue: QUEUE_SQL, lifecycle_enqueue: ENQUEUE_SQL, terminal_failures: FAILURES_SQL, reprocess_outcomes: REPROCESS_SQL, attempt_correspondence: CORRESPONDENCE_SQL,
    derivation_contracts: DERIVATION_SQL, active_corpus: CORPUS_SQL, unresolved_candidates: UNRESOLVED_SQL, reembedding: REEMBEDDING_SQL, pair_population: PAIR_SQL,
    failure_causes: CAUSES_SQL, submissions: SUBMISSIONS_SQL, heartbeats: BEATS_SQL, attempt_recovery: RECOVERY_SQL, nested_blockers: NESTED_SQL, split_leaks: SPLIT_SQL, alert_versions: VERSIONS_SQL,
}
QUERIES = {f.__name__: f for f in _PAIRS}
ORACLE_SQL = {f.__name__: sql for f, sql in _PAIRS.items()}
