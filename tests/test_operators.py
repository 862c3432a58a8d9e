"""Golden values and edge cases of evidence, fusion, calibration, lifecycle and contracts."""

import datetime as dt
import random
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.config import Calibration
from citeloom.functions import vectors as vx
from citeloom.operators import answering as an
from citeloom.operators import evaluation as el
from citeloom.operators import evidence as ev
from citeloom.operators import lifecycle as li
from citeloom.operators import operations as op
from citeloom.operators import retrieval as rt
from citeloom.operators import validation as va

CANDIDATE = "query_id long, fused_rank int, chunk_id long, chunk_set string, ordinal int, content string, token_count int"


def outcomes(spark, rows):
    found = ev.select_evidence(spark.createDataFrame(rows, CANDIDATE)).orderBy("final_rank").collect()
    return [r["outcome"] for r in found], found


def test_token_budget_skips_and_goes_on(spark):
    said, found = outcomes(spark, [(1, i + 1, i, "s", 10 * i, f"w{i}", t) for i, t in enumerate((1, 1000, 1000, 1000, 1))])
    assert said == ["SELECTED"] * 3 + ["TOKEN_BUDGET_EXCEEDED", "SELECTED"]
    assert found[-1]["token_total"] == 2002
    assert ev.reconcile_budget(spark.createDataFrame(found), 5, 3000).count() == 0
    broken = spark.createDataFrame(found).withColumn("selected_token_count", F.col("selected_token_count") + (F.col("final_rank") == 3).cast("int"))
    assert [r["final_rank"] for r in ev.reconcile_budget(broken, 5, 3000).collect()] == [3]


def test_chunk_limit(spark):
    said, _ = outcomes(spark, [(1, i + 1, i, "s", 10 * i, f"w{i}", 1) for i in range(6)])
    assert said == ["SELECTED"] * 5 + ["CHUNK_COUNT_LIMIT"]


def test_redundant_neighbours(spark):
    rows = [(1, 1, 1, "s", 1, "a b c d", 4), (1, 2, 2, "s", 2, "A, b! x y", 4), (1, 3, 3, "s", 3, "a b c d", 4), (1, 4, 4, "t", 2, "a b c d", 4)]
    said, _ = outcomes(spark, rows)
    assert said == ["SELECTED", "REDUNDANT_OVERLAP", "SELECTED", "SELECTED"]


def branch(spark, rows, native):
    kind = "native_rank long" if native else "similarity double"
    return spark.createDataFrame(rows, f"query_id long, chunk_id string, branch_rank int, {kind}")


def test_fusion(spark):
    v = branch(spark, [(1, "b", 1, 0.9), (1, "a", 2, 0.8)], False)
    f = branch(spark, [(1, "b", 1, 5), (1, "c", 2, 3)], True)
    rows = rt.fuse(v, f).orderBy("fused_rank").collect()
    assert [(r["chunk_id"], r["fused_rank"]) for r in rows] == [("b", 1), ("a", 2), ("c", 3)]
    assert rows[0]["fusion_score"] == pytest.approx(2 / 61)
    assert va.violations(spark.createDataFrame(rows), F.col("chunk_id"), va.fused_rules()).count() == 0


def test_stop_word_question_has_no_full_text_branch(spark):
    q = spark.createDataFrame([(1, "the and what")], "query_id long, question string")
    c = spark.createDataFrame([(1, "the and what")], "chunk_id long, content string")
    assert rt.fts_branch(q, c, 8, False, []).count() == 0


def test_identifier_is_found(spark):
    q = spark.createDataFrame([(1, "ZX-42")], "query_id long, question string")
    c = spark.createDataFrame([(1, "part zx-42 here"), (2, "zx only")], "chunk_id long, content string")
    assert [r["chunk_id"] for r in rt.fts_branch(q, c, 8, True, []).collect()] == [1]


def test_cover_density(spark):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "query_id long, question string")
    texts = ["alpha beta", "alpha x1 x2 beta", "alpha beta alpha", "alpha only", "x1 beta x2 beta alpha", "gamma, gamma"]
    c = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    found = {(r["query_id"], r["chunk_id"]): (r["branch_rank"], r["native_rank"]) for r in rt.fts_branch(q, c, 8, True, []).collect()}
    third = pytest.approx(0.1 / 3)
    assert found == {(1, 2): (1, 0.2), (1, 0): (2, 0.1), (1, 4): (3, 0.1), (1, 1): (4, third), (2, 5): (1, 0.2)}


def test_blockers(spark):
    objects = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    refs = {"a": spark.createDataFrame([([1, 2],), ([1],), (None,)], "ids array<long>"), "b": spark.createDataFrame([([9],)], "ids array<long>")}
    assert sorted(map(tuple, li.blockers(objects, "k", refs).collect())) == [(1, 2, 0, False), (2, 1, 0, False), (3, 0, 0, True)]


def test_answers_and_citations(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    e = spark.createDataFrame([(1, "E1", 1, "text", "doc", 3)], "query_id long, alias string, final_rank int, content string, source_key string, ordinal int")
    said = an.answers(q, e)
    assert {r["query_id"]: (r["decision"], r["answer"], r["refusal_reason"]) for r in said.collect()} == {1: ("ANSWER", "text [[E1]]", None), 2: ("REFUSAL", None, "INSUFFICIENT_EVIDENCE")}
    assert [r["reference"] for r in an.citations(said, e).collect()] == ["doc#3"]


def test_calibration_golden(spark):
    schema = "case_id string, gold array<string>, top array<struct<chunk_id:string,similarity:double>>"
    cases = spark.createDataFrame([("a", ["g1"], [("g1", 0.95), ("n1", 0.6)]), ("b", ["g2"], [("g2", 0.85), ("n2", 0.5)])], schema)
    hard = spark.createDataFrame([(0.7,)], "similarity double")
    row = el.calibrate(cases, hard).first()
    assert (row["passed"], row["threshold"]) == (True, 0.85)
    row = el.calibrate(cases, spark.createDataFrame([(0.9,)], "similarity double")).first()
    assert (row["passed"], row["threshold"], row["gate_3"], row["gate_4"]) == (False, None, False, False)
    assert el.calibrate(cases, hard.filter("false"), Calibration()).first()["passed"]


def test_exact_mean(spark):
    rows = spark.createDataFrame([(1, 2), (1, 3), (0, 1)], "p long, q long")
    assert tuple(el.exact_mean(rows, "p", "q").first()) == (3, 5, 18)
    assert tuple(el.exact_mean(spark.createDataFrame([(1, 11), (1, 3)], "p long, q long"), "p", "q").first()) == (2, 7, 33)
    assert el.exact_mean(rows.filter("false"), "p", "q").collect() == []


def test_exact_mean_of_any_denominators(spark):
    fractions = [Fraction(i % 7, 1000 + i % 900) for i in range(2500)]
    rows = spark.createDataFrame([(i % 7, 1000 + i % 900) for i in range(2500)], "p long, q long").repartition(4)
    want = sum(fractions) / len(fractions)
    n, p, q = el.exact_mean_text(rows, "p", "q").first()
    assert (n, int(p), int(q)) == (2500, want.numerator, want.denominator) and len(q) > 38
    with pytest.raises(Exception, match="(?i)cast|overflow|range"):
        el.exact_mean(rows, "p", "q").collect()
    with pytest.raises(Exception, match="needs a numerator"):
        el.exact_mean(spark.createDataFrame([(1, 0)], "p long, q long"), "p", "q").collect()


def test_submit_creates_once(spark):
    """Of several requests of a new key in one batch the first creates, the others replay or conflict; an expired record counts as none."""
    requests = spark.createDataFrame([(1, 7, "k", "a", "c1"), (2, 7, "k", "a", "c1"), (3, 7, "k", "b", "c2"), (4, 7, "old", "x", "c3"), (5, 7, "old", "x", "c3"), (6, 7, "live", "y", "c4"), (7, 7, "live", "z", "c4"), (8, 7, "new", "q", "c1"), (9, 8, "k", "a", "c1"), (10, 7, "job", "r", "c9")], "id long, workspace_id long, key string, fingerprint string, content string")
    records = spark.createDataFrame([(7, "old", "w", "2020-01-01"), (7, "live", "y", "2030-01-01")], "workspace_id long, key string, fingerprint string, at string").withColumn("expires_at", F.col("at").cast("timestamp"))
    now, jobs = F.lit("2024-01-01").cast("timestamp"), spark.createDataFrame([(7, "c9")], "workspace_id long, content string")
    found = {r["id"]: r["outcome"] for r in li.submit(requests, records, now, "id", jobs).collect()}
    assert found == {1: "created", 2: "replayed", 3: "conflict", 4: "created", 5: "replayed", 6: "replayed", 7: "conflict", 8: "deduplicated", 9: "created", 10: "deduplicated"}
    found = {r["id"]: r["outcome"] for r in li.submit(requests, records, now, "id").collect()}
    assert found[8] == "created" and found[10] == "created" and found[2] == "replayed"


def test_overlap_pairs_equal_the_cross_join(spark):
    import random

    rng = random.Random(3)
    sets = lambda n: [(i, rng.sample([f"t{j}" for j in range(14)], rng.randint(1, 9))) for i in range(n)]
    a, b = sets(60), sets(50)
    frame = lambda x: spark.createDataFrame(x, "id long, words array<string>")
    found = {(r["left_id"], r["right_id"]) for r in el.overlap_pairs(frame(a), frame(b)).collect()}
    assert found == {(i, j) for i, x in a for j, y in b if len(set(x) & set(y)) >= round(0.8 * min(len(x), len(y)), 9)}


NOW = dt.datetime(2024, 1, 1, 12)
JOB = "job_id long, workspace_id long, state string, created_at timestamp, next_attempt_at timestamp, attempt_count int, max_attempts int, fence int, lease_until timestamp"
T0 = dt.datetime(2024, 1, 1, 11)


def test_claim_heartbeat_and_recovery(spark):
    jobs = spark.createDataFrame(
        [(1, 1, "queued", T0, None, 0, 4, 0, None), (2, 1, "retry_scheduled", T0, T0, 1, 4, 1, None), (3, 1, "retry_scheduled", T0, dt.datetime(2024, 1, 1, 13), 1, 4, 1, None), (4, 2, "processing", T0, None, 4, 4, 7, T0), (5, 2, "queued", T0, None, 4, 4, 0, None)],
        JOB,
    )
    after = {r["job_id"]: r for r in li.claim(jobs, F.lit(NOW), 120).collect()}
    assert [after[i]["state"] for i in range(1, 6)] == ["processing", "retry_scheduled", "retry_scheduled", "processing", "queued"]
    assert (after[1]["fence"], after[1]["attempt_count"]) == (1, 1)
    recovered = li.recover_expired(jobs, F.lit(NOW)).collect()
    assert [(r["job_id"], r["state"]) for r in recovered] == [(4, "failed")]
    beats = spark.createDataFrame([(1, 1), (2, 99)], "job_id long, fence int")
    beaten = {r["job_id"]: r["lease_until"] for r in li.heartbeat(li.claim(jobs, F.lit(NOW), 10), beats, F.lit(NOW), 300).collect()}
    assert beaten[1] == dt.datetime(2024, 1, 1, 12, 5)


def test_finalize(spark):
    jobs = spark.createDataFrame([(1, 3, "processing"), (2, 3, "processing"), (3, 3, "failed")], "job_id long, fence int, state string")
    results = spark.createDataFrame([(1, 3, 9, 5), (2, 2, 9, 5), (3, 3, 9, 5), (1, 3, 8, 5)], "job_id long, fence int, document_id long, target_version long")
    current = spark.createDataFrame([(9, 5), (8, 6)], "document_id long, current_version long")
    assert sorted((r["job_id"], r["outcome"]) for r in li.finalize(jobs, results, current).collect()) == [(1, "succeeded"), (1, "superseded"), (2, "stale"), (3, "stale")]


def test_alert_hysteresis(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    values = [(0, 70.0), (1, 50.0), (2, 80.0), (3, 65.0), (4, 30.0), (5, 90.0), (6, None), (7, 10.0)]
    rows = spark.createDataFrame([("c", at(m), v) for m, v in values], "class string, at timestamp, value double")
    found = op.alert_states(rows, 60.0, 30.0, 120, ["class"]).orderBy("at").collect()
    assert [r["firing"] for r in found] == [False, False, True, True, False, False, False, False]
    assert found[5]["breach_started"] == at(5) and found[6]["breach_started"] is None


def test_histogram_and_rate(spark):
    rows = spark.createDataFrame([(500,), (2_000_000,), (400_000_000,)], "us long")
    hist = op.histogram(rows, "us")
    assert hist.count() == 17
    assert {r["bound"]: r["count"] for r in hist.collect()}[float("inf")] == 3
    assert va.histogram_rules(hist).count() == 0
    assert va.histogram_rules(hist.filter("bound < 1")).count() == 1


def test_contracts_report_each_breach(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, None, -1)], "id long, t string, n int")
    found = va.violations(rows, F.col("id"), {"t": F.col("t").isNotNull(), "n": F.col("n") >= 0})
    assert sorted((r["subject"], r["rule"]) for r in found.collect()) == [("2", "n"), ("2", "t")]
    with pytest.raises(ValueError, match="2: "):
        va.require_none(found)
    va.require_none(found.filter("false"))


def test_claim_rule(spark):
    rows = spark.createDataFrame([(0.1, 0.0, True), (0.1, -0.1, True), (0.0, 0.0, True), (1.0, 1.0, False)], "a double, b double, ok boolean")
    said = [r[0] for r in rows.select(el.claim_decision([F.col("a"), F.col("b")], F.col("ok"))).collect()]
    assert said == ["CLAIM", "NO_QUALIFYING_DELTA", "NO_QUALIFYING_DELTA", "GUARDRAIL_FAILURE"]


def test_vector_rankings_equal_plain_pairs(spark):
    """The rankings of all pairs by `vx.cosine`: copies, ties at the threshold, odd vectors and lengths."""
    rng = random.Random(7)
    rows = [(i, i % 2, [rng.choice((-1.0, -0.5, 0.25, 1.0, 3.0)) for _ in range(4)]) for i in range(150)]
    rows += [(i, 0, rows[0][2]) for i in range(150, 180)] + [(180, 0, [0.0] * 4), (181, 0, [1.0, 2.0]), (182, 1, None), (183, 0, [1.0, None, 1.0, 1.0]), (184, 0, [float("nan"), 1.0, 1.0, 1.0]), (185, 0, [1e200, 1.0, 0.0, 0.0]), (186, None, [1.0, 1.0, 1.0, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, workspace_id int, chunk_vector array<double>")
    queries = chunks.filter("chunk_id % 5 = 0 OR chunk_id > 179").toDF("query_id", "workspace_id", "query_vector")
    score = F.round(vx.cosine(F.col("query_vector"), F.col("chunk_vector")), rt.DECIMALS)
    said = lambda x, *more: sorted(map(str, x.select("query_id", "chunk_id", "similarity", "branch_rank", *more).collect()))
    cross = queries.drop("workspace_id").crossJoin(chunks).filter("query_id <> chunk_id").withColumn("similarity", score).filter("similarity IS NOT NULL")
    assert said(rt.nearest_blocks(queries, chunks, 3, block=20, part=9)) == said(rt.top_k(cross, [F.desc("similarity"), F.asc("chunk_id")], 3))
    home = queries.join(chunks, "workspace_id").withColumn("similarity", score).filter("similarity IS NOT NULL").withColumn("eligible", F.col("similarity") >= 0.5)
    home = home.withColumn("branch_rank", F.row_number().over(Window.partitionBy("query_id", "eligible").orderBy(F.desc("similarity"), "chunk_id"))).filter("branch_rank <= 3")
    assert said(rt.vector_sides(queries, chunks, 3, 0.5, ["workspace_id"]), "eligible") == said(home, "eligible")


def test_vector_rankings_compute_few_pairs(spark):
    """What tasks pass on to the ranking is near k a query and part, not all pairs, also among copies."""
    rng = random.Random(8)
    chunks = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(8)] if i % 2 else [1.0] * 8) for i in range(2000)], "chunk_id long, chunk_vector array<float>")
    queries = chunks.filter("chunk_id % 20 < 2").toDF("query_id", "query_vector")
    found = rt._candidates(4, ["chunk_id"], None, ["query_id", "chunk_id", "similarity"], True)(pa.Table.from_pandas(queries.toPandas()), pa.Table.from_pandas(chunks.toPandas()))
    assert found.num_rows <= 200 * (4 + 2)
