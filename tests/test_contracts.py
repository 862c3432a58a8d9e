"""Golden values of digests and identifiers, and the contracts against plain Python."""

import hashlib
import json
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from citeloom.functions import canonical as ca
from citeloom.functions import text as tx
from citeloom.functions import vectors as vx
from citeloom.operators import derivation as de
from citeloom.operators import evaluation as el
from citeloom.operators import lifecycle as li
from citeloom.operators import operations as op
from citeloom.operators import reports as rp
from citeloom.operators import traces as tr
from citeloom.operators import validation as va
from citeloom.sources import files


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_digests_are_over_the_bytes_of_the_format(spark):
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "")], "doc_id long, ordinal int, content string")
    found = {r["doc_id"]: r["digest"] for r in de.chunk_set_digests(chunks).collect()}
    assert found[1] == sha(b"0\0" + sha(b"a").encode() + b"\n1\0" + sha(b"b").encode() + b"\n")
    assert found[2] == sha(b"0\0" + sha(b"").encode() + b"\n")
    sets = spark.createDataFrame([("w", f"doc/{i:03}", f"s{i}", f"d{i}") for i in range(50)] + [("v", "k", "s", "d"), (None, "k", "s", "d")], "w string, source_key string, chunk_set_id string, digest string").repartition(7)
    found = {r["w"]: (r["n_documents"], r["digest"]) for r in de.population_digests(sets, "w").collect()}
    assert found["w"] == (50, sha(b"".join(f"doc/{i:03}\0s{i}\0d{i}\n".encode() for i in range(50))))
    assert found["v"] == found[None] == (1, sha(b"k\0s\0d\n"))
    assert de.population_digests(sets.filter("false"), "w").count() == 0
    assert de.ambiguous_members(sets.union(sets.filter("source_key = 'doc/007'")), "w").first()["source_key"] == "doc/007"


def test_canonical_forms(spark):
    value = {"b": [1, {"ü": "é", "a": None}], "a": {"z": 1.5, "y": "x\ny"}}
    row = spark.createDataFrame([(json.dumps(value, indent=2), "a name")], "j string, n string")
    one = row.select(ca.canonical_json(F.col("j")).alias("j"), ca.uuid5(F.col("n")).alias("u"), ca.canonical_object(b=F.lit(2), a=F.lit(None).cast("string"), c=F.lit("x")).alias("o"), ca.fingerprint(F.lit("a"), F.lit(None), F.lit(3)).alias("f"), ca.next_up(F.lit(1.5)).alias("x")).first()
    assert one["j"] == json.dumps(value, sort_keys=True, separators=(",", ":"))
    assert one["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "a name"))
    assert one["o"] == '{"a":null,"b":2,"c":"x"}' and one["f"] == "a\n\n3" and one["x"] == math.nextafter(1.5, math.inf)


def strings(value):
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [s for v in value.values() for s in strings(v)]
    return [s for v in value for s in strings(v)] if isinstance(value, list) else []


def test_json_strings(spark):
    values = [{"id-1": "id-2", "x": ["id-3", {"id-4": ["id-5", 1, None]}], "y": "a:b"}, ["id-1:", "q"], {}, {"a": {"b": {"c": "deep"}}}]
    rows = spark.createDataFrame([(i, json.dumps(v, indent=i)) for i, v in enumerate(values)], "i long, j string").select("i", ca.json_strings(F.col("j")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {i: strings(v) for i, v in enumerate(values)}


def test_json_strings_of_any_length_and_depth(spark):
    long, deep = "x\\n\u00e9\"" * 200_000, "end"
    texts = [json.dumps({"k": long}), "[" * 50_000 + json.dumps(deep) + "]" * 50_000, json.dumps({'a"b': 'c"d\\', "u": "\u2028\U0001f600"}), '{"a"  :\n"b" , "c":[ "d" ,"e:"]}', "3", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, j string").select("i", ca.json_strings(F.col("j")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {0: [long], 1: [deep], 2: ['c"d\\', "\u2028\U0001f600"], 3: ["b", "d", "e:"], 4: [], 5: None}


def test_differences_and_projections(spark):
    a = spark.createDataFrame([(1, "x", 2, "p"), (2, "y", 3, "p"), (3, "z", 1, "p")], "k long, m string, n int, id string")
    b = spark.createDataFrame([(1, "x", 2, "q"), (2, "y", 4, "q"), (4, "z", 1, "q")], "k long, m string, n int, id string")
    found = sorted((r["k"], r["field"]) for r in ca.differing_fields(a, b, "k", ["id"]).collect())
    assert found == [(2, "n"), (3, "m"), (3, "n"), (4, "m"), (4, "n")]
    report = spark.createDataFrame([((1.0, 2),)], "retrieval struct<latency_ms:double,recall:int>")
    assert ca.without(report, {"retrieval": ["latency_ms"]}).first()["retrieval"].asDict() == {"recall": 2}


def test_full_folding(spark):
    said = ["ABC", "Straße ﬁn", "ＡＢ", None, ""]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i long, s string").select("i", tx.full_fold(F.col("s")).alias("f"), tx.compose(F.concat(F.col("s"), F.lit("é"))).alias("c")).collect()
    found = {r["i"]: r for r in rows}
    assert [found[i]["f"] for i in range(5)] == ["abc", "strasse fin", "ab", None, ""]
    assert found[0]["c"] == "ABCé"


def test_exact_copies_and_deltas(spark):
    sets = lambda rows: spark.createDataFrame(rows, "id long, words array<string>, said string")
    found = el.overlap_pairs(sets([(1, ["a", "b"], "a b"), (2, ["a", "b", "c", "d", "e"], "a b c d e")]), sets([(7, ["a", "b"], "a b"), (8, ["b", "a"], "b a"), (9, ["a", "b", "c", "d", "x"], "a b c d x")])).collect()
    assert sorted((r["left_id"], r["right_id"], r["exact"]) for r in found) == [(1, 7, True), (1, 8, False), (1, 9, False), (2, 7, False), (2, 8, False), (2, 9, False)]
    third = [F.lit(x).cast("long") for x in (1, 3)]
    half = [F.lit(x).cast("long") for x in (1, 2)]
    one = spark.range(1).select(*[x.alias(n) for n, x in zip("pq", el.exact_delta(tuple(third), tuple(half)), strict=True)]).first()
    assert (one["p"], one["q"]) == (1, 6)


def test_verdicts(spark):
    rows = spark.createDataFrame([(1, "critical"), (1, "major"), (2, "major"), (2, "minor"), (3, "minor")], "k long, severity string")
    assert {r["k"]: r["verdict"] for r in el.review_verdict(rows, "k").collect()} == {1: "BLOCK", 2: "REQUEST_CHANGES", 3: "APPROVE"}


def test_dispositions(spark):
    rows = [("orphan", "succeeded", None, "deleted", "applied"), ("orphan", "succeeded", "deleted", "deleted", "replayed"), ("orphan", "succeeded", "deleted", "repaired", "ALREADY_BOUND"), ("orphan_report", "succeeded", "reported", "repaired", "applied"), ("orphan_report", "succeeded", None, "deleted", "RECORD_CANNOT_BE_DELETED"), ("orphan", "queued", None, "deleted", "NOT_COMPLETE"), ("chunk", "succeeded", None, "deleted", "NOT_ORPHAN_WORK"), ("orphan", "succeeded", None, "x", "UNSUPPORTED")]
    frame = spark.createDataFrame(rows, "a string, s string, b string, r string, want string")
    for r in frame.withColumn("got", li.orphan_disposition(*[F.col(c) for c in "asbr"])).collect():
        assert r["got"] == r["want"], r


def plain_alerts(samples, threshold, recovery, sustain):
    breach, firing, out = None, False, []
    for at, value in samples:
        if value is None or value <= recovery:
            breach, firing = None, False
        elif value >= threshold:
            breach = at if breach is None else breach
            firing = firing or at - breach >= sustain
        out.append((at, breach, firing))
    return out


@pytest.mark.parametrize("bucket", [7, 100, 86_400])
def test_alerts_over_buckets_equal_one_pass(spark, bucket):
    rng = random.Random(bucket)
    samples = {}
    for k in ("a", "b", None):
        at, rows = 0, []
        for _ in range(300):
            at += rng.randint(1, 9)
            rows.append((at, rng.choice([None, 10.0, 35.0, 45.0, 70.0, 70.0, 70.0])))
        samples[k] = rows
    frame = spark.createDataFrame([(k, at, v) for k, rows in samples.items() for at, v in rows], "k string, s long, value double").withColumn("at", F.timestamp_seconds("s").cast("timestamp_ntz")).repartition(5)
    found = op.alert_states(frame, 60.0, 30.0, 20, ["k"], bucket).select("k", "s", F.unix_seconds(F.col("breach_started").cast("timestamp")).alias("b"), "firing").collect()
    got = {(r["k"], r["s"]): (r["b"], r["firing"]) for r in found}
    assert len(found) == 900
    for k, rows in samples.items():
        for at, breach, firing in plain_alerts(rows, 60.0, 30.0, 20):
            assert got[k, at] == (breach, firing), (k, at)


def test_timing_and_embedding_contracts(spark):
    ticks = [F.lit(x) for x in (1.0, 1.5, 2.0, 2.25, 3.0)]
    row = spark.range(1).select(tr.phase_timings(ticks, 0.01).alias("t"))
    assert va.violations(row, F.lit("x"), tr.timing_rules(F.col("t"), F.lit(750.0))).count() == 0
    assert [r["rule"] for r in va.violations(row, F.lit("x"), tr.timing_rules(F.col("t"), F.lit(751.0))).collect()] == ["retrieval latency"]
    assert [r["name"] for r in row.select(F.explode("t.phases").alias("p")).select("p.*").collect()] == list(tr.PHASES)
    v = spark.range(1).select(F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("v"))
    rules = tr.query_embedding_rules(F.col("v"), F.lit("p"), F.lit("m"), 3, ("p", "n"))
    assert sorted(r["rule"] for r in va.violations(v, F.lit("x"), rules).collect()) == ["configuration", "dimensions"]


def test_guardrails_need_something_to_hold(spark):
    kind = "status string, decision string, structural_validity boolean, citation_correctness boolean, refusal_correctness boolean, retrieval_latency_ms double, end_to_end_latency_ms double"
    none = rp.guardrails(spark.createDataFrame([], kind)).first()
    assert not none["structural_validity"] and not none["citation_correctness"] and not none["refusal_correctness"]
    good = spark.createDataFrame([("observed", "ANSWER", True, True, None, 1.0, 1.0)], kind)
    assert all(rp.guardrails(good).first()[c] for c in ("structural_validity", "citation_correctness", "refusal_correctness"))
    refused = spark.createDataFrame([("observed", "REFUSAL", True, None, None, 1.0, 1.0)], kind)
    assert not rp.guardrails(refused).first()["refusal_correctness"] and not rp.guardrails(refused).first()["citation_correctness"]


def test_cutover_and_ranks(spark):
    kind = "source_key string, before_digest string, after_digest string, complete boolean, vectors_new boolean, v1_immutable boolean"
    rows = [("a", "d", "d", True, True, True), ("b", "d", "e", False, False, True), ("a", "d", "d", True, True, True)]
    gaps = sorted((r["source_key"], r["gap"]) for r in de.cutover_gaps(spark.createDataFrame(rows, kind)).collect())
    assert gaps == [("a", "DUPLICATE_MEMBER"), ("b", "CHUNK_SET_CHANGED"), ("b", "PENDING"), ("b", "V2_VECTOR_NOT_NEW")]
    assert de.cutover(spark.createDataFrame(rows[:1], kind)).first()["allowed"] and not de.cutover(spark.createDataFrame([], kind)).first()["allowed"]
    ranks = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1), (3, 1)], "q long, r int")
    assert sorted(r["subject"] for r in va.out_of_order(ranks, "q", "r", "x").collect()) == ["2", "3"]


def test_manifests_datasets_and_publications(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": "v", "files": [{"path": "a/b.txt", "sha256": sha(b"hi")}]}, indent=1))
    rows = files.manifest(spark, str(tmp_path / "m.json"), "version string, files array<struct<path:string,sha256:string>>").select(F.explode("files").alias("f")).select("f.*")
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "b.txt").write_bytes(b"hi")
    (tmp_path / "o" / "c.txt").write_bytes(b"ho")
    stored = files.objects(spark, str(tmp_path / "o"))
    assert files.checksum_breaches(rows, stored).count() == 0
    lines = sorted([f"{sha(b'hi')}  b.txt", f"{sha(b'ho')}  c.txt"])
    one = files.publication(stored).first()
    assert (one["n_objects"], one["bytes"], one["digest"]) == (2, 4, sha("\n".join(lines).encode()))
    case = {"id": "c1", "category": "x", "workspace_id": "w", "question": "q?", "expected_behavior": "ANSWER", "retrieval_relevance": {"applicable": True, "acceptable_relevant_chunks": ["a#0"]}, "answer_expectations": {"required_facts": ["f"], "reference_answer": None}, "evidence_expectations": {"expected_source_documents": ["a"], "acceptable_cited_chunks": ["a#0"]}, "refusal_expectation": None}
    broken = case | {"id": "c2", "expected_behavior": "REFUSAL"}
    (tmp_path / "cases.jsonl").write_text("\n".join(json.dumps(c) for c in (case, broken, case)))
    read = files.cases(spark, str(tmp_path / "cases.jsonl"))
    found = sorted((r["subject"], r["rule"]) for r in va.case_breaches(read).collect())
    assert found == [("c1", "case once"), ("c2", "refusal")]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        (tmp_path / "bad.jsonl").write_text("{")
        files.cases(spark, str(tmp_path / "bad.jsonl")).collect()


def test_strict_cosine(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert frame.select(vx.strict_cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(math.sqrt(0.5))
    for a, b in (([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])):
        with pytest.raises(Exception, match="direction|length"):
            spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(vx.strict_cosine(F.col("a"), F.col("b"))).collect()


def test_full_jitter_stays_within_its_window(spark):
    rows = spark.range(500).select((F.col("id") % 4 + 1).alias("n"), (F.col("id") / 500).alias("u"))
    decision, _, delay = op.retry_decision(F.lit("lease_expired"), F.col("n"), jitter=F.col("u"))
    most = {1: 5_000_000, 2: 30_000_000, 3: 120_000_000}
    found = rows.select("n", decision.alias("d"), delay.alias("us")).collect()
    assert all(0 <= r["us"] <= most[r["n"]] for r in found if r["n"] < 4) and all(r["us"] is None and r["d"] == "retry_exhausted" for r in found if r["n"] == 4)
    assert len({r["us"] for r in found}) > 300


def test_sealed_totals(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_bytes(name.encode() * 3)
    stored = files.objects(spark, str(tmp_path))
    entries = spark.createDataFrame([("x/a", sha(b"aaa")), ("x/b", sha(b"bbb"))], "path string, sha256 string")
    assert files.sealed_totals(entries, stored, 2, 6).first()["sealed"] and not files.sealed_totals(entries, stored, 2, 7).first()["sealed"]
    assert files.sealed_totals(entries.union(entries.limit(1).selectExpr("'x/c' AS path", "sha256")), stored, 3, 6).first()["matches"] == 2
