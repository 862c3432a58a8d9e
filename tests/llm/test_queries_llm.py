"""The registered queries themselves on the smallest tables: columns, digests and hex forms, against plain Python."""

import hashlib
import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp
from citeloom.llm import lang_id as la
from citeloom.llm import pii
from citeloom.llm import quality as ql
from citeloom.llm.registry import QUERIES

from .test_ops_model import edit_distance_within, plain_base_spans
from .test_ops_text import lines_of_any_earlier, plain_fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def rows_of(spark, name, key="doc_id"):
    made = QUERIES[name](spark, SF).collect()
    return {r[key]: r for r in made}, len(made)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, documents, monkeypatch):
    small = pii.Tagger()
    small.fit(*pii.labelled_windows(600), epochs=3)
    monkeypatch.setattr(pii, "trained", lambda *a, **k: small)
    found, n = rows_of(spark, "op1_pii")
    assert n == len(documents)
    for i, d in documents.items():
        want = sorted(plain_base_spans(d["text"] or ""), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        said = [f"{k}:{s}:{e}" for k, s, e in want]
        assert found[i]["base_sha256"] == sha(",".join(said))
        assert set(said) <= set(found[i]["spans"].split(",")) | {""}
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]


def test_op2(spark, documents):
    found, n = rows_of(spark, "op2_line_dedup")
    assert n == len(documents)
    _, common = lines_of_any_earlier([(i, d["text"]) for i, d in documents.items()])
    for (i, t), gone in common.items():
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert (found[i]["n_lines"], found[i]["n_removed"], found[i]["kept_sha256"]) == (t.count("\n") + 1, len(gone), sha(left))


def test_op4(spark, documents):
    import zlib

    found, n = rows_of(spark, "op4_lang_id")
    assert n == len(documents)
    right = []
    for i, d in documents.items():
        held = zlib.crc32(str(i).encode()) % 3 == 1
        assert found[i]["held_out"] == held and 0 <= found[i]["score"] <= 1
        assert (found[i]["lang_pred"] == "und") == (not d["text"] or not re.search(r"[^\W\d_]", d["text"]))
        if held and d["lang"]:
            right.append(found[i]["lang_pred"] == d["lang"])
    print("held out", np.mean(right), len(right))
    assert np.mean(right) > 0.95


def test_equal_languages_go_to_the_first_by_name(spark):
    even = la.Model(["aa", "bb", "cc"], np.zeros((la.BUCKETS, 3), np.float32), np.zeros(3))
    frame = spark.createDataFrame([(1, "some words", "x", 2.0)], "doc_id long, text string, lang_pred string, score double")
    one = la.predict(frame, even).first()
    assert one["lang_pred"] == "aa" and one["score"] == pytest.approx(1 / 3)


def test_op6(spark, documents):
    found, n = rows_of(spark, "op6_simhash")
    assert n == len(documents)
    fps = {i: plain_fingerprint(d["text"]) for i, d in documents.items()}
    group = {f: f for f in fps.values()}
    find = lambda x: x if group[x] == x else find(group[x])
    for x in group:
        for y in group:
            if (x ^ y).bit_count() <= 4:
                group[find(x)] = find(y)
    low = {}
    for i, f in fps.items():
        low[find(f)] = min(low.get(find(f), i), i)
    for i, f in fps.items():
        assert (found[i]["fingerprint"], found[i]["component_id"]) == (f"{f:016x}", low[find(f)])


def shrunken(groups, prior_of, spread):
    """Prior strength and posterior means of (key: sum, count) by moments, in plain Python."""
    n, nn = sum(c for _, c in groups.values()), sum(c * c for _, c in groups.values())
    ss = sum(c * (s / c - prior_of(k)) ** 2 for k, (s, c) in groups.items())
    between = (ss - len(groups) * spread) / (n - nn / n) if n * n > nn else None
    k = 10.0 if between is None else min(max(spread / between if between > 0 else 1e4, 1.0), 1e4)
    return {g: (k * prior_of(g) + s) / (k + c) for g, (s, c) in groups.items()}


def test_op7(spark, documents):
    """The posteriors against a second computation from the evidence; the evidence against the labels."""
    found, n = rows_of(spark, "op7_quality")
    assert n == len(documents)
    p = {i: found[i]["evidence"] for i in documents}
    assert all((p[i] is None) == (not (d["text"] or "").split()) for i, d in documents.items())
    some = {i: x for i, x in p.items() if x is not None}
    mean = sum(some.values()) / len(some)
    spread = max(sum(x * x for x in some.values()) / len(some) - mean**2, 1e-6)
    paths, hosts = {}, {}
    for i, x in some.items():
        d = documents[i]
        for held, k in ((paths, (d["source"], d["lang"])), (hosts, d["source"])):
            s, c = held.get(k, (0.0, 0))
            held[k] = (s + x, c + 1)
    host_mean = shrunken(hosts, lambda k: mean, spread)
    path_mean = shrunken(paths, lambda k: host_mean[k[0]], spread)
    odds = lambda q: np.log(min(max(q, 1e-6), 1 - 1e-6) / (1 - min(max(q, 1e-6), 1 - 1e-6)))
    for i, d in documents.items():
        site = path_mean.get((d["source"], d["lang"]), mean)
        assert found[i]["site_mean"] == pytest.approx(site, rel=1e-9)
        if p[i] is None:
            assert found[i]["quality"] is None and not found[i]["keep"]
        else:
            q = 1 / (1 + np.exp(-(odds(p[i]) + odds(site) - odds(mean))))
            assert found[i]["quality"] == pytest.approx(q, rel=1e-9) and found[i]["keep"] == (q >= 0.5)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    right = [(p[i] >= 0.5) == (labels[i] == 1) for i in labels if p.get(i) is not None]
    assert np.mean(right) > 0.9


def test_null_and_empty_languages_are_sites_of_their_own(spark):
    rows = [(i, "word " * (5 + i % 3), lang, "s") for i, lang in enumerate([None, "", "de"] * 20)]
    frame = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, __p int, __host int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int")
    done = ql.judge(frame, labels)
    assert done.columns == ["doc_id", "text", "lang", "source", "__host", "__p", "__site", "__quality", "__keep"] and done.count() == 60
    sites = {r["lang"]: round(r["__site"], 12) for r in done.collect()}
    assert len(set(sites.values())) == 3
    assert ql.keep_good(frame, labels).columns == frame.columns


def leaks_of(text, items):
    words = lambda t: re.sub(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]", b" ", t.lower().encode()).split()
    w = words(text or "")
    out = set()
    for i, t in items.items():
        item = words(t or "")
        k = len(item) // 5 if len(item) >= 8 else 0
        if len(item) >= 3 and w and edit_distance_within(item, w) <= k:
            out.add(i)
    return out


def test_op10(spark, documents):
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    short = {i: d for i, d in documents.items() if len(d["text"] or "") < 4000}
    found = QUERIES["op10_decontaminate"](spark, SF).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found if r["doc_id"] in short}
    want = {(i, x) for i, d in short.items() for x in leaks_of(d["text"], items)}
    assert got == want and want
    assert all(r["start"] < r["end"] for r in found)


def test_pipeline_by_stages(spark, documents):
    """Each stage of `run` against its plain form, on the documents that the stages before it left."""
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    held = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = held.columns, {}
    for name, stage in cp.STAGES[:-1]:
        held = cp.materialize(stage(spark, held, SF), "test-stage")
        assert held.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in held.collect()}
    quality = QUERIES["op7_quality"](spark, SF).filter("keep").select("doc_id").collect()
    assert kept["quality classifier"].keys() == {r[0] for r in quality}
    _, common = lines_of_any_earlier(list(kept["quality classifier"].items()))
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t for (i, t), gone in common.items()}
    assert kept["line dedup"] == {i: t for i, t in left.items() if not common[i, kept["quality classifier"][i]] or t.strip(" ")}
    fps = {i: plain_fingerprint(t) for i, t in kept["line dedup"].items()}
    ids = sorted(fps)
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    assert kept["simhash near-dedup"].keys() == {find(i) for i in ids}
    for i, t in kept["simhash near-dedup"].items():
        if len(t) < 4000:
            assert (i in kept["benchmark decontamination"]) == (not leaks_of(t, items))
    done = cp.run(spark, SF).collect()
    assert {r["doc_id"] for r in done} == kept["benchmark decontamination"].keys()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in kept["benchmark decontamination"].items()}
    assert all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in done)
    by = {}
    for r in done:
        by.setdefault(r["source"], []).append(r)
    assert all(abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 1 for rs in by.values())


def test_stages_of_empty_tables(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_no_python_on_the_native_paths(spark):
    for name in ("op3_mix_sources", "op9_chat_formatting"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("ArrowEvalPython|MapInArrow|MapInPandas|FlatMapGroups|BatchEvalPython", plan)
