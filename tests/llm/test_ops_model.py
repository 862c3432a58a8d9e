"""Personal data, language, quality, neighbours, decontamination and the pipeline: brute force, accuracy and edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import ann_search as nn
from citeloom.llm import decontaminate as dc
from citeloom.llm import lang_id as la
from citeloom.llm import pii
from citeloom.llm import quality as ql

DOCS = "doc_id long, text string, lang string, source string, host string, path string, spans string, h string"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS).repartition(3)


# --- personal data ------------------------------------------------------------------------------------------------


def plain_base_spans(text):
    """The contract's patterns as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(0)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "@", "a@@b.c", "a@b", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "0000.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0100", "+49.30.1234567", "+1", "é", "\U0001f600", " ", "-", ".", "12", "\n", "ab"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(text) == plain_base_spans(text), text
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


@pytest.fixture(scope="module")
def tagger():
    made = pii.Tagger()
    made.fit(*pii.labelled_windows(2500), epochs=6)
    return made


def test_gradients():
    small = pii.Tagger(hidden=4, seed=3)
    small.p = {n: a.astype(np.float64) for n, a in small.p.items()}
    ids, tags = pii.labelled_windows(3, seed=8)
    ids, tags = ids[:, :12], tags[:, :12]
    for row in tags:  # an I that the cut left without its B
        for i, t in enumerate(row):
            if t and t % 2 == 0 and (i == 0 or row[i - 1] not in (t, t - 1)):
                row[i] = t - 1
    _, grads = small.loss_and_grads(ids, tags)
    for name in ("uf", "xb", "o", "t", "cb"):
        flat = np.abs(grads[name]).argmax()
        at = np.unravel_index(flat, grads[name].shape)
        old, eps = small.p[name][at], 1e-3
        small.p[name][at] = old + eps
        up = small.loss_and_grads(ids, tags)[0]
        small.p[name][at] = old - eps
        down = small.loss_and_grads(ids, tags)[0]
        small.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-4)


def test_tagger_learns(tagger):
    ids, tags = pii.labelled_windows(200, seed=77)
    best = tagger.viterbi(tagger.emissions(ids), np.full(len(ids), pii.WINDOW))
    assert (best == tags).mean() > 0.9


def test_model_only_adds(spark, tagger):
    rows = [(1, "mail jo@mail.org or +1 (555) 555-0100 now", None, None), (2, None, None, None), (3, "", None, None), (4, "no clue here", None, None), (5, "word " * 30000 + "card 4111 1111 1111 1111 end", None, None), (1, "mail jo@mail.org", None, None), (None, "1.2.3.4", None, None)]
    found = pii.detect(docs(spark, rows), tagger).collect()
    assert len(found) == len(rows)
    text = {r[1]: r[1] for r in rows}
    by = {r[0]: r[1] for r in rows}
    for r in found:
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        if r["doc_id"] not in (1,):
            assert base == plain_base_spans(by[r["doc_id"]] or "")
        spans = [(pii.KINDS.index(s["kind"]), s["start"]) for s in r["spans"]]
        assert spans == sorted(spans)
    assert text and pii.detect(docs(spark, []), tagger).count() == 0


def spelled_documents(n, seed):
    """Texts of `documents` with an unseen spelling put between two of their words: (text, kind, start, end)."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() if t and 20 < len(t) < 3000 and not re.search("[0-9@]", t)]
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        item, kind = pii.labelled_item(rng)
        if kind and pii.sensible(kind, item):
            words = texts[int(rng.integers(0, len(texts)))].split(" ")
            at = int(rng.integers(0, len(words) + 1))
            head = " ".join(words[:at]) + " " if at else ""
            out.append((head + item + " " + " ".join(words[at:]), kind, len(head), len(head) + len(item)))
    return out


def test_held_out_spellings_in_documents(tagger):
    made = spelled_documents(400, 2026)
    found = pii.find_spans([t.encode() for t, *_ in made], tagger)
    base = np.mean([(k, s, e) in b for (_, k, s, e), (b, _) in zip(made, found, strict=True)])
    both = np.mean([(k, s, e) in a for (_, k, s, e), (_, a) in zip(made, found, strict=True)])
    precision = np.mean([x == (k, s, e) for (_, k, s, e), (_, a) in zip(made, found, strict=True) for x in a])
    print("base", base, "with the model", both, "precision", precision)
    assert both > base + 0.15 and both > 0.75 and precision > 0.85


def test_no_sensible_span_lies_outside_the_stretches():
    """Whatever kind of span makes sense, the stretches read hold it whole: nothing is lost by reading only those."""
    for text, _, s, e in spelled_documents(600, 7):
        assert any(a <= s and e <= b for a, b in pii.stretches(text))
        assert text.encode().translate(None, pii.OTHERS) or pii.SPELLED.search(text.encode())


def test_windows_are_reconciled(tagger):
    text = "call (743) 555-3824 or 4111.1111.1111.1111 " * 12
    ids = pii.char_ids(text)
    whole = pii.tag_stretches([ids], tagger)[0]
    assert len(whole) == len(text)
    for i in range(1, len(whole)):  # an I follows its own kind
        if whole[i] and whole[i] % 2 == 0:
            assert whole[i - 1] in (whole[i], whole[i] - 1)


# --- language -----------------------------------------------------------------------------------------------------


def speech(rng, lang, n):
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ein", "ung", "ber"], "zz": ["çon", "eau", "ré", "ique"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, speech(rng, lang, rng.randint(5, 60)), lang, None) for i, lang in enumerate(rng.choices(["xx", "yy", "zz"], [8, 2, 1], k=500))]
    rows += [(900, None, "xx", None), (901, "", "xx", None), (902, "12 34 !", "xx", None), (903, speech(rng, "yy", 40000), None, None), (None, speech(rng, "zz", 9), "zz", None), (0, rows[0][1], "xx", None)]
    frame = docs(spark, rows)
    model = la.train(la.sample(frame))
    found = {}
    for r in la.predict(frame, model, ("doc_id", "lang")).collect():
        assert 0 <= r["score"] <= 1
        found[r["doc_id"]] = r
    assert found[900]["lang_pred"] == found[901]["lang_pred"] == found[902]["lang_pred"] == "und"
    assert found[903]["lang_pred"] == "yy"
    held = [r["doc_id"] for r in frame.filter(la.held_out(F.col("doc_id"))).select("doc_id").collect()]
    right = [found[i]["lang_pred"] == found[i]["lang"] for i in held if i < 500]
    assert len(right) > 100 and np.mean(right) > 0.97
    assert la.train([]) is None and la.predict(frame, None).filter("lang_pred <> 'und'").count() == 0


def test_long_texts_teach_whole(spark):
    """A language that only texts of over 100,000 characters hold, in words that stand at their ends, is learned."""
    rng = random.Random(4)
    rows = [(i, speech(rng, "xx", 30), "xx", None) for i in range(120)] + [(500 + i, "12 " * 40_000 + speech(rng, "zz", 60), "zz", None) for i in range(60)]
    frame = docs(spark, rows)
    taught = la.sample(frame)
    assert {x for x, _ in taught} == {"xx", "zz"} and all(c.shape[0] == 2 and c.shape[1] <= la.BUCKETS for _, c in taught)
    model = la.train(taught)
    asked = docs(spark, [(i, speech(rng, "zz" if i % 2 else "xx", 20), None, None) for i in range(60)])
    assert all(r["lang_pred"] == ("zz" if r["doc_id"] % 2 else "xx") for r in la.predict(asked, model).collect())


# --- quality ------------------------------------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "of", "word", "tall", "river", "sand"]) + rng.choice(["", ",", "."]) for _ in range(rng.randint(20, 90)))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "$$$", "|||"]) + "!!" for _ in range(rng.randint(20, 90)))
    rows = [(i, good() if i % 3 else bad(), "en", f"s{i % 4}") for i in range(300)]
    rows += [(900, None, "en", "s0"), (901, "  ", None, None), (902, good(), None, None), (1, rows[1][1], "en", "s1"), (None, good() * 200, "en", "new")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(4, 1), (None, 1), (5000, None)], "doc_id long, quality int")
    frame = docs(spark, rows)
    done = ql.judge(frame, labels)
    assert done.columns[: len(frame.columns)] == frame.columns and done.count() == len(rows)
    keep = {r["doc_id"]: r["__keep"] for r in done.collect()}
    assert np.mean([keep[i] == (i % 3 > 0) for i in range(300)]) > 0.98
    assert not keep[900] and not keep[901] and keep[902] and keep[None]
    assert ql.keep_good(frame.filter("false"), labels).count() == 0
    even = ql.judge(frame, labels.filter("false")).filter("__p IS NOT NULL").select("__p").distinct().collect()
    assert [r[0] for r in even] == [0.5]


def test_sparse_sites_shrink(spark):
    rows = [("big", "big/a", 0.9)] * 200 + [("big", "big/b", 0.2)] * 3 + [("small", "small/a", 0.1)] * 2 + [("other", "other/a", 0.4)] * 100
    sites, mean = ql.site_posteriors(spark.createDataFrame(rows, "host string, path string, __p double"))
    at = {r["path"]: r["path_mean"] for r in sites.collect()}
    assert abs(at["big/a"] - 0.9) < 0.05 and 0.2 < at["big/b"] < 0.9 and 0.1 < at["small/a"] < mean


# --- neighbours ---------------------------------------------------------------------------------------------------


def plain_nearest(rows, query, k=10):
    out = {}
    for i, x in rows:
        if query(i):
            near = {}
            for j, y in rows:
                if j != i:
                    s = float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum()))
                    near[j] = min(near.get(j, np.inf), s)
            out[i] = sorted((s, j) for j, s in near.items())[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    good = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(700)]
    good += [(700 + i, good[100][1]) for i in range(30)]  # ties
    odd = [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0, None] + [0.0] * 14), (2400, [1.0] * 3), (None, good[0][1]), (2500, [float("inf")] * 16)]
    frame = spark.createDataFrame([(*r, "x") for r in good + odd], "vec_id long, embedding array<double>, code string").repartition(4)
    found = {}
    for r in nn.nearest(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = plain_nearest(good, lambda i: i % 100 == 0)
    assert found.keys() == want.keys() and all(len(found[q]) == 10 for q in want)
    hits = np.mean([len({j for _, j in found[q]} & {j for _, j in want[q]}) / 10 for q in want])
    assert hits >= 0.95
    for q, near in found.items():
        true = dict((j, s) for s, j in plain_nearest(good, lambda i, q=q: i == q, 10**6)[q])
        assert near == sorted(near) and all(abs(true[j] - s) < 1e-12 for s, j in near)
    assert [j for _, j in found[100]][:10] == [700 + i for i in range(10)]


def test_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in nn.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()] == [2, 1]
    assert nn.nearest(frame.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    assert nn.nearest(frame.filter("false"), F.col("vec_id") == 0).count() == 0


def test_vectors_of_every_length_are_searched(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3 + i % 3).tolist()) for i in range(90)] + [(300, [1.0] * 7), (301, [2.0] * 7), (302, [1.0] * 9), (301, [0.5] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found, hits = {}, []
    for r in nn.nearest(frame, F.col("vec_id") % 3 == 0, 4).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    for q in [i for i in range(0, 90, 3)] + [300]:
        near = {}
        for x in [v for i, v in rows if i == q]:
            for j, y in rows:
                if j != q and len(x) == len(y):
                    near[j] = min(near.get(j, np.inf), float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())))
        want = sorted((s, j) for j, s in near.items())[:4]
        scores = dict((j, s) for s, j in ((s, j) for j, s in near.items()))
        assert len(found[q]) == len(want) and found[q] == sorted(found[q]) and all(abs(scores[j] - s) < 1e-12 for s, j in found[q])
        hits += [len({j for _, j in found[q]} & {j for _, j in want}) / len(want)]
    assert set(found) == {*range(0, 90, 3), 300} and np.mean(hits) >= 0.95


@pytest.mark.parametrize("first_bits", [0, 3])
def test_tables_find_all_within_the_radius(spark, first_bits):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 32, (200, nn.TABLES), np.uint64).astype(np.uint32)
    near = np.repeat(codes[:40], 3, axis=0)
    for row in near:
        for b in rng.choice(256, rng.integers(0, 26), replace=False):
            row[b // 32] ^= np.uint32(1 << (b % 32))
    codes = np.unique(np.concatenate([codes, near]), axis=0)
    frame = spark.createDataFrame([(i, bytearray(c.tobytes())) for i, c in enumerate(codes)], "query_id long, code binary")
    number = {c.tobytes(): i for i, c in enumerate(codes)}
    d = np.bitwise_count(codes[:, None] ^ codes[None, :]).sum(axis=2)
    for reach, salts in ((0, 1), (2, 3)):
        rows = nn.fetched(nn.tables(frame, first_bits), frame.filter("query_id < 50"), first_bits, reach, salts).collect()
        got = [(r["query_id"], number[bytes(r["code"])]) for r in rows]
        want = {(q, c) for q, c in zip(*map(np.ndarray.tolist, np.nonzero(d < nn.TABLES * (reach + 1))), strict=True) if q < 50}
        assert set(got) == want and len(got) == len(want)  # each pair once, by its first substring
        assert all(r["d"] == d[r["query_id"], number[bytes(r["code"])]] for r in rows)


def test_buckets_are_probed_by_value(spark):
    """Clustered codes meet few buckets: the share of pairs that a substring lets through is small."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 32, (3000, nn.TABLES), np.uint64).astype(np.uint32)
    looked = sum((np.bitwise_count(codes[:, j][None, :] ^ codes[:30, j][:, None]) <= 4).sum() for j in range(nn.TABLES))
    assert looked / (30 * 3000 * nn.TABLES) < 0.001
    q, c, d = nn.probe(codes, codes[:30], 0, 4)
    assert set(zip(q.tolist(), c.tolist(), strict=True)) >= {(i, i) for i in range(30)} and len(q) < 100


def test_recall_on_the_embeddings(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    x, ids = np.array(table["embedding"].to_pylist(), np.float64), np.array(table["vec_id"])
    found = {}
    for r in nn.op5_ann_search(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    want = plain_nearest(list(zip(ids.tolist(), x.tolist(), strict=True)), lambda i: i % 100 == 0)
    assert found.keys() == want.keys()
    recall = np.mean([len({j for _, j in want[q]} & set(found[q])) / 10 for q in want])
    print("recall", recall)
    assert recall >= 0.9


# --- decontamination ----------------------------------------------------------------------------------------------


def edit_distance_within(item, words):
    """Least edit distance of the item to any stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(150)] + ["the", "of"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(rng.randint(10, 40)) for _ in range(25)]
    rows = []
    for i in range(160):
        words = text(rng.randint(0, 60))
        if i % 2:
            item = rng.choice(items)
            part = dc.edited(np.arange(len(item), dtype=np.uint64), rng.randint(0, len(item) // 4), np.random.default_rng(i)).tolist()
            words += [item[p] if p < len(item) else "new" for p in part] + text(rng.randint(0, 20))
        rows.append((i, rng.choice([" ", ", ", " | ", "!! "]).join(w.upper() if i % 3 else w for w in words), None, None))
    rows += [(900, None, None, None), (901, "", None, None), (902, " ".join(text(30000) + items[0]), None, None), (1, rows[1][1], None, None), (None, " ".join(items[1]), None, None)]
    bench = spark.createDataFrame([(i, " ".join(t).title(), "x") for i, t in enumerate(items)] + [(90, None, "x"), (91, "two words", "x"), (92, "", "x")], "item_id long, text string, start string")
    found = dc.leaks(docs(spark, rows), bench)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    want = set()
    for i, t, *_ in rows:
        if t and len(t) < 5000:
            words = re.findall(r"\w+", t.lower())
            want |= {(i, j) for j, item in enumerate(items) if edit_distance_within(item, words) <= len(item) // 5}
    want.add((902, 0))
    assert got <= want and len(got & want) >= 0.98 * len(want) and len(want) > 50
    for r in found.collect():
        assert r["distance"] <= len(items[r["item_id"]]) // 5 and r["end"] > r["start"]
    clean = dc.drop_leaked(docs(spark, rows), bench)
    leaked = {i for i, _ in got}
    assert None in leaked
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(i) for i, *_ in rows if i not in leaked)
    shared = docs(spark, [(7, " ".join(items[3]), None, None), (7, "clean words only", None, None), (None, "clean as well", None, None)])
    assert sorted(r["text"] for r in dc.drop_leaked(shared, bench).collect()) == ["clean as well", "clean words only"]
    assert dc.leaks(docs(spark, []), bench).count() == 0 and dc.leaks(docs(spark, rows), bench.filter("false")).count() == 0
    assert dc.leaks(docs(spark, rows), bench, block_items=7).count() == found.count()


def test_leaks_with_edits_gathered_anywhere(monkeypatch):
    rng = random.Random(8)
    items = [[f"v{rng.randrange(4000)}" for _ in range(n)] for n in (8, 10, 15, 23, 31, 40, 52, 59, 75, 100) * 4]
    pad = lambda n: [f"p{rng.randrange(900)}" for _ in range(n)]
    texts, want = [], set()
    for x, item in enumerate(items):
        k = len(item) // 5
        for at in (0, (len(item) - k) // 2, len(item) - k):
            for put in ([], pad(k)):
                want.add((len(texts), x))
                texts.append((" ".join(pad(20) + item[:at] + put + item[at + k :] + pad(20))).encode())
    block = dc.Block([(i, " ".join(t).encode()) for i, t in enumerate(items)])
    found = dc.find_leaks(texts, block)
    assert {(d, x) for d, x, *_ in found} == want
    # copies next to each other are a row each, however the work is split
    twice = [" ".join(items[4] + items[4] + ["so"] + items[5] + items[4]).encode(), b"", " ".join(items[5]).encode()]
    n, m = len(items[4]), len(items[5])
    places = [(0, 4, 0, 0, n), (0, 4, 0, n, 2 * n), (0, 4, 0, 2 * n + 1 + m, 3 * n + 1 + m), (0, 5, 0, 2 * n + 1, 2 * n + 1 + m), (2, 5, 0, 0, m)]
    assert sorted(dc.find_leaks(twice, block)) == places
    monkeypatch.setattr(dc, "PAIRS", 7)
    assert sorted(dc.find_leaks(twice, block)) == places and sorted(dc.find_leaks(texts, block)) == sorted(found)


def test_no_leak_is_lost_beside_a_short_item():
    rng = random.Random(9)
    items = [[f"v{rng.randrange(4000)}" for _ in range(rng.randint(15, 59))] for _ in range(60)]
    block = dc.Block([(i, " ".join(t).encode()) for i, t in enumerate(items)] + [(99, b"three word item")])
    texts = []
    for n in range(10 * len(items)):
        item = items[n % len(items)]
        part = dc.edited(np.arange(len(item), dtype=np.uint64), len(item) // 5, np.random.default_rng(n)).tolist()
        texts.append(" ".join(["so"] * 9 + [item[p] if p < len(item) else "new" for p in part] + ["on"] * 9).encode())
    assert {(d, x) for d, x, *_ in dc.find_leaks(texts, block)} == {(n, n % len(items)) for n in range(len(texts))}


# --- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs0 = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5 and names[-1] == "mixing sources"
    held = docs0
    for name, stage in cp.STAGES:
        after = cp.materialize(stage(spark, held, SF), "test-stage")
        assert after.count() <= held.count()
        if name != names[-1]:
            assert after.columns == docs0.columns
            assert after.join(docs0, "doc_id", "left_anti").count() == 0
        held = after
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = spark.read.parquet(f"{SF}/documents.parquet").join(held, "doc_id", "left_semi").collect()
    assert not any(t in r["text"] for r in left for t in items)
    assert held.count() > 100 and held.filter("taken > 2 * size").count() == 0
