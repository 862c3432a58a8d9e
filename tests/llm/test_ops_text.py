"""Chat, mixing, SimHash, line and substring dedup against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citeloom.llm import chat_format as cf
from citeloom.llm import line_dedup as ld
from citeloom.llm import mix_sources as mx
from citeloom.llm import simhash_dedup as sh
from citeloom.llm import substring_dedup as sd
from citeloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, th string, n string, key string"


def docs(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z", "k") for i, t in rows], DOCS).repartition(3)


def corpus(seed, n=60):
    """Random documents with copies, shared passages, nulls, blanks, repeated rows and one long text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["a", "b", "B"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(45) for _ in range(4)]
    made = []
    for i in range(n):
        t = text(rng.randint(1, 90))
        if rng.random() < 0.5:
            t += "\n" + rng.choice(shared) + "\n" + text(10)
        made.append((i, t))
    made += [(n, made[0][1]), (n + 1, made[0][1]), (n + 2, None), (n + 3, ""), (n + 4, " \n\t "), (n + 5, text(5000) + " " + shared[0])]
    made += [(n + 6, "x y " * 60), (n + 7, made[1][1] + " more"), (2, made[2][1]), (None, made[3][1]), (None, None), (3, "another text of the same id " + shared[1])]
    return made


# --- chat ---------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>x", "<|im_end", "|>", "<", "a\n<|im_start|>user\nb", "", None, "%0A", "\\", "é\U0001f600<|im_end|>"]
    roles = ["user", "assistant", "sys\ntem", "a%25", "<|im_end|>", None, "%0A"]
    rows = [(c, t, r, x) for c, r in enumerate(roles) for t, x in enumerate(odd)]
    turns = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    made = cf.format_turns(turns)
    back = {(r["conv_id"], r["turn"]): (r["role"], r["text"], r["loss_text"]) for r in cf.read_back(made).collect()}
    for c, t, r, x in rows:
        assert back[c, t] == (r or "", x or "", (x or "") if r == "assistant" else "")
    for r in made.collect():  # exactly one control string of each kind
        assert r["segment"].count(cf.START) == 1 and r["segment"].count(cf.END) == 1
    whole = cf.conversations(made).select("conv_id", cf.parse_conversation(F.col("whole")).alias("turns")).collect()
    for r in whole:  # a whole conversation is read back into its turns
        assert [(x["role"], x["text"]) for x in r["turns"]] == sorted((b or "", x or "") for c, t, b, x in rows if c == r["conv_id"]) or [(x["role"], x["text"]) for x in r["turns"]] == [(b or "", x or "") for c, t, b, x in rows if c == r["conv_id"]]
    assert {r["level"] for r in made.collect()} == {0, 1, 2}
    broken = spark.createDataFrame([("<|im_start|>a\nb<|im_end|>\nrest",), ("<|im_start|>a<|im_end|>\n",), ("",)], "whole string")
    assert [r[0] is None for r in broken.select(cf.parse_conversation(F.col("whole"))).collect()] == [True, True, False]
    plain = made.filter("level = 0").count()
    assert 0 < plain < made.count()


def test_long_conversations_and_texts(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i} <|im_end|>") for i in range(3000)] + [(2, 0, "assistant", "long <|im_start|> " * 50_000)]
    found = {r["conv_id"]: r for r in cf.conversation_digests(cf.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert found[1]["n_turns"] == 3000 and found[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3000]).encode()).hexdigest()
    assert found[2]["loss_chars"] == 18 * 50_000 and found[2]["loss_sha256"] == hashlib.sha256(rows[-1][3].encode()).hexdigest()


def test_chat_digests_with_ties_nulls_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "assistant", "z"), (1, 0, "user", "a"), (None, 1, "assistant", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in cf.conversation_digests(cf.format_turns(turns)).collect()}
    said = "assistant\nz\nuser\na\nuser\na\nuser\nb\n"
    assert found[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and found[1]["n_turns"] == 4
    assert found[None]["loss_sha256"] == hashlib.sha256(b"q").hexdigest()
    assert cf.conversation_digests(cf.format_turns(turns.filter("false"))).count() == 0


# --- mixing -------------------------------------------------------------------------------------------------------


def targets(sizes, weights=(5.0, 2.0, 1.0)):
    """Repeated resharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > 2 * sizes[s]}
        if not over:
            return full | t
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]
            open_.discard(s)


@pytest.mark.parametrize("bucket_rows", [2, 1000])
def test_mix(spark, bucket_rows):
    rng = random.Random(1)
    rows = [(i, rng.choice(["b", "a", None, "é", "c"]), rng.choice([0, 1, 3, 500, 20]), rng.choice([1.0, 0.25, None])) for i in range(300)]
    rows += [(1, "a", 7, 1.0), (1, "a", 7, 1.0), (None, "a", 9, 1.0), (None, None, 0, 1.0)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double").repartition(5)
    found = mx.mix(sized, bucket_rows=bucket_rows).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes)
    taken = {}
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mx.mix(sized.repartition(2), bucket_rows=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, size long, weight double")
    assert mx.mix(none).count() == 0
    zero = spark.createDataFrame([(1, "a", 0, 1.0)], "doc_id long, source string, size long, weight double")
    assert mx.mix(zero).first()["taken"] == 0


def test_sized_documents(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (9, None)], "doc_id long, quality int")
    rows = [(1, "one two"), (2, "three"), (3, None), (None, "a b c"), (None, "a b"), (9, " \t\n"), (4, "w " * 100_000), (1, "one two")]
    sized = mx.sized_documents(docs(spark, rows), labels).collect()
    assert sorted(map(str, [(r["doc_id"], r["size"], r["weight"]) for r in sized])) == sorted(map(str, [(1, 2, 1.0), (2, 1, 0.25), (3, 0, 0.5), (None, 3, 0.5), (None, 2, 0.5), (9, 0, 0.5), (4, 100_000, 0.5), (1, 2, 1.0)]))
    assert len({r["draw"] for r in sized if r["doc_id"] is None}) == 2 and all(r["draw"] is None for r in sized if r["doc_id"] is not None)
    assert mx.sized_documents(docs(spark, []), labels).count() == 0


@pytest.mark.parametrize("weight", [1.0, 0.5, 0.25, 0.01])
def test_ranges_of_keys_are_bounded(weight):
    rng, n, most = np.random.default_rng(1), 400_000, 256
    keys = rng.exponential(size=n) / np.where(rng.random(n) < 0.7, weight, 1.0)
    ranges = np.floor(np.log2(keys) * np.ceil(n / (4 * most))).astype(np.int64)
    assert np.unique(ranges, return_counts=True)[1].max() <= 1.5 * most


def test_good_documents_come_first(spark):
    rows = [(i, "a" if i % 2 else "b", 10, 1.0 if i % 4 < 2 else 0.05) for i in range(4000)]
    found = mx.mix(spark.createDataFrame(rows, "doc_id long, source string, size long, weight double"), share=1.25).filter("source = 'b'").collect()
    more = lambda good: np.mean([r["taken"] for r in found if (r["doc_id"] % 4 < 2) == good])
    assert more(True) > 1.5 * more(False)


# --- SimHash ------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(spark):
    rows = corpus(5) + [(900 + i, f"a b c d e f g {i % 3}") for i in range(9)]
    found = sh.near_groups(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fp"] & (2**64 - 1)) for r in found) == sorted((i is None, i, plain_fingerprint(t)) for i, t in rows)
    fps = sorted({plain_fingerprint(t) for _, t in rows})
    group = {f: f for f in fps}
    find = lambda x: x if group[x] == x else find(group[x])
    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= 4:
                group[find(x)] = find(y)
    lowest = {}
    for i, t in rows:
        if i is not None:
            g = find(plain_fingerprint(t))
            lowest[g] = min(lowest.get(g, i), i)
    for r in found:
        assert r["component_id"] == lowest.get(find(r["fp"] & (2**64 - 1)))
    assert sh.near_groups(docs(spark, [])).count() == 0


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 5), replace=False).astype(np.uint64)) for b in base for _ in range(6)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    edges = sh.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"))
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    d = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        new = np.array([label[d[i]].min() for i in range(len(fps))])
        if (new == label).all():
            break
        label = new
    signed = fps.view(np.int64)
    assert len({(roots.get(int(x), int(x)), int(c)) for x, c in zip(signed, label, strict=True)}) == len(set(label.tolist()))


def test_pivot_tables_discard_what_does_not_link():
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 63, 3000, np.uint64))
    refs = sh.pivots(fps)
    apart = np.bitwise_count(refs[:, None] ^ refs[None, :])[np.triu_indices(len(refs), 1)]
    assert len(refs) == sh.N_PIVOTS and apart.min() >= 26
    shared = rng.integers(0, 1 << 63, 1, np.uint64) & np.uint64((1 << 27) - 1)
    key = (fps & ~np.uint64((1 << 27) - 1)) | shared  # unrelated fingerprints that meet under one key
    table = sh.distance_table(key, refs)
    discarded = np.mean([(np.abs(table[i + 1 :] - table[i]) > sh.MAX_BITS).any(axis=1).mean() for i in range(500)])
    print("discarded", discarded)
    assert discarded > 0.95
    assert len(sh.pivots(np.empty(0, np.uint64))) == 0 and len(sh.pivots(fps[:3])) == 3


def test_links_come_from_pairs_that_the_pivot_tables_leave(monkeypatch):
    fps = np.array([0, 1, 3, 1 << 60], np.uint64)
    table = sh.distance_table(fps, sh.pivots(fps))
    assert {tuple(sorted(e)) for e in sh.forest(fps, table)} == {(0, 1), (0, 2), (0, 3)}
    far = table.copy()
    far[3] += 50  # a table that is wrong discards the pair before its bits are looked at
    assert {tuple(sorted(e)) for e in sh.forest(fps, far)} == {(0, 1), (0, 2)}


def test_keep_one(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (8, "entirely other words in this one here")]
    kept = sh.keep_one(docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 8] and kept.columns == docs(spark, []).columns
    nameless = [(None, "a b c d e f"), (None, "no one has this text but two"), (None, "no one has this text but two"), (None, None), (None, "")]
    kept = sh.keep_one(docs(spark, rows + nameless)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "8", "None", "None"]
    assert sum(r["text"] == "no one has this text but two" for r in kept) == 1
    assert sh.keep_one(docs(spark, [])).count() == 0


def test_keep_one_where_groups_share_their_smallest_id(spark):
    rows = [(3, "a b c d e f"), (3, "entirely other words in this one here"), (5, "a b c d e f"), (8, "entirely other words in this one here"), (3, "a b c d e f")]
    kept = sh.keep_one(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted(set(rows[:2]))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {roots[i] for i in range(301)} == {0} and roots[1001] == 1000


# --- line dedup ---------------------------------------------------------------------------------------------------


def test_alignment():
    assert ld.align([(0, 0, 2), (1, 1, 2)]) == ([(0, 0, 3)], [])
    assert ld.align([(0, 5, 2), (7, 1, 2), (9, 7, 1)]) in (([(0, 5, 2), (9, 7, 1)], [(7, 1, 2)]), ([(7, 1, 2), (9, 7, 1)], [(0, 5, 2)]))
    assert ld.align([(3, 0, 1), (3, 4, 1)]) == ([], [(3, 0, 1), (3, 4, 1)])  # repeated runs are no anchors
    assert ld.align([]) == ([], [])
    rng = random.Random(3)
    for _ in range(200):
        places = [rng.randrange(12) for _ in range(rng.randrange(10))]
        best = [places[k] for k in ld.longest_increasing(places)]
        longest = max((len(c) for n in range(len(places) + 1) for c in itertools.combinations(places, n) if all(x < y for x, y in zip(c, c[1:], strict=False))), default=0)
        assert len(best) == longest and all(x < y for x, y in zip(best, best[1:], strict=False))


def plain_patience(a, b):
    """Common blocks (start in b, length) by patience diff in its plainest form, apart from the library's."""
    once = lambda v: {x: i for i, x in enumerate(v) if v.count(x) == 1}
    at_a, at_b = once(a), once(b)
    pairs = sorted((at_b[x], at_a[x]) for x in at_a if x in at_b)
    best = []
    for k, (_, i) in enumerate(pairs):
        before = max((best[m] for m in range(k) if pairs[m][1] < i), key=len, default=[])
        best.append([*before, k])
    out = []
    for k in max(best, key=len, default=[]):
        j, i = pairs[k]
        s, e = j, j + 1
        while s > 0 and i - (j - s) > 0 and a[i - (j - s) - 1] == b[s - 1]:
            s -= 1
        while e < len(b) and i + e - j < len(a) and a[i + e - j] == b[e]:
            e += 1
        out.append((s, e - s))
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    lines = [f"line {i} " + "word " * rng.randint(1, 12) for i in range(40)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(50)]
    rows += [(60, rows[0][1]), (61, None), (62, ""), (63, "short\n" * 40), (64, rows[1][1] + "\n" + "new line " * 9), (5, rows[5][1])]
    found = ld.dedup_lines(docs(spark, rows)).collect()
    _, common = lines_of_any_earlier(rows)
    assert len(found) == len(rows)
    left = lambda i, t: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in common[i, t]) if t is not None else ""
    assert sorted((r["doc_id"], r["text"] or "") for r in found) == sorted((i, left(i, t)) for i, t in rows)
    assert next(r for r in found if r["doc_id"] == 61)["text"] is None
    again = ld.drop_duplicate_lines(docs(spark, rows))
    assert again.columns == docs(spark, []).columns
    assert 60 not in {r["doc_id"] for r in again.collect()}
    assert ld.dedup_lines(docs(spark, [])).count() == 0


def lines_of_any_earlier(rows):
    """Aligned blocks of every pair of documents, and all blocks that two documents have in common, by brute force."""
    shape = {(i, t): [x.strip(" ") for x in t.split("\n")] for i, t in rows if i is not None and t is not None}
    aligned, common = {k: set() for k in shape}, {k: set() for k in shape}
    for (a, v), (b, w) in ((x, y) for x in shape.items() for y in shape.items() if x[0][0] < y[0][0]):
        for t, n in plain_patience(v, w):
            if sum(map(len, w[t : t + n])) >= ld.MIN_BLOCK_CHARS and max(map(len, w[t : t + n])) >= ld.MIN_LINE_CHARS:
                aligned[b] |= set(range(t, t + n))
        for i in range(len(v)):
            for j in range(len(w)):
                n = 0
                while i + n < len(v) and j + n < len(w) and v[i + n] == w[j + n]:
                    n += 1
                block = w[j : j + n]
                if sum(map(len, block)) >= ld.MIN_BLOCK_CHARS and max(map(len, block)) >= ld.MIN_LINE_CHARS:
                    common[b] |= set(range(j, j + n))
    return aligned, common


def test_line_dedup_with_all_earlier_documents(spark):
    rng = random.Random(12)
    one, two, twice = "the first of the shared lines", "the second of the shared lines, a bit more", "x" * 70
    rows = [(1, one + "\nown words"), (2, two + "\nown words too"), (3, "so\n" + one + "\n\n" + two), (4, "other\n" + one + "\n\n" + two + "\non")]
    rows += [(5, twice + "\na\n" + twice), (6, "b\n" + twice + "\nc\n" + twice), (3, "so\n" + one + "\n\n" + two + "\nd"), (None, twice), (7, None), (8, "")]
    lines = [f"line {i} " + "word " * rng.randint(0, 9) for i in range(14)] + ["", "ab"]
    rows += [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(10, 70)]
    aligned, common = lines_of_any_earlier(rows)
    ids = {(r["doc_id"], r["th"]): r["text"] for r in docs(spark, rows).selectExpr("doc_id", "xxhash64(text) AS th", "text").collect()}
    made = ld.aligned_blocks(docs(spark, rows)).collect()
    found = {(r["doc_id"], ids[r["doc_id"], r["th"]]): sorted({k for x in r["blocks"] for k in range(x["b"], x["b"] + x["n"])}) for r in made}
    assert all(r["gone"] == len(found[r["doc_id"], ids[r["doc_id"], r["th"]]]) for r in made)
    for r in made:  # a block's lines are those of the earlier document
        here = ids[r["doc_id"], r["th"]].split("\n")
        for x in r["blocks"]:
            assert x["earlier"] < r["doc_id"] and any(
                [v.strip(" ") for v in t.split("\n")[x["a"] : x["a"] + x["n"]]] == [v.strip(" ") for v in here[x["b"] : x["b"] + x["n"]]] for i, t in rows if i == x["earlier"]
            )
    assert any(x["moved"] for r in made for x in r["blocks"]) and not all(x["moved"] for r in made for x in r["blocks"])
    assert found == {k: sorted(v) for k, v in common.items() if v}
    assert all(v <= common[k] for k, v in aligned.items())
    kept = {r["doc_id"]: r["text"] for r in ld.drop_duplicate_lines(docs(spark, rows)).filter("doc_id IN (3, 4, 5, 6)").collect()}
    assert kept[4] == "other\non" and kept[6] == "b\nc" and kept[5] == twice + "\na\n" + twice
    assert ld.aligned_blocks(docs(spark, [])).count() == 0


def test_line_dedup_without_ids_of_long_texts_and_one_common_line(spark):
    hot = "a line of more than sixty characters that every document of the table holds"
    long = "\n".join(f"line number {i} of a very long document, with words" for i in range(30000))
    rows = [(i, f"own {i}\n{hot}") for i in range(1, 300)] + [(None, hot), (None, None), (400, long), (401, "head\n" + long)]
    found = {r["doc_id"]: r for r in ld.dedup_lines(docs(spark, rows)).collect() if r["doc_id"] is not None}
    assert found[1]["__gone"] == 0 and all(found[i]["text"] == f"own {i}" for i in range(2, 300))
    assert found[400]["__gone"] == 0 and found[401]["text"] == "head" and found[401]["__gone"] == 30000
    assert ld.dedup_lines(docs(spark, rows)).filter("doc_id IS NULL").agg(F.sum("__gone")).first()[0] == 0


def test_columns_named_like_results(spark):
    frame = docs(spark, [(1, "x" * 70), (2, "x" * 70), (3, "other words of another kind altogether")])
    named = frame.select("*", *[F.lit(7).alias(c) for c in ("__lines", "__gone", "gone", "gone_id", "row", "root", "__th", "leaked", "doc id.x")])
    assert ld.drop_duplicate_lines(named).columns == named.columns and ld.drop_duplicate_lines(named).count() == 2
    assert sh.keep_one(named).columns == named.columns and sh.keep_one(named).count() == 2


# --- substring dedup ----------------------------------------------------------------------------------------------


def plain_substring_dedup(rows):
    first = {}
    split = [((math.inf if i is None else i), (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            first[k] = min(first.get(k, (math.inf, math.inf)), (i, j))
    out = []
    for (i, w), (doc_id, _) in zip(split, rows, strict=True):
        gone = set()
        for j in range(len(w) - 19):
            if first[tuple(w[j : j + 20])] < (i, j):
                gone.update(range(j, j + 20))
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "heavy"), [(100_000, 256), (1, 256), (100_000, 3), (100_000, 1)])
def test_substring_dedup(spark, hot, heavy):
    rows = corpus(8)
    found = [tuple(r) for r in sd.dedup_substrings(docs(spark, rows), hot_anchor_rows=hot, shard_rows=10, heavy_in_batch=heavy).collect()]
    assert sorted(map(str, found)) == sorted(map(str, plain_substring_dedup(rows)))
    assert sum(r[2] for r in found) > 500


def test_automaton_tells_windows_of_one_hash_apart(monkeypatch):
    rng = random.Random(2)
    passages = [[rng.randrange(3) for _ in range(rng.randrange(30, 60))] for _ in range(12)] + [[1] * 40, [2] * 19, []]
    passages += [passages[0][5:35], passages[1][2:30] + passages[0][5:30]]
    keys = {}
    for p in passages:
        for i in range(len(p) - 19):
            keys[tuple(p[i : i + 20])] = keys.get(tuple(p[i : i + 20]), 0) + 1
    want = {(x, i) for x, p in enumerate(passages) for i in range(len(p) - 19) if keys[tuple(p[i : i + 20])] > 1}
    for hashes in (sd.window_hashes, lambda numbers: np.zeros(max(0, len(numbers) - 19), np.uint64)):
        monkeypatch.setattr(sd, "window_hashes", hashes)
        x, at, k = sd.occurrences(passages)
        found = {(a, b): c for a, b, c in zip(x.tolist(), at.tolist(), k.tolist(), strict=True)}
        assert want <= found.keys()
        for (a, b), c in found.items():
            for (d, e), g in found.items():
                assert (c == g) == (passages[a][b : b + 20] == passages[d][e : e + 20])


def test_substring_dedup_of_nothing(spark):
    assert sd.dedup_substrings(docs(spark, [])).count() == 0
    assert [r["n_words"] for r in sd.dedup_substrings(docs(spark, [(1, None)])).collect()] == [0]


def test_anchor_is_the_first_smallest():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 6, 300).astype(np.uint64)
    at = sd.first_smallest(h)
    assert at.tolist() == [i + int(h[i : i + sd.SPAN].argmin()) for i in range(len(h) - sd.SPAN + 1)]
