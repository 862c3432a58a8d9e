"""Token alignment, fast similarity sketches and spelling groups against plain Python, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from citeloom.llm import minhash_dedup as mh
from citeloom.llm import spelling as sp
from citeloom.llm import token_align as ta

ODD_TEXTS = ["a▁b", None, "", " ", "  a  b \n c\t ", "<s> </s> <|endoftext|> x", "é ﬁ \xa0x\x85 y", "中文 字 " * 50, "a" * 5000, "tie tie", "tie tie", "don't  we'll\r\n\r\n ok", "　 a  b", "x ▁ y"]


@pytest.fixture(scope="module")
def tok():
    with open(f"{ta.TOKENIZERS}/byte_bpe_50k.json", "rb") as f, open(f"{ta.TOKENIZERS}/piece_bpe_32k.model", "rb") as g:
        return ta.Tokenizers(f.read(), g.read())


def plain_alignment(tok, rows):
    """Whole texts, token by token; counts over all rows."""
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(f"{ta.TOKENIZERS}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    per, count = [], Counter()
    for doc_id, text in rows:
        a, b = (whole.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)) if text else ([], [])
        if not a or not tok.spelled(text, a, b):
            per.append((doc_id, 0, 0, [], []))
            continue
        a_ends, b_ends = np.cumsum([len(tok.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(tok.b_bytes[i]) for i in b]).tolist()
        links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if max(([0] + a_ends)[i], ([0] + b_ends)[j]) < min(a_ends[i], b_ends[j])] if len(a) < 300 else walk(a, b, a_ends, b_ends)
        common = sorted(set(a_ends) & set(b_ends))
        groups = [",".join(str(x) for x, e in zip(a, a_ends, strict=True) if s < e <= t) + "|" + ",".join(str(y) for y, e in zip(b, b_ends, strict=True) if s < e <= t) for s, t in zip([0, *common], common, strict=False)] if len(a) < 300 else None
        count.update(links)
        per.append((doc_id, len(a), len(b), (len(common), groups), links))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for doc_id, a, b, groups, links in per:
        digest = "" if not links else None if groups[1] is None else hashlib.sha256(";".join(groups[1]).encode()).hexdigest()
        out.append((doc_id, a, b, groups[0] if links else 0, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out


def walk(a, b, a_ends, b_ends):
    i = j = 0
    links = []
    while i < len(a):
        links.append((a[i], b[j]))
        e, f = a_ends[i], b_ends[j]
        i, j = i + (e <= f), j + (f <= e)
    return links


def same(found, want):
    key = lambda r: tuple(map(str, r))
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert [r[:7] for r in found] == [r[:7] for r in want]
    assert all(w[7] is None or f[7] == w[7] for f, w in zip(found, want, strict=True))


@pytest.mark.parametrize("limit", [0, 10**6])
def test_alignment_of_odd_texts(spark, tok, limit):
    rows = [*enumerate(ODD_TEXTS), (None, "tie tie"), (3, "tie tie again")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pair string, n long")  # clashing names
    same(ta.align_tokens(docs, broadcast_pairs=limit).collect(), plain_alignment(tok, rows))


def test_alignment_of_documents(spark, tok):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(ta.align_tokens(docs).collect(), plain_alignment(tok, [(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_alignment_of_an_empty_table(spark):
    assert ta.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pieces_make_up_the_text_and_encode_as_it_does(tok):
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["a", "Be", " ", "  ", "\n", ".", "é", "7", "\t", "\xa0", "'s", "中"]) for _ in range(r.randint(1, 40)))
        assert " ".join(ta.cut(text)) == text
        a, b = tok.encode(ta.cut(text))
        assert ([i for x in a for i in x], [i for x in b for i in x]) == tuple(x[0] for x in tok.encode([text]))


def test_ranks_and_the_file_encode_alike(tok):
    with open(f"{ta.TOKENIZERS}/byte_bpe_50k.json", "rb") as f:
        by_file = tok.by_file(f.read())
    for t in ODD_TEXTS:
        assert tok.encode_a(" " + (t or "")) == by_file(" " + (t or ""))


def test_union_gives_components():
    r = np.random.default_rng(3)
    for n in (1, 2, 30, 400):
        a, b = r.integers(0, n, n // 2), r.integers(0, n, n // 2)
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                label[x] = label[y] = min(label[x], label[y])
        assert ta.union(a, b, n).tolist() == label


def test_known_pieces_are_begun_anew(spark, tok, monkeypatch):
    monkeypatch.setattr(ta, "MOST_PIECES", 3)
    monkeypatch.setattr(ta, "SLICE", 10)
    import pyarrow as pa

    with open(f"{ta.TOKENIZERS}/byte_bpe_50k.json", "rb") as f, open(f"{ta.TOKENIZERS}/piece_bpe_32k.model", "rb") as g:
        files = (f.read(), g.read())
    batch = pa.RecordBatch.from_arrays([pa.array([t and t.encode() for t in ODD_TEXTS], pa.binary()), pa.array(range(len(ODD_TEXTS)))], names=["text", "doc_id"])
    rows = [r for b in ta._encoded(iter([batch, batch]), files) for r in b.to_pylist()]
    want = plain_alignment(tok, list(enumerate(ODD_TEXTS)))
    assert [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) for r in rows] == 2 * [w[:5] for w in want]


# -- fast similarity sketches ---------------------------------------------------------------------------------------------


def plain_sets(text):
    w = (text or "").encode().lower().split()
    return set() if not w else {b" ".join(w)} if len(w) < 4 else {b" ".join(w[i : i + 4]) for i in range(len(w) - 3)}


def plain_near(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [plain_sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            label[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        c = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), c, doc_id == c))
    return out


def check_near(spark, rows, **k):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, node long, band string").repartition(3)
    found = sorted((tuple(r) for r in mh.near_groups(docs, **k).collect()), key=str)
    assert found == sorted(plain_near(rows), key=str)


def prose(r, n):
    return [r.choice("abcdefghij") + str(r.randint(0, 400)) for _ in range(n)]


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = "new" + str(r.random())
    return words


@pytest.mark.parametrize("part", [4096, 5])
def test_near_groups_equal_all_pairs(spark, part):
    r = random.Random(part)
    rows = []
    for _ in range(6):  # groups about and under the limit, chains, and copies
        base = prose(r, r.choice([12, 60, 150]))
        group = [base] + [edited(r, base, r.randint(0, 5)) for _ in range(12)]
        for _ in range(6):
            group.append(edited(r, group[-1], 2))
        rows += [" ".join(g) for g in group] + [" ".join(base).upper()]
    rows += ["one", "One ", "one two three", "a a a a a a", "a a a a", None, "", " \n"]
    r.shuffle(rows)
    rows = list(enumerate(rows)) + [(None, rows[0]), (None, "alone here"), (2, "another text of the same id entirely"), (3, rows[3])]
    check_near(spark, rows, part=part)


@pytest.mark.parametrize("cell_bytes, cell_pairs", [(1 << 23, 1 << 18), (200, 1 << 18), (1 << 23, 3), (64, 2)])
def test_cells_of_any_size_verify_the_same_pairs(spark, cell_bytes, cell_pairs):
    r = np.random.default_rng(cell_pairs)
    crowds = [r.integers(0, 1 << 62, 40) for _ in range(3)]
    sets = {i: np.unique(np.concatenate([r.permutation(crowds[i % 3])[:36], r.integers(0, 1 << 62, r.integers(0, 5))]).astype(np.uint64)) for i in range(45)}
    pairs = [(i, j) for i, j in combinations(range(45), 2) if i % 3 == j % 3 or r.random() < 0.05] + [(3, 99)]  # 99 has no set
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "node long, set binary")
    found = mh.verified_in_cells(spark.createDataFrame(pairs, "a long, b long").repartition(3), frame, cell_bytes, cell_pairs).collect()
    want = {(i, j) for i, j in pairs if j in sets and 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})}
    assert len(found) == len(want) and {(x["a"], x["b"]) for x in found} == want and 0 < len(want) < len(pairs)


def test_a_crowd_under_the_limit_is_not_told_pair_by_pair(spark, monkeypatch):
    r, told, verified_in_cells = random.Random(4), [], mh.verified_in_cells
    base = prose(r, 200)
    crowd = [edited(r, base, 4) for _ in range(160)]  # about 0.72 with one another
    rows = [" ".join(w) for w in crowd + [edited(r, w, 2) for w in crowd[:5]]]

    def counted(pairs, *rest):
        told.append(pairs.count())
        return verified_in_cells(pairs, *rest)

    monkeypatch.setattr(mh, "verified_in_cells", counted)
    check_near(spark, list(enumerate(rows)))
    assert sum(told) <= 16 * len(rows)  # of some 13,000 pairs


@pytest.mark.parametrize("dense, slice_, side", [(4, 1 << 21, 2), (4, 7, 2), (1, 50, 2), (10**6, 50, 2), (4, 7, 0), (1, 1, 0), (10**6, 1 << 21, 0)])
def test_links_of_a_crowd_join_what_all_links_join(monkeypatch, dense, slice_, side):
    import pyarrow as pa

    monkeypatch.setattr(mh, "DENSE", dense)
    monkeypatch.setattr(mh, "SLICE", slice_)
    r = np.random.default_rng(slice_ + dense)
    crowds = [r.integers(0, 1 << 62, 60) for _ in range(3)]
    sets = [np.unique(np.concatenate([r.permutation(crowds[i % 3])[: r.integers(50, 60)], r.integers(0, 1 << 62, r.integers(0, 8))]).astype(np.uint64)) for i in range(50)] + [np.array([7], np.uint64)]
    sides, comp = [side or int(x) for x in r.integers(0, 2, 51)], [int(x) for x in np.arange(51) - np.arange(51) % 5 * (np.arange(51) < 10)]

    def joined(links):
        label = list(comp)
        for x, y in links:
            label = [label[x] if c == label[y] else c for c in label]
        return {frozenset(i for i, c in enumerate(label) if c == k) for k in label}

    links = [(x, y) for x, y in combinations(range(51), 2) if (side or sides[x] != sides[y]) and 100 * len({*sets[x]} & {*sets[y]}) >= 80 * len({*sets[x]} | {*sets[y]})]
    found = mh._crowd_links(pa.table({"side": sides, "node": list(range(51)), "comp": comp, "held": [s.tobytes() for s in sets]})).to_pylist()
    assert len(links) > len(found) > 3 and {(min(x.values()), max(x.values())) for x in found} <= set(links)
    assert joined([(x["a"], x["b"]) for x in found]) == joined(links)


@pytest.mark.parametrize("part, cell_bytes", [(4096, 1 << 23), (4096, 2000), (3, 1 << 23)])
def test_crowds_of_any_part_join_the_same_sets(spark, monkeypatch, part, cell_bytes):
    monkeypatch.setattr(mh, "CELL_BYTES", cell_bytes)
    monkeypatch.setattr(mh, "MOST", 0)  # every band that holds a candidate is a crowd
    r = random.Random(part)
    base = prose(r, 90)
    rows = [" ".join(edited(r, base, r.randint(0, 4))) for _ in range(25)]
    check_near(spark, list(enumerate(rows)), part=part)


def test_near_groups_of_nothing(spark):
    assert mh.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    check_near(spark, [(5, None), (6, "x y z w v"), (7, "")])


def test_a_set_of_any_size_fills_every_coordinate():
    for n in (1, 2, 7, 100, 5000):
        h = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        low = mh.sketch(h)
        assert (low >> np.uint64(32)).max() < 2 * mh.SIZE
        plain = {}
        for i in range(2 * mh.SIZE):  # round by round, as the method is stated
            x = mh.mixed(h + (np.full(1, i + 1, np.uint64)) * mh.GOLDEN)
            for v in x.tolist():
                j = ((v >> 32) * mh.SIZE) >> 32 if i < mh.SIZE else i - mh.SIZE
                plain[j] = min(plain.get(j, 1 << 64), i << 32 | v & 0xFFFFFFFF)
            if len(plain) == mh.SIZE:
                break
        assert low.tolist() == [plain[j] for j in range(mh.SIZE)]


def test_equal_coordinates_concentrate_about_the_similarity():
    r, shares, met = np.random.default_rng(1), [], []
    for n in (5, 9, 45, 900):
        for _ in range(60):
            h = r.integers(0, 1 << 63, 10 * n // 9 + n).astype(np.uint64)
            a, b = mh.sketch(h[: 10 * n // 9]), mh.sketch(h[n // 9 : 10 * n // 9 + n // 9])  # similarity 0.8 or a little more
            shares.append((a == b).mean())
            met.append((mh.bands(a) == mh.bands(b)).any())
    assert min(shares) > mh.LEAST_EQUAL and all(met)


# -- spelling groups ------------------------------------------------------------------------------------------------------


def plain_spelling(rows):
    import re

    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w in words:
        others = sorted((-words[v], v) for v in words if v != w and abs(len(v) - len(w)) < 2 and near(w, v))
        n_near[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, n_near[w], words[form[w]] if form[w] else None))
    return out


def test_spelling_groups_equal_all_pairs(spark):
    r = random.Random(8)
    letters = "abcdeéÿ×à"
    base = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(12)] + ["aaaaaa", "ababab"]
    words = []
    for b in base:
        for _ in range(14):
            w = list(b)
            for _ in range(r.randint(0, 2)):
                i = r.randrange(len(w) + 1)
                w[i : i + r.randint(0, 1)] = [r.choice(letters)] if r.random() < 0.7 else []
            words += ["".join(w)] * r.choice([1, 3, 3, 4, 8, 20])
    words += ["q" * 3000] * 3 + ["q" * 3001] * 9 + ["q" * 1500 + "x" + "q" * 1500] * 7
    r.shuffle(words)
    rows = [(i, r.choice([" ", "-", "ā", "\n"]).join(w.upper() if r.random() < 0.3 and w.isascii() else w for w in words[k : k + 9])) for i, k in enumerate(range(0, len(words), 9))]
    rows += [(None, rows[0][1]), (1, rows[1][1]), (7, None), (8, ""), (9, "7 8 !")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, word string, wid long")
    found = [tuple(x) for x in sp.spelling_groups(docs).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_spelling(rows)
    assert any(x[1] and x[2] != x[1] for x in found)  # chains of forms


def test_spelling_groups_of_nothing(spark):
    assert sp.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert sp.spelling_groups(spark.createDataFrame([(1, "no such words"), (2, None)], "doc_id long, text string")).collect() == []


def test_equal_deletions_are_one_key():
    key, of, lo, hi = sp.deletions(["aabb", "abb"])
    assert sorted(zip(of.tolist(), lo.tolist(), hi.tolist(), strict=True)) == [(0, -1, -1), (0, 0, 1), (0, 2, 3), (1, -1, -1), (1, 0, 0), (1, 1, 2)]
    assert key[of == 0][1] == key[of == 1][0]  # a deletion of the one is the other
