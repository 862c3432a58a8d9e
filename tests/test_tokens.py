"""Byte pairs against another public implementation of the same vocabulary, and the chunkers on them."""

import dataclasses
import hashlib
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.config import Chunking
from citeloom.functions import tokens as tk
from citeloom.operators import chunking as ch
from citeloom.plans import answering_queries as aq

SF, FILES = "/root/testdata/sf0.001", "/opt/tokenizers"
pytestmark = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.isdir(FILES)), reason="no tables or vocabularies")
ODD = ["", " ", "a", "na\u00efve \U0001f600\U0001f680 x", "<|endoftext|> ok\n\n b", "don't  we'll\t\u2028\u00e9\u0301", "x" * 3000]


@pytest.fixture(scope="module")
def pairs():
    with open(f"{FILES}/byte_bpe_50k.tiktoken", "rb") as f:
        return tk.BytePairs(f.read())


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FILES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_golden(pairs):
    assert pairs.encode("hello world") == [31373, 995]
    assert pairs("hello world") == [(0, 5), (5, 11)]


@pytest.mark.parametrize("text", ODD)
def test_round_trip_and_ranges(pairs, other, text):
    ids = pairs.encode(text)
    assert ids == other.encode(text, add_special_tokens=False).ids and pairs.decode(ids) == text
    at = pairs(text)
    assert [s for s, _ in at] == sorted(s for s, _ in at) and {i for s, e in at for i in range(s, e)} == set(range(len(text)))
    assert all(b[0] in (a[1], a[1] - 1) for a, b in zip(at, at[1:]))


def test_all_documents(spark, other):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = {r["doc_id"]: r for r in aq.bpe_tokens(spark, SF).collect()}
    assert found.keys() == texts.keys()
    for i, t in texts.items():
        ids = other.encode(t or "", add_special_tokens=False).ids
        assert found[i]["exact"] and found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_null_and_empty(spark, pairs):
    rows = spark.createDataFrame([(1, None), (None, ""), (3, "a b")], "id long, t string")
    found = {r["id"]: (r["n_tokens"], r["exact"]) for r in tk.token_ids(rows, "id", "t", pairs).collect()}
    assert found == {1: (0, True), None: (0, True), 3: (2, True)}
    assert tk.token_ids(rows.limit(0), "id", "t", pairs).collect() == []


def test_heading_windows_decode(spark, pairs, other):
    text = "para one\n\n" + " ".join(f"w\u00f6rd{i} \U0001f600" for i in range(200))
    config = Chunking(target_tokens=100, overlap_tokens=20, max_tokens=130)
    docs = spark.createDataFrame([(1, text, "text/plain")], "doc_id long, text string, media_type string")
    found = sorted(ch.heading_chunks(docs, config, pairs).collect(), key=lambda r: r["ordinal"])
    ids = other.encode(text.split("\n\n")[1], add_special_tokens=False).ids
    cuts = [ids[s : s + 100] for s in range(0, len(ids), 80) if s == 0 or len(ids) - s > 20]
    assert [r["token_count"] for r in found] == [len(other.encode("para one").ids), *map(len, cuts)]
    assert [r["content"] for r in found[1:]] == [other.decode(c, skip_special_tokens=False) for c in cuts]


def plain_pack(text, config, count):
    """Ranges over blocks that hold no empty line, by counting the tokens of every slice."""
    bounds, at = [], 0
    for piece in text.split("\n\n"):
        bounds.append((at, at + len(piece)))
        at += len(piece) + 2
    out, held = [], []
    for s, e in bounds:
        if held and count(text[held[0][0] : e]) > config.target_tokens:
            out.append((held[0][0], held[-1][1]))
            while held and (count(text[held[0][0] : held[-1][1]]) > config.overlap_tokens or count(text[held[0][0] : e]) > config.max_tokens):
                held = held[1:]
        held.append((s, e))
    return [*out, (held[0][0], held[-1][1])]


@pytest.mark.parametrize("kind", ["words", "pairs"])
def test_packing_equals_counting_slices(pairs, kind):
    spans = pairs if kind == "pairs" else ch.word_spans
    draw = random.Random(5)
    for _ in range(300):
        text = "\n\n".join(" ".join(draw.choice(["alpha", "r\u00e9sum\u00e9.", "x1,", "\U0001f600", "of"]) for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(1, 12)))
        most = draw.randint(45, 60)
        config = dataclasses.replace(Chunking(), target_tokens=draw.randint(20, 45), max_tokens=most, overlap_tokens=draw.randint(0, 19))
        assert ch.pack(text, config, spans) == plain_pack(text, config, lambda t: len(spans(t)))


def test_oversize_block_is_covered(pairs):
    text = "\U0001f600 caf\u00e9 " * 60
    config = Chunking(target_tokens=30, overlap_tokens=10, max_tokens=40)
    parts = ch.pack(text, config, pairs)
    assert parts[0][0] == 0 and parts[-1][1] == len(text.strip())
    assert all(a[0] < b[0] <= a[1] < b[1] for a, b in zip(parts, parts[1:]))
    starts = [s for s, _ in pairs(text)]
    assert all(sum(a <= s < b for s in starts) <= 40 for a, b in parts)
    tight = Chunking(target_tokens=1, overlap_tokens=0, max_tokens=1)
    assert ch.pack("\U0001f680\U0001f680", tight, pairs) == [(0, 1), (1, 2)]


def test_page_ordinals(spark):
    pages = spark.createDataFrame([(1, 2, "c d\n\ne"), (1, 1, "a b"), (2, 1, None)], "doc_id long, page_number int, text string")
    config = Chunking(target_tokens=2, overlap_tokens=0, max_tokens=3)
    found = [(r["doc_id"], r["page_number"], r["ordinal"], r["content"]) for r in ch.page_chunks(pages, config).orderBy("doc_id", "ordinal").collect()]
    assert found == [(1, 1, 0, "a b"), (1, 2, 1, "c d"), (1, 2, 2, "e")]


def test_vocabulary_size_is_checked(spark, tmp_path, monkeypatch):
    (tmp_path / "r").write_bytes(b"YQ== 0\n")
    monkeypatch.setattr(tk, "MOST_BYTES", 3)
    with pytest.raises(ValueError):
        tk.BytePairs.load(spark, str(tmp_path / "r"))


def test_texts_are_held_a_few_at_a_time(spark, pairs):
    """A full batch goes in parts, in order and whole; chunks and ids of many documents in one batch are those of each alone."""
    batch = pa.RecordBatch.from_pydict({"k": list(range(100))})
    parts = list(tk.few_rows([batch, batch.slice(0, 0)], 32))
    assert [p.num_rows for p in parts] == [32, 32, 32, 4] and pa.Table.from_batches(parts).column(0).to_pylist() == list(range(100))
    texts = [None if i == 40 else f"# h{i}\n\n" + f"word{i} " * (i * 3) for i in range(100)]
    docs = spark.createDataFrame([(i, 1, t, "text/markdown") for i, t in enumerate(texts)], "doc_id long, page_number int, text string, media_type string").coalesce(1)
    ids = {r["doc_id"]: r["ids"] for r in tk.token_ids(docs, "doc_id", "text", pairs).collect()}
    assert ids == {i: pairs.encode(t or "") for i, t in enumerate(texts)}
    cut = ch.heading_chunks(docs, spans=pairs).groupBy("doc_id").agg(F.sum("token_count"), F.max("ordinal"), F.max("start_line")).collect()
    assert {r[0]: tuple(r[1:]) for r in cut} == {i: (len(pairs.encode((f"word{i} " * (i * 3)).strip())), 0, 3) for i in range(1, 100) if i != 40}
    assert {r["doc_id"] for r in ch.page_chunks(docs, spans=pairs).collect()} == set(range(100)) - {40}
