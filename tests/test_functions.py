"""Golden values of the text functions, chunkers and small operators."""

import hashlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from citeloom.config import Chunking
from citeloom.functions import rational as ra
from citeloom.functions import text as tx
from citeloom.operators import chunking as ch
from citeloom.operators import derivation as de


def one(spark, expr, **columns):
    return spark.createDataFrame([Row(**columns)]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "lexemes", "omitted"),
    [
        ("What is the REFUND—period?", ["refund", "period"], ["what", "is", "the"]),
        ("' OR 1=1; refund refund", ["1", "refund"], ["or"]),
        ("the and what", [], ["the", "and", "what"]),
        ("Straße", ["strasse"], []),
        ("", [], []),
    ],
)
def test_lexemes(spark, text, lexemes, omitted):
    assert one(spark, tx.lexemes(F.col("t")), t=text) == lexemes
    assert one(spark, tx.omitted(F.col("t")), t=text) == omitted


def test_exact_fold(spark):
    assert one(spark, tx.exact_fold(F.col("t")), t="ﬁne STRASSE ß") == "fine strasse ss"


def test_word_set_keeps_the_empty_string(spark):
    assert sorted(one(spark, tx.word_set(F.col("t")), t="A ... (b) a")) == ["", "a", "b"]


def test_markers(spark):
    assert one(spark, tx.markers(F.col("t")), t="x [[E1]] y [[E12]] [[E0]]") == ["E1", "E12"]
    assert one(spark, tx.markers_well_formed(F.col("t")), t="x [[E1]]") is True
    assert one(spark, tx.markers_well_formed(F.col("t")), t="x [[E01]]") is False
    assert one(spark, tx.markers_well_formed(F.col("t")), t="x [[E1") is False


def test_references(spark):
    source, ordinal = tx.parse_reference(F.col("t"))
    assert one(spark, source, t="a#b#12") == "a#b"
    assert one(spark, ordinal, t="a#b#12") == 12


def test_page_text(spark):
    assert one(spark, tx.page_text(F.col("t")), t="  a  b\r\n\r\n\n\n c\x07\td  \r") == "a b\n\nc d"


def test_paths(spark):
    for path, ok in (("a/b.md", True), ("../a", False), ("/a", False), ("C:x", False), ("a\\b", False), ("a/..b", True)):
        assert one(spark, tx.safe_path(F.col("t")), t=path) is ok
    assert one(spark, tx.basename(F.col("t")), t="x\\y/z.txt") == "z.txt"
    assert one(spark, tx.line_of(F.col("t"), F.lit(4)), t="ab\ncd\n") == 2


def test_rationals(spark):
    p, q = ra.reduced(F.col("a"), F.col("b"))
    assert one(spark, ra.text(p, q), a=840, b=1260) == "2/3"
    assert one(spark, ra.text(p, q), a=0, b=7) == "0/1"


def test_checksum_golden(spark):
    text = "# Refund policy\n\nCustomers may request a refund within 30 days.\n"
    assert one(spark, F.sha2(F.col("t"), 256), t=text).startswith("18cef69f")
    rows = ch.heading_chunks(spark.createDataFrame([(1, text, "text/markdown")], "doc_id long, text string, media_type string")).collect()
    assert [(r["heading_path"], r["start_line"], r["end_line"], r["content"]) for r in rows] == [(["Refund policy"], 3, 3, "Customers may request a refund within 30 days.")]


def test_oversize_paragraph_windows(spark):
    docs = spark.createDataFrame([(1, "word " * 800, "text/plain"), (2, None, "text/plain"), (3, "", "text/plain")], "doc_id long, text string, media_type string")
    assert [(r["doc_id"], r["token_count"]) for r in ch.heading_chunks(docs).collect()] == [(1, 500), (1, 375)]
    native = ch.token_windows(docs, Chunking()).orderBy("doc_id", "ordinal").collect()
    assert [(r["doc_id"], r["token_count"]) for r in native] == [(1, 500), (1, 375)]


def test_nested_headings():
    found = list(ch.paragraphs("# A\nx\n## B\ny\nz\n\n# C\nw", True))
    assert found == [(("A",), 2, 2, "x"), (("A", "B"), 4, 5, "y\nz"), (("C",), 8, 8, "w")]


def test_pack_blocks():
    text = "\n\n".join(f"{'w ' * 9}b{i}" for i in range(6))
    config = Chunking(target_tokens=30, overlap_tokens=10, max_tokens=40)
    parts = [text[s:e].split() for s, e in ch.pack(text, config)]
    assert [len(p) for p in parts] == [30, 30, 20]
    assert parts[0][-1] == "b2" and parts[1][9] == "b2"  # a whole block of overlap
    long = ch.pack("v " * 100, config)
    assert [len(("v " * 100)[s:e].split()) for s, e in long] == [40, 40, 40]


def test_deterministic_vector():
    v = de.deterministic_vector("hello", 8)
    raw = hashlib.shake_256(b"hello").digest(16)
    values = [int.from_bytes(raw[i : i + 2], "big") / 32767.5 - 1 for i in range(0, 16, 2)]
    size = sum(x * x for x in values) ** 0.5
    assert v.tolist() == pytest.approx([x / size for x in values])


def test_reuse_is_idempotent(spark):
    new = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert de.missing(new, new.filter("k = 'b'"), ["k"]).count() == 1
    assert de.missing(new, new, ["k"]).count() == 0
