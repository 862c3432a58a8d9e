"""The kept index: equal to search over texts, edge cases, and how little a query reads."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.operators import index as ix
from citeloom.operators import postings as po
from citeloom.operators import retrieval as rt

TEXTS = ["alpha beta alpha", "beta, gamma! beta beta", None, "", "delta " * 40, "alpha gamma delta epsilon alpha beta", "the of and", "ALPHA Beta"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "native_rank", "branch_rank").collect())


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i * 7 + 3, t) for i, t in enumerate(TEXTS)] + [(1000 + i, f"alpha word{i} common" + " beta" * (i % 3)) for i in range(60)]
    return spark.createDataFrame(rows, "chunk_id long, content string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "alpha beta"), (2, "word7 of the"), (3, ""), (4, "nothing here"), (5, "common"), (6, "Gamma, delta"), (7, None)], "query_id long, question string")


@pytest.mark.parametrize("block", [1024, 7])
@pytest.mark.parametrize("every", [False, True])
def test_the_index_finds_what_the_texts_hold(spark, tmp_path, chunks, queries, block, every):
    path = str(tmp_path / "index")
    ix.write_index(chunks, path, 8, block)
    index = ix.read_index(spark, path)
    assert rows_of(ix.search(index, queries, 5, every, 8)) == rows_of(rt.fts_branch(queries, chunks, 5, every, []))
    few = ix.lookup(index, queries, 8, most_tokens=1)  # by the join alone
    assert few.count() == ix.lookup(index, queries, 8).count()


def test_a_frequent_token_is_many_blocks(chunks):
    made = ix.blocks(chunks, 8, 7).filter("token = 'alpha'").collect()
    assert len(made) > 4 and sum(len(r["ids"]) for r in made) == 63
    assert sorted(r["first_id"] + i for r in made for i in r["ids"]) == [3, 38, 52, *range(1000, 1060)]


def test_an_index_is_not_written_over(tmp_path, chunks):
    ix.write_index(chunks, str(tmp_path / "index"))
    with pytest.raises(Exception, match="already exists"):
        ix.write_index(chunks, str(tmp_path / "index"))


def test_an_index_of_nothing(spark, tmp_path, chunks, queries):
    ix.write_index(chunks.filter("false"), str(tmp_path / "index"))
    assert ix.search(ix.read_index(spark, str(tmp_path / "index")), queries, 5, False).collect() == []


def test_a_query_reads_its_folders_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + j * j) % 5000}" for j in range(200))) for i in range(300)], "chunk_id long, content string")
    path = str(tmp_path / "index")
    ix.write_index(docs, path)
    index = ix.read_index(spark, path)

    def read(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        return leaf.metrics().apply("filesSize").value(), leaf.metrics().apply("numOutputRows").value()

    all_bytes, all_rows = read(index.select("token", "ids"))
    tokens = ["w17", "w4000"]
    buckets = sorted({r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(ix.bucket_of(F.col("t"), ix.BUCKETS)).collect()})
    part, rows = read(ix.rows_of(index, tokens, buckets).select("token", "ids"))
    assert part * 15 < all_bytes and rows * 15 < all_rows


@pytest.mark.parametrize("tokens", [1 << 20, 5])
def test_answers_where_chunks_are_read_equal_joins(spark, monkeypatch, chunks, queries, tokens):
    """Slices of any size give what joins of all tokens give; ids may be strings; only the first k of a slice are passed on."""
    monkeypatch.setattr(po, "SLICE_TOKENS", tokens)
    named = chunks.withColumn("chunk_id", F.concat(F.lit("c"), "chunk_id"))
    for held in (chunks, named):
        order = [F.desc("native_rank"), F.asc("chunk_id")]
        assert rows_of(rt.fts_branch(queries, held, 5, False, [])) == rows_of(rt.top_k(rt.fts_matches(queries, held, False, []), order, 5))
        assert rows_of(rt.fts_branch(queries, held, 5, True, [])) == rows_of(rt.top_k(rt.cover_matches(queries, held, []), order, 5))
    wanted = po.Wanted.of(rt.lexeme_rows(queries))
    batch = pa.RecordBatch.from_pydict({"chunk_id": list(range(500)), "tokens": [["alpha", "beta"]] * 500})
    kind = rt.answer_schema(queries.schema["query_id"], chunks.schema["chunk_id"], False)
    parts = list(po.from_texts(wanted, 5, 100, kind)(iter([batch])))
    assert len(parts) >= 5 and max(p.num_rows for p in parts) <= 5 and max(ids[-1].as_py() - ids[0].as_py() for ids, _, _ in po.slices([batch], 100)) < 100
    assert po.Wanted.of(rt.lexeme_rows(queries), 3) is None  # joins then


def test_the_index_is_made_without_a_shuffle(chunks):
    assert "Exchange" not in ix.blocks(chunks)._jdf.queryExecution().executedPlan().toString()
