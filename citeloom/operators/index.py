"""A positional inverted index that is kept: postings in blocks, in buckets by lexeme, read by the buckets of a query.

A row is one token in a block of chunks: the ids of those that hold it, less the first of them, and its places in each. Rows lie in folders by the hash of their token and are sorted by token within
a folder, so a query reads the folders of its lexemes (partition pruning) and of those the row groups whose range of tokens holds one
(a pushed-down filter). A block is a slice of at most `BLOCK` chunks of one input partition with all their tokens, so nothing is gathered to make it, a token
that most chunks hold is many rows, and the rows of a block answer for its chunks alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import postings as po
from .retrieval import DECIMALS, answer_schema, covers, lexeme_rows, ranked_answers, top_k

BUCKETS, BLOCK = 64, 1024
SCHEMA = "token string, block int, first_id long, ids array<long>, places array<array<int>>, bucket int"


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def blocks(chunks: DataFrame, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """The rows of the index, made where the chunks are read. Ids of chunks must be distinct longs; null contents have no tokens."""
    told = chunks.select(F.col("chunk_id").cast("long"), tx.tokens(F.col("content")).alias("tokens"))
    made = told.mapInArrow(po.indexed(block), SCHEMA.removesuffix(", bucket int"))
    return made.withColumn("bucket", bucket_of(F.col("token"), buckets))


def write_index(chunks: DataFrame, path: str, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Write the index of chunks to a new folder; an index that is there is an error."""
    rows = blocks(chunks, buckets, block)
    rows.repartition("bucket", F.pmod(F.xxhash64("token", "block"), F.lit(8))).sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").mode("errorifexists").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def rows_of(index: DataFrame, tokens: list[str], buckets: list[int]) -> DataFrame:
    """The blocks of these tokens: other folders, and row groups whose range of tokens holds none of them, are not read."""
    return index.filter(F.col("bucket").isin(buckets) & F.col("token").isin(tokens)) if tokens else index.filter("false")


def lookup(index: DataFrame, queries: DataFrame, buckets: int = BUCKETS, most_tokens: int = 10_000) -> DataFrame:
    """query_id, n, lex, chunk_id, places: what the index holds of the queries' lexemes.

    While the different lexemes are few (`most_tokens`; the driver gets one more at most) they prune folders and row groups; beyond
    that the folders are nearly all needed, and the join picks the lexemes.
    """
    wanted = lexeme_rows(queries)
    tokens = wanted.select("token").distinct()
    few = tokens.select("token", bucket_of(F.col("token"), buckets).alias("b")).limit(most_tokens + 1).collect()
    rows = rows_of(index, [r["token"] for r in few], sorted({r["b"] for r in few})) if len(few) <= most_tokens else index
    each = rows.join(wanted, "token").select("query_id", "n", "lex", "first_id", F.explode(F.arrays_zip("ids", "places")).alias("p"))
    return each.select("query_id", "n", "lex", (F.col("first_id") + F.col("p.ids")).alias("chunk_id"), F.col("p.places").alias("places"))


def search(index: DataFrame, queries: DataFrame, k: int, every: bool, buckets: int = BUCKETS) -> DataFrame:
    """query_id, chunk_id, native_rank, branch_rank as `retrieval.fts_branch` has them, from the index alone.

    While the queries' lexemes are few, the rows of a block meet in one task, which has all tokens of the block's chunks, and only the first
    k or the matches go on; beyond that by `lookup`.
    """
    wanted = po.Wanted.of(lexeme_rows(queries))
    if wanted:
        places = F.col("places") if every else F.transform("places", F.size)
        rows = rows_of(index, wanted.tokens, sorted({r[0] for r in lexeme_rows(queries).select(bucket_of(F.col("token"), buckets)).distinct().collect()}))
        kind = answer_schema(queries.schema["query_id"], index.schema["first_id"], every)
        return ranked_answers(rows.select("block", "token", "first_id", "ids", places.alias("held")).groupBy("block").applyInArrow(po.from_index(wanted, None if every else k, kind), kind), k, every)
    found = lookup(index, queries, buckets).groupBy("query_id", "chunk_id", "n")
    if not every:
        rows = found.agg(F.sum(F.size("places")).alias("native_rank"))
    else:
        rows = found.agg(F.collect_list(F.struct("lex", "places")).alias("held")).filter(F.size("held") == F.col("n"))
        hit = lambda h: F.transform(h["places"], lambda p: F.struct(p.alias("pos"), h["lex"].alias("lex")))
        rows = rows.withColumn("hits", F.array_sort(F.flatten(F.transform("held", hit))))
        rows = rows.select("query_id", "chunk_id", F.round(covers(F.col("hits"), F.col("n")), DECIMALS).alias("native_rank"))
    return top_k(rows.select("query_id", "chunk_id", "native_rank"), [F.desc("native_rank"), F.asc("chunk_id")], k)
