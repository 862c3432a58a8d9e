"""Vector and full-text branches, fusion and branch observations, for a batch of queries.

Queries are the stated query set: frames with a row per query. Branches join them to chunks on the workspace,
so isolation holds below every rank and limit. Query frames are broadcast only as far as Spark's own size
check allows (no hints); beyond that the joins shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import RRF_CONSTANT
from ..functions import text as tx
from ..functions import vectors as vx
from . import postings as po

SALTS = 16
DECIMALS = 9  # similarities are rounded before ranking, so that last bits never swap ties
MARGIN = 2e-9  # more than rounding to `DECIMALS` and a matrix product's order of addition move a similarity
SLICE = 1024  # chunks that a task searches at a time
CELLS = 1 << 22  # of a matrix product at a time


def top_k(rows: DataFrame, order: list[Column], k: int, rank: str = "branch_rank", by: str = "query_id") -> DataFrame:
    """The first k of each query; planned as a group limit before and after the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(rank) <= k)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten(), np.float64) for c in vectors.chunks]).reshape(len(vectors), -1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows added from left to right as `vx.dot` adds them, which gives the same last bits."""
    each, total = a * b, np.zeros(len(a))
    for d in range(each.shape[1]):
        total += each[:, d]
    return total


def _best_of(rows: np.ndarray, k: int) -> np.ndarray:
    """Which values are among the first k of their row, or so near that exact values have to tell; -inf never is."""
    least = np.partition(rows, -k, axis=1)[:, -k, None] if rows.shape[1] > k else -np.inf
    return (rows >= least - MARGIN) & (rows > -np.inf)


def _candidates(k: int, ties: list[str], floor: float | None, names: list[str], apart: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one block of queries and one part of chunks the pairs that can be among a query's first k, with exact similarities.

    A matrix product in blocks of `CELLS` finds them, `MARGIN` above what it and the later rounding can be off; only those are computed
    as `vx.cosine` does. With a `floor`, the first k on either side of it. Of equal vectors the first k + 1 by `ties` are enough. Vectors
    whose norm is no plain number meet all others. `apart`: a query does not meet the chunk of its own id.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[(t, "ascending") for t in ties], null_placement="at_start"))
        if right.num_rows > k:
            same = pd.factorize(np.array([r.tobytes() for r in _matrix(right["chunk_vector"])], object))[0]
            right = right.filter(pa.array((pd.Series(same).groupby(same).cumcount() <= k).to_numpy()))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if left.num_rows and right.num_rows:
            with np.errstate(all="ignore"):
                q, c = _matrix(left["query_vector"]), _matrix(right["chunk_vector"])
                nq, nc = np.sqrt(_dots(q, q)), np.sqrt(_dots(c, c))
                odd_q, odd_c = (~((n > 1e-100) & (n < 1e100)) for n in (nq, nc))
                uq, uc = (np.where(odd[:, None], 0.0, x / n[:, None]) for x, n, odd in ((q, nq, odd_q), (c, nc, odd_c)))
                own = pd.Index(left["query_id"].to_pandas()).get_indexer(right["chunk_id"].to_pandas()) if apart else np.full(len(c), -1)
                step = max(1, CELLS // len(c))
                for at in range(0, len(q), step):
                    near = uq[at : at + step] @ uc.T
                    mine = np.flatnonzero((own >= at) & (own < at + len(near)))
                    odd = odd_q[at : at + step, None] | odd_c
                    near[odd], near[own[mine] - at, mine] = -np.inf, -np.inf
                    if floor is None:
                        held = _best_of(near, k)
                    else:
                        above, below = near >= floor + MARGIN, near < floor - MARGIN
                        held = _best_of(np.where(above, near, -np.inf), k) | _best_of(np.where(below, near, -np.inf), k) | ~(above | below)
                    size = nq[at : at + step, None] * nc
                    held |= odd & ((size > 0) | np.isnan(size))
                    held[own[mine] - at, mine] = False
                    i, j = np.nonzero(held)
                    for s in range(0, len(i), CELLS // 64):
                        x, y = i[s : s + CELLS // 64] + at, j[s : s + CELLS // 64]
                        by = nq[x] * nc[y]
                        score, some = _dots(q[x], c[y]) / by, (by > 0) | np.isnan(by)
                        found.append((x[some], y[some], score[some]))
        x, y, score = (np.concatenate(p) for p in zip(*found, strict=True))
        sides = left.take(pa.array(x)), right.take(pa.array(y))
        return pa.table([pa.array(score) if n == "similarity" else sides[n not in left.column_names].column(n) for n in names], names=names)

    return run


def _ranked(queries: DataFrame, chunks: DataFrame, by: list[str], k: int, ties: list[str], floor: float | None = None, apart: bool = False) -> DataFrame:
    """query_id, columns of both sides, similarity, branch_rank: queries and chunks meet where `by` is equal, a group of each in a task at a time."""
    sides = []
    for rows, vector in ((queries, "query_vector"), (chunks, "chunk_vector")):
        v = F.col(vector) if rows.schema[vector].dataType.elementType.typeName() in ("float", "double") else vx.doubles(F.col(vector))
        whole = rows.withColumn(vector, v).withColumn("size", F.size(vector)).filter((F.col("size") > 0) & F.forall(vector, lambda x: x.isNotNull()))
        sides.append(whole.dropna(subset=by))
    home = [b for b in by if b not in ("block", "part")]
    q, c = sides[0].select(*by, "size", "query_id", "query_vector"), sides[1].select(*by, "size", *dict.fromkeys(["chunk_id", *ties]), "chunk_vector")
    names = ["query_id", *home, *dict.fromkeys(["chunk_id", *ties]), "similarity"]
    schema = StructType([StructField("similarity", DoubleType()) if n == "similarity" else (q if n in q.columns else c).schema[n] for n in names])
    rows = q.groupBy(*by, "size").cogroup(c.groupBy(*by, "size")).applyInArrow(_candidates(k, ties, floor, names, apart), schema)
    rows = rows.withColumn("similarity", F.round("similarity", DECIMALS))
    of = ["query_id"]
    if floor is not None:
        rows, of = rows.withColumn("eligible", F.col("similarity") >= floor), ["query_id", "eligible"]
    order = Window.partitionBy(*of).orderBy(F.desc("similarity"), *[F.asc(t) for t in ties])
    return rows.withColumn("branch_rank", F.row_number().over(order)).filter(F.col("branch_rank") <= k)


def nearest_blocks(queries: DataFrame, chunks: DataFrame, k: int, block: int = 4096, part: int = 16_384) -> DataFrame:
    """The k nearest chunks, other than itself, of each of a stated set of queries, against all chunks in blocks.

    Queries go in blocks of about `block`, chunks in parts of about `part` (`SALTS` of them at least); every block meets every part under
    a key of its own, so a task holds one block and one part at a time and passes on the pairs that can be among the first k.
    All pairs are tried, so the work grows with the square of the vectors, as matrix products.
    """
    blocks, parts = max(1, -(-queries.count() // block)), max(SALTS, -(-chunks.count() // part))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("part", every(parts))
    c = chunks.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts))).withColumn("block", every(blocks))
    return _ranked(q, c, ["block", "part"], k, ["chunk_id"], apart=True)


def vector_sides(queries: DataFrame, chunks: DataFrame, k: int, min_similarity: float, on: list[str], ties: list[str] | None = None) -> DataFrame:
    """The first k of each query at or above the threshold (`eligible`) and the first k below it, from one pass over the pairs.

    Similarities are computed once for both sides. Chunks are dealt to `SALTS` parts by their id, each part meets the queries under
    a key of its own and passes on the pairs that can be among the first k: a workspace with a third of all chunks is many tasks.
    """
    q = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    c = chunks.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)))
    return _ranked(q, c, [*on, "part"], k, ties or ["chunk_id"], min_similarity)


def vector_branch(queries: DataFrame, chunks: DataFrame, k: int, min_similarity: float, on: list[str], ties: list[str] | None = None) -> DataFrame:
    """Exact nearest neighbours at or above the threshold."""
    return vector_sides(queries, chunks, k, min_similarity, on, ties).filter("eligible").drop("eligible")


def vector_below(queries: DataFrame, chunks: DataFrame, k: int, min_similarity: float, on: list[str], ties: list[str] | None = None) -> DataFrame:
    """The nearest of those below the threshold, which observations report."""
    return vector_sides(queries, chunks, k, min_similarity, on, ties).filter("NOT eligible").drop("eligible")


def query_lexemes(queries: DataFrame) -> DataFrame:
    """query columns with lexemes; queries without any match nothing and are dropped here."""
    return queries.withColumn("lexemes", tx.lexemes(tx.full_fold(F.col("question")), folded=True)).filter(F.size("lexemes") > 0)


def fts_matches(queries: DataFrame, chunks: DataFrame, every: bool, on: list[str]) -> DataFrame:
    """query_id, chunk_id and native_rank (occurrences of query lexemes) of the chunks with any or every lexeme.

    Tokens of the chunk are matched to the queries' lexemes before anything is counted, so only occurrences of
    query lexemes are shuffled, combined per query and chunk.
    """
    wanted = query_lexemes(queries).select("query_id", *on, F.size("lexemes").alias("n"), F.explode("lexemes").alias("token"))
    said = chunks.select("chunk_id", *on, F.explode(tx.tokens(F.col("content"))).alias("token"))
    rows = said.join(wanted, [*on, "token"]).groupBy("query_id", "chunk_id", "n").agg(F.count("*").alias("native_rank"), F.count_distinct("token").alias("found"))
    rows = rows.filter(F.col("found") == F.col("n")) if every else rows
    return rows.select("query_id", "chunk_id", "native_rank")


def covers(hits: Column, n: Column) -> Column:
    """Cover density of `hits` (pos, lex: sorted by pos, all `n` lexemes among them).

    A cover is a shortest stretch with every lexeme; each adds 0.1 over 1 plus the words in it that are no hits. One
    pass: the place of each lexeme's last hit is kept, the least of them begins the cover that ends at this hit, and
    it counts if it begins after the cover before.
    """
    start = F.struct(F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(-1)).alias("last"), F.lit(0).alias("k"), F.lit(0).alias("floor"), F.lit(0.0).alias("rank"))

    def step(s: Column, h: Column) -> Column:
        last = F.transform(s["last"], lambda v, i: F.when(i == h["lex"], s["k"]).otherwise(v))
        begin = F.array_min(last)
        noise = h["pos"] - F.get(hits, begin)["pos"] - (s["k"] - begin)
        return F.struct(
            last.alias("last"),
            (s["k"] + 1).alias("k"),
            F.when(begin >= s["floor"], begin + 1).otherwise(s["floor"]).alias("floor"),
            (s["rank"] + F.when(begin >= s["floor"], F.lit(0.1) / (1 + noise)).otherwise(0.0)).alias("rank"),
        )

    return F.aggregate(hits, start, step, lambda s: s["rank"])


def cover_matches(queries: DataFrame, chunks: DataFrame, on: list[str]) -> DataFrame:
    """query_id, chunk_id and native_rank (cover density) of the chunks with every lexeme.

    Matches are found by counts first; positions are gathered only for the pairs that have every lexeme.
    """
    held = fts_matches(queries, chunks, True, on).select("query_id", "chunk_id")
    wanted = query_lexemes(queries).select("query_id", F.size("lexemes").alias("n"), F.posexplode("lexemes").alias("lex", "token"))
    said = chunks.join(held.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.posexplode(tx.tokens(F.col("content"))).alias("pos", "token"))
    hits = held.join(wanted, "query_id").join(said, ["chunk_id", "token"]).groupBy("query_id", "chunk_id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "lex"))).alias("hits"))
    return hits.select("query_id", "chunk_id", F.round(covers(F.col("hits"), F.col("n")), DECIMALS).alias("native_rank"))


def lexeme_rows(queries: DataFrame) -> DataFrame:
    """query_id, n, lex, token of the queries' lexemes."""
    return query_lexemes(queries).select("query_id", F.size("lexemes").alias("n"), F.posexplode("lexemes").alias("lex", "token"))


def answer_schema(query: StructField, chunk: StructField, every: bool) -> StructType:
    """Of what `postings` passes on: the first k with their native rank, or all matches with their hits."""
    end = "n int, hits array<struct<pos:int,lex:int>>" if every else "native_rank long"
    return StructType([query, StructField("chunk_id", chunk.dataType), *StructType.fromDDL(end)])


def ranked_answers(rows: DataFrame, k: int, every: bool) -> DataFrame:
    rows = rows.select("query_id", "chunk_id", F.round(covers(F.col("hits"), F.col("n")), DECIMALS).alias("native_rank")) if every else rows
    return top_k(rows, [F.desc("native_rank"), F.asc("chunk_id")], k)


def fts_branch(queries: DataFrame, chunks: DataFrame, k: int, every: bool, on: list[str], ties: list[str] | None = None) -> DataFrame:
    """Full-text top k: OR (every=False) of the query's lexemes by occurrences, or AND by cover density.

    Under OR each occurrence is a cover of its own, so occurrences rank as cover density does. Questions over all chunks whose lexemes
    are few (`postings.MOST_WANTED`) are answered where the chunks are read, slice by slice; others by joins.
    """
    wanted = None if on or ties else po.Wanted.of(lexeme_rows(queries))
    if wanted:
        kind = answer_schema(queries.schema["query_id"], chunks.schema["chunk_id"], every)
        told = chunks.select("chunk_id", tx.tokens(F.col("content")).alias("tokens"))
        return ranked_answers(told.mapInArrow(po.from_texts(wanted, None if every else k, SLICE, kind), kind), k, every)
    rows = cover_matches(queries, chunks, on) if every else fts_matches(queries, chunks, False, on)
    if ties:
        rows = rows.join(chunks.select("chunk_id", *ties), "chunk_id")
    return top_k(rows, [F.desc("native_rank"), *[F.asc(t) for t in [*(ties or []), "chunk_id"]]], k)


def fuse(vector: DataFrame, fts: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two branches: query_id, chunk_id, both ranks, fusion_score, fused_rank.

    v1 breaks ties by chunk_id; v2 by `ties` (source key, ordinal) first, which both branches carry.
    """
    ties = ties or []
    v = vector.select("query_id", "chunk_id", *ties, F.col("branch_rank").alias("vector_rank"), "similarity")
    f = fts.select("query_id", "chunk_id", *ties, F.col("branch_rank").alias("fts_rank"), "native_rank")
    both = v.join(f, ["query_id", "chunk_id", *ties], "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_CONSTANT + F.col(c)), F.lit(0.0))
    both = both.withColumn("fusion_score", F.round(part("vector_rank") + part("fts_rank"), 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), *[F.asc(t) for t in [*ties, "chunk_id"]])
    return both.withColumn("fused_rank", F.row_number().over(order))


def observations(vector: DataFrame, below: DataFrame, fts: DataFrame, matches: DataFrame) -> DataFrame:
    """What each branch says of each candidate: query_id, chunk_id, branch, status, branch_rank.

    Vector: ELIGIBLE (ranked), BELOW_THRESHOLD, or NO_CONTRIBUTION (found by full text only). Full text: ELIGIBLE
    (ranked), NO_CONTRIBUTION (matches but is not ranked) or INELIGIBLE (found by the vector branch, no match).
    """
    key = ["query_id", "chunk_id"]
    seen = lambda rows, branch, status: rows.select(*key, F.lit(branch).alias("branch"), F.lit(status).alias("status"), F.col("branch_rank").cast("int").alias("branch_rank"))
    unranked = F.lit(None).cast("int")
    no_vector = fts.select(*key).join(vector.select(*key).union(below.select(*key)), key, "left_anti")
    no_fts = vector.select(*key).join(fts.select(*key), key, "left_anti").join(matches.select(*key, F.lit(True).alias("m")), key, "left")
    return (
        seen(vector, "vector", "ELIGIBLE")
        .union(seen(below.withColumn("branch_rank", unranked), "vector", "BELOW_THRESHOLD"))
        .union(seen(no_vector.withColumn("branch_rank", unranked), "vector", "NO_CONTRIBUTION"))
        .union(seen(fts, "fts", "ELIGIBLE"))
        .union(no_fts.select(*key, F.lit("fts"), F.when(F.col("m"), "NO_CONTRIBUTION").otherwise("INELIGIBLE"), unranked))
    )


def gated(queries: DataFrame, cutover: DataFrame) -> DataFrame:
    """Queries of workspaces whose cutover is completed."""
    return queries.join(cutover.filter(F.col("state") == "completed").select("workspace_id"), "workspace_id", "left_semi")


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int = 3, min_chars: int = 4) -> DataFrame:
    """The old keyword retriever: chunks with any question word of `min_chars` or more characters, the first k by id."""
    q = queries.select("query_id", F.explode(F.array_distinct(F.filter(tx.tokens(F.col("question")), lambda t: F.length(t) >= min_chars))).alias("token"))
    c = chunks.select("chunk_id", F.explode(F.array_distinct(tx.tokens(F.col("content")))).alias("token"))
    return top_k(c.join(q, "token").select("query_id", "chunk_id").distinct(), [F.asc("chunk_id")], k)
