"""Approximate nearest neighbours by multi-index hashing of learned rotated codes.

Vectors are centred, turned to their principal axes and rotated so that signs lose least (iterative
quantization, Gong and Lazebnik 2011); several rotations give a code of 256 bits. The code is cut into 8 substrings
of 32 bits, and every distinct code is entered once for each substring in a table dealt by substring and the first
bits of its value (Norouzi et al., 2012). By the pigeonhole principle a code within radius 8 (s + 1) - 1 of a query's has a
substring within s bits of the query's: a query goes to the parts whose first bits are within s of its own, is compared
with the values there, and the codes that the substring lets through are checked whole. A pair is reported by its
first such substring only.

Model and depth are fitted on a bounded sample: the depth is how many codes by Hamming distance have to be fetched to hold
nearly all true neighbours, carried on to the size of the table by how it grows within the sample. Each query's radius is
raised until it has fetched that many; what is still short is searched with a radius that excludes nothing. The nearest codes
fetched are then ranked by the Euclidean distance of the vectors themselves.

Where vectors have structure, small radii suffice and most parts are never met. Independent random vectors have none: their
nearest neighbours differ in two fifths of all bits, any substring of such a code is compatible with nearly every value, and the
probes pass most pairs on to the check of whole codes. Results are right either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 8000  # vectors that model and depth are fitted on: those with the smallest hashes of their ids
BITS, SUB = 256, 32
TABLES = BITS // SUB
COVER = 0.98
PART_ROWS = 1 << 16  # codes, and queries, that a part of a table holds at once, about


@dataclass
class Model:
    mean: np.ndarray
    turn: np.ndarray  # dimensions x bits
    depth: int  # codes to fetch for each query, in a table as large as the sample
    growth: float  # power of the table's size that the depth grows with
    near: np.ndarray  # Hamming distances between sample vectors, sorted

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of uint32 substrings."""
        bits = (x - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint32)

    def fetch(self, n_rows: int, n_sample: int) -> int:
        return int(np.ceil(self.depth * max(1.0, n_rows / n_sample) ** self.growth))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=-1))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def depth_of(x: np.ndarray, codes: np.ndarray, k: int) -> int:
    """How many codes by Hamming distance hold nearly all of the k nearest, over a few hundred of `x`."""
    ranks = []
    for i in range(0, len(x), max(1, len(x) // 400)):
        near, d = distances(x, x[i]), hamming(codes, codes[i])
        near[i], d[i] = np.inf, 1 << 30
        best = np.argpartition(near, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        ranks.append(np.searchsorted(np.sort(d), d[best], "right"))
    return int(np.quantile(np.concatenate(ranks), COVER, method="higher"))


def fit(x: np.ndarray, k: int = 10, bits: int = BITS, rounds: int = 30, seed: int = 9) -> Model:
    """Rotations by iterative quantization and the depth, from a sample of vectors."""
    rng, mean = np.random.default_rng(seed), x.mean(axis=0)
    z = x - mean
    _, axes = np.linalg.eigh(z.T @ z)
    axes = axes[:, ::-1]
    d, turns, left = x.shape[1], [], bits
    while left > 0:
        n = min(d, left)
        v = z @ axes[:, :n]
        r, _ = np.linalg.qr(rng.normal(size=(n, n)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        turns.append(axes[:, :n] @ r)
        left -= n
    model = Model(mean, np.concatenate(turns, axis=1), max(1, len(x)), 1.0, np.zeros(1, np.int64))
    if len(x) > 1:
        codes = model.codes(x)
        model.depth = depth_of(x, codes, k)
        model.near = np.sort(np.concatenate([hamming(codes, codes[i]) for i in range(0, len(x), max(1, len(x) // 400))]))
        if len(x) >= 400:
            part = depth_of(x[::4], codes[::4], k)
            model.growth = float(np.clip(np.log(model.depth / part) / np.log(4), 0.0, 1.0))
    return model


def masks(bits: int, reach: int) -> list[int]:
    """All numbers of `bits` bits with at most `reach` of them set."""
    return [sum(1 << b for b in c) for n in range(min(bits, reach) + 1) for c in combinations(range(bits), n)]


def probe(codes: np.ndarray, queries: np.ndarray, j: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, distance) of the pairs that substring j is the first to let through and that are within the radius.

    The values of substring j are the table's buckets: each query meets each value once, and the codes of those within reach.
    """
    values, bucket = np.unique(codes[:, j], return_inverse=True)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(len(values) + 1))
    out: list[tuple] = []
    for s in range(0, len(queries), 64):  # few queries at once, so that what they meet stays small
        q, v = np.nonzero(np.bitwise_count(values[None, :] ^ queries[s : s + 64, j, None]) <= reach)
        n = bounds[v + 1] - bounds[v]
        q = np.repeat(q, n) + s
        c = order[np.repeat(bounds[v] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        for t in range(0, len(q), 1 << 18):
            a, b = q[t : t + (1 << 18)], c[t : t + (1 << 18)]
            parts = np.bitwise_count(codes[b] ^ queries[a])
            d = parts.sum(axis=1, dtype=np.int32)
            keep = (d < TABLES * (reach + 1)) & (parts[:, :j] > reach).all(axis=1)
            out.append((a[keep], b[keep], d[keep]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3))


def best_of(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, ties to the smaller id."""
    order = np.lexsort((ids, score, q))
    first = np.concatenate([[0], np.flatnonzero(np.diff(q[order])) + 1]) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and x (array of doubles) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(finite & F.exists("x", lambda v: v != 0))


def _as_codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TABLES)


def tables(codes: DataFrame, first_bits: int) -> DataFrame:
    """j, part, code: each code once for each substring, part the first bits of the substring's value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _as_codes(b.column(0))
            for j in range(TABLES):
                part = (c[:, j].astype(np.int64) >> (SUB - first_bits)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), j, np.int32)), pa.array(part), b.column(0)], names=["j", "part", "code"])

    return codes.select("code").mapInArrow(run, "j int, part int, code binary")


def fetched(table: DataFrame, queries: DataFrame, first_bits: int, reach: int, salts: int) -> DataFrame:
    """query_id, code, d: the codes within radius TABLES (reach + 1) - 1 of each query (query_id, code)."""
    near = masks(first_bits, reach)
    asked = tables_of_queries(queries, first_bits).withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int"))
    asked = asked.select("query_id", "j", F.explode(F.transform(F.array(*[F.lit(m) for m in near]), lambda m: F.col("part").bitwiseXOR(m))).alias("part"), "salt", "code")
    held = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    schema = pa.schema([("query_id", pa.int64()), ("code", pa.binary()), ("d", pa.int32())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        codes, asked_codes = left.column("code"), _as_codes(right.column("code"))
        q, c, d = probe(_as_codes(codes), asked_codes, right.column("j")[0].as_py(), reach)
        return pa.table([right.column("query_id").take(pa.array(q)), codes.take(pa.array(c)), pa.array(d, pa.int32())], schema=schema)

    by = ["j", "part", "salt"]
    return held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, "query_id long, code binary, d int")


def tables_of_queries(queries: DataFrame, first_bits: int) -> DataFrame:
    """query_id, j, part, code of each query (query_id, code) for each substring."""
    bits = tables(queries.select("code").distinct(), first_bits)
    return queries.select("query_id", "code").join(bits, "code")


def nearest(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row where `is_query` (a condition on vec_id).

    Candidates are all rows with another vec_id whose vector is as long as the query's: between others there is no
    distance. Each length has an index of its own, so a table of many lengths takes a search for each. Vectors that are
    null, zero or hold null or non-finite components, and null ids, take no part. Rows that share an id are
    one candidate, at its nearest. Ties go to the smaller id; with fewer than k candidates all are returned; an
    empty table gives no rows. Of rows with equal vectors only the k + 1 smallest ids are kept, as no others can be
    among the k nearest of anything. Other columns are not looked at.
    """
    rows = usable(vectors, vec_id, vector)
    lengths = [r["n"] for r in rows.select(F.size("x").alias("n")).distinct().orderBy("n").collect()]
    found = [_nearest_alike(rows.filter(F.size("x") == n), is_query, k, part_rows) for n in lengths]
    if len(found) == 1:
        return found[0]
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for f in found:
        out = out.union(f)
    # an id may have rows of several lengths
    best = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_alike(rows: DataFrame, is_query, k: int, part_rows: int) -> DataFrame:
    """`nearest` of the rows (vec_id, x), whose vectors are all of one length."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = [r["x"] for r in rows.select(F.xxhash64("vec_id").alias("h"), "vec_id", "x").orderBy("h", "vec_id").limit(SAMPLE).collect()]
    model = fit(np.array(sample), k)
    turned = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(len(b), -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in turned.value.codes(x)], pa.binary())], names=["vec_id", "x", "code"])

    index = materialize(rows.mapInArrow(encode, "vec_id long, x array<double>, code binary"), "ann-index")
    queries = materialize(index.filter(is_query).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("x").alias("qx"), "code"), "ann-queries")
    alike = Window.partitionBy("code", "x").orderBy("vec_id")
    kept = index.distinct().withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= k + 1).drop("n")
    kept = materialize(kept, "ann-kept")
    codes = kept.groupBy("code").agg(F.count("*").alias("n"))
    n_rows, n_queries = index.select("vec_id").distinct().count(), queries.count()
    if n_rows < 2 or not n_queries:
        return empty
    wanted = min(max(model.fetch(n_rows, len(sample)), k + 1), n_rows)
    first_bits = min(SUB // 2, max(0, int(np.ceil(np.log2(max(1, n_rows / part_rows))))))
    table = materialize(tables(codes, first_bits), "ann-tables")
    # the least radius at which a query of the sample meets as many codes as are wanted, as a number of bits a substring
    radius = int(model.near[min(len(model.near) - 1, int(wanted / n_rows * len(model.near)))])
    reach = min(SUB, max(0, -(-(radius + 1) // TABLES) - 1))
    left, found = queries.select("query_id", "code"), []
    for s in dict.fromkeys((reach, min(SUB, reach + 2), SUB)):
        met = len(masks(first_bits, s)) / (1 << first_bits)
        salts = max(1, round(n_queries * met / part_rows))
        pairs = materialize(fetched(table, left, first_bits, s, salts), "ann-pairs")
        counted = pairs.join(codes, "code").groupBy("query_id", "d").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("query_id").orderBy("d")
        counted = counted.withColumn("before", F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # the distances that are needed to fetch as many as are wanted, the last with all its codes
        need = counted.filter(F.col("before") < wanted).groupBy("query_id").agg(F.max("d").alias("most"), F.sum("n").alias("n"))
        need = materialize(need.filter((F.col("n") >= wanted) | (F.lit(s) >= SUB)), "ann-need")
        found.append(pairs.join(need.select("query_id", "most"), "query_id").filter("d <= most").select("query_id", "code"))
        left = materialize(left.join(need.select("query_id"), "query_id", "left_anti"), "ann-left")
        if left.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, i = b.column(0).to_numpy(), b.column(1).to_numpy()
            x, y = (b.column(c).flatten().to_numpy().reshape(len(b), -1) for c in (2, 3))
            score = distances(x, y)
            order = np.lexsort((score, i, q))  # an id may occur several times: its nearest counts
            one = np.ones(len(q), bool)
            one[1:] = (np.diff(q[order]) != 0) | (np.diff(i[order]) != 0)
            order = order[one]
            top = order[best_of(q[order], i[order], score[order], k)]
            yield pa.RecordBatch.from_arrays([pa.array(c[top]) for c in (q, i, score)], names=["query_id", "vec_id", "score"])

    both = pairs.join(kept, "code").join(queries.select("query_id", "qx"), "query_id").filter("query_id <> vec_id")
    ranked = both.select("query_id", "vec_id", "x", "qx").mapInArrow(rank, "query_id long, vec_id long, score double")
    ranked = ranked.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every vector whose id is divisible by 100."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
