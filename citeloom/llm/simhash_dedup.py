"""SimHash near-duplicate groups with pivot distance tables.

Documents are reduced to 64-bit fingerprints and equal fingerprints to one row, so a group of copies of any
size is one row from there on. Two fingerprints link at 4 or fewer differing bits. They are brought together
by pigeonhole keys: the 64 bits are cut into 7 blocks; 4 differing bits touch at most 4 blocks, so any linked
pair agrees on some 3 of the 7, and each fingerprint is keyed under all 35 choices of 3 (about 27 bits each,
so that a key holds few unrelated fingerprints even among hundreds of millions). Every fingerprint has a table of
its Hamming distances to reference fingerprints, which are chosen from the data far from each other; by the
triangle inequality a pair whose tables differ by more than 4 in any coordinate cannot link and is discarded, and
the survivors are verified on their bits.

Cells of quantised pivot distances are no keys to join on: distances of unrelated fingerprints to any reference
crowd at 32 with a spread of 4, and a linked pair may lie in neighbouring cells, so a pivot splits the table about
in three and copies each row about two and a half times; 27 bits of selectivity would need billions of copies.

A key yields the edges of a spanning forest, never all pairs: a breadth-first search takes what links to the
frontier out of the unvisited rest, so a ball of near copies costs one pass. Components come from star
contraction on the edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, long_bits, map_text, materialize, packed

MAX_BITS = 4
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
N_PIVOTS = 24
PIVOT_SAMPLE = 4096  # fingerprints that the pivots are chosen from: those with the smallest hashes


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    words = (text or b"").lower().split()  # bytes.lower() changes A-Z only, bytes.split() splits at \x20 and \x09-\x0D
    if not words:
        return 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(width, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.array([digest(joined[s:e], seed) for s, e in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and fp (long with the fingerprint's bits). Null and wordless texts: 0."""
    return map_text(docs, text, [("fp", T.LongType())], lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)], keep)


def masks() -> list[int]:
    cuts = np.concatenate([[0], np.cumsum(BLOCKS)]).tolist()
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, len(BLOCKS) - MAX_BITS)]


def pivots(fps: np.ndarray, n: int = N_PIVOTS) -> np.ndarray:
    """At most `n` of the fingerprints, each the farthest from those before it, so that their distances say different things."""
    fps = np.unique(fps)
    chosen = fps[:1]
    near = np.full(len(fps), 65)
    while 0 < len(chosen) < min(n, len(fps)):
        near = np.minimum(near, np.bitwise_count(fps ^ chosen[-1]))
        chosen = np.append(chosen, fps[int(near.argmax())])
    return chosen


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference, uint8."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def linked(fps: np.ndarray, table: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Those of `others` that link to fingerprint i: pivot tables first, then the bits."""
    close = others[(np.abs(table[others] - table[i]) <= MAX_BITS).all(axis=1)]
    return close[np.bitwise_count(fps[close] ^ fps[i]) <= MAX_BITS]


def forest(fps: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what links within one key, by breadth-first search over the unvisited."""
    edges, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            i = frontier.pop()
            near = linked(fps, table, i, rest)
            if len(near):
                edges += [(i, j) for j in near.tolist()]
                frontier += near.tolist()
                rest = rest[~np.isin(rest, near, assume_unique=True)]
    return edges


def _edges(batches: Iterator[pa.RecordBatch], refs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Edges within each key of rows sorted by key; the last key of a batch waits for the next batch."""
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))

    def solve(combo: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((np.diff(combo) != 0) | (np.diff(part) != 0)) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(fp)]])
        sizes, u = ends - starts, fp.view(np.uint64)
        two = starts[sizes == 2]
        close = (np.abs(distance_table(u[two], refs) - distance_table(u[two + 1], refs)) <= MAX_BITS).all(axis=1)
        two = two[close]
        two = two[np.bitwise_count(u[two] ^ u[two + 1]) <= MAX_BITS]
        a, b = [fp[two]], [fp[two + 1]]
        for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
            found = forest(u[s:e], distance_table(u[s:e], refs))
            if found:
                i = np.array(found) + s
                a.append(fp[i[:, 0]])
                b.append(fp[i[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
        if not len(cols[2]):
            continue
        other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        held = tuple(c[cut:] for c in cols)
        if cut:
            yield solve(*(c[:cut] for c in cols))
    if len(held[2]):
        yield solve(*held)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) of a spanning forest per key over distinct fingerprints (column fp)."""
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(long_bits(m))).alias("part"), F.col("fp").alias("fp")) for i, m in enumerate(masks())])).alias("k"))
    keyed = keyed.select("k.combo", "k.part", "k.fp").repartition("combo", "part").sortWithinPartitions("combo", "part", "fp")
    sample = fps.select("fp").distinct().orderBy(F.xxhash64("fp"), "fp").limit(PIVOT_SAMPLE).collect()
    refs = fps.sparkSession.sparkContext.broadcast(pivots(np.array([r["fp"] for r in sample], np.int64).view(np.uint64)))
    return keyed.mapInArrow(lambda batches: _edges(batches, refs.value), "a long, b long").distinct()


def _grouped(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, th (xxhash64 of the text), fp, root (the group's fingerprint) and component_id of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    rows = materialize(fingerprints(rows, "text", ("doc_id", "th")), "simhash-docs")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-fps")
    nodes = components(links(distinct))
    member = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    member = materialize(member, "simhash-members")
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(member.join(lowest, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "th", "fp", "root", "component_id")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id: a row per document.

    component_id is the smallest doc_id of the documents reachable over links, itself included; null ids are
    kept as rows and never chosen (null only where all ids of a component are null). Repeated rows share a
    component. Null or wordless texts have fingerprint 0 and are linked like others. Other columns are not
    looked at; texts are read whole, however long; an empty table gives no rows.
    """
    return _grouped(docs, text, doc_id).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id; all columns stay, whatever their names.

    Where rows share that id, or all ids of a group are null, one row with the text of the smallest hash stays. Groups
    choose by themselves, so an id that is the smallest of several keeps a row in each. Null and wordless texts are
    one group; whole texts count; an empty table gives none.
    """
    groups = _grouped(docs, "text", "doc_id")
    keep = groups.filter("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("k")).select("k.*")
    rows = packed(docs, F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("th"))
    kept = rows.join(keep.hint("merge"), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])  # one plan at all sizes
    nameless = groups.filter("doc_id IS NULL AND component_id IS NULL").groupBy("root").agg(F.min("th").alias("th")).select("th")
    others = rows.filter("doc_id IS NULL").join(nameless, "th", "left_semi").dropDuplicates(["th"])
    return kept.select("row").unionByName(others.select("row")).select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    rows = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
