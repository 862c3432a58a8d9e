"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document is the set of its distinct word shingles, as 64-bit hashes; equal sets are one node, so copies cost one row.
Every set has a sketch of 240 coordinates: in each round every element throws a value into one bin of its own choice, all
values of a round being above those of the rounds before, until each bin holds one; after 240 rounds every element throws
into the bin of the round, so that any set fills every coordinate. A coordinate of two sets agrees with the probability of
their similarity, and the number that agree concentrates about it.

Candidates share one of 48 bands of 5 coordinates: a pair at similarity 0.8 shares none with a probability of 6e-9. Their
sketches are compared next: less than 0.64 of equal coordinates is over six standard deviations below 0.8. What is
left is verified on the full sets, which are made anew from the texts of the sets that have a candidate.

Groups of near copies of any size are taken apart without all pairs. First each set is verified against one hub, the
member of its bands that meets most others. Bands whose members lie in several components then tell each set its
candidates in other components, and all pairs told are verified in cells where a set travels once for many of its
pairs: only links between components can change the result. Where a set has more than eight candidates in a band, none is told:
the full sets come to the band, all intersections are counted there as matrix products, and only links that join components
leave the task, so the rows of a crowd, linked or alike but under the limit, grow with its sets and not with its pairs. New
links contract the graph of the components so far. A band of many sets is dealt in parts of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, map_text, materialize

BANDS, ROWS, WIDTH, SIMILARITY = 48, 5, 4, 80
SIZE = BANDS * ROWS
LEAST_EQUAL = 0.64  # of coordinates, for a pair to be verified
MOST_WORDS = 1 << 20  # word hashes that a task remembers
MOST = 8  # candidates of a set in a block that are told as pairs
PART = 4096  # sets of a band that are compared in one task
CELL_BYTES, CELL_PAIRS = 1 << 23, 1 << 18  # of sets, and pairs, that are verified in one group, about
DENSE, SLICE = 4, 1 << 21  # one set in how many holds an element of the matrix, and pairs that are counted at once

GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: a bijection whose values look independent."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < MOST_WORDS:
            self[word] = h
        return h


def shingle_set(text: bytes | None, words: Words, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of the whole sequence where there are fewer words than `width`."""
    found = (text or b"").lower().split()  # bytes.lower() changes A-Z only, bytes.split() splits at \x20 and \x09-\x0D
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * GOLDEN + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def sketch(h: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The coordinates of a set that is not empty: the round in the upper half, a value within it in the lower."""
    low, half = np.full(size, np.iinfo(np.uint64).max), np.uint64(32)
    done = 0
    while done < size and (low == np.iinfo(np.uint64).max).any():
        rounds = np.arange(done, min(size, done + max(1, 2048 // len(h))), dtype=np.uint64)  # rounds too many change nothing
        x = mixed(h[None, :] + (rounds[:, None] + np.uint64(1)) * GOLDEN)
        bins = ((x >> half) * np.uint64(size)) >> half
        value = rounds[:, None] << half | (x & np.uint64(0xFFFFFFFF))
        np.minimum.at(low, bins.ravel().astype(np.int64), value.ravel())
        done += len(rounds)
    empty = np.flatnonzero(low == np.iinfo(np.uint64).max).astype(np.uint64)
    for j in empty.tolist():  # of small sets only
        r = np.array([size + j], np.uint64)
        low[j] = ((r << half) | (mixed(h + (r + np.uint64(1)) * GOLDEN) & np.uint64(0xFFFFFFFF))).min()
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """A hash of each band's coordinates, with the band's number."""
    out = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = mixed(out * GOLDEN + column)
    return out.view(np.int64)


def _described(texts: list[bytes | None]) -> list:
    words, out = Words(), [[] for _ in range(4)]
    for t in texts:
        h = shingle_set(t, words)
        low = sketch(h) if len(h) else None
        keys = bands(low) if low is not None else None
        tail = (mixed(low) & np.uint64(255)).astype(np.uint8).tobytes() if low is not None else None
        for to, x in zip(out, (len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), keys, tail), strict=True):
            to.append(x)
    return out


def equal_share(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The share of coordinates that agree, from their last bytes, less what agrees by chance."""
    return ((one == others).mean(axis=-1) - 1 / 256) / (255 / 256)


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches are close enough to be verified."""
    tails = nodes.select("node", "tail")
    rows = pairs.join(tails.toDF("a", "a_tail"), "a").join(tails.toDF("b", "b_tail"), "b").select("a", "b", "a_tail", "b_tail")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, SIZE) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(equal_share(one, two) >= LEAST_EQUAL))

    return rows.mapInArrow(close, "a long, b long")


def linked(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY) -> bool:
    """Whether two sorted sets are similar enough, in whole numbers."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(long, short)
    at[at == len(long)] = 0
    both = int((long[at] == short).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link; the set of b travels to that of a, which is met once a pair within the task."""
    rows = pairs.join(sets.toDF("b", "b_set"), "b").join(sets.toDF("a", "a_set"), "a").select("a", "b", "a_set", "b_set")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = zip(b.column(2), b.column(3), strict=True)
            ok = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(check, "a long, b long")


def verified_in_cells(pairs: DataFrame, sets: DataFrame, cell_bytes: int = CELL_BYTES, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """The pairs (a, b) whose full sets link, where many pairs lie among few sets: a set travels once to a cell of pairs.

    Pairs are placed by the smallest node that their first one has a pair with, so that those of one crowd meet. A place of
    more than about `cell_bytes` of sets, or more than about `cell_pairs` pairs, is split in parts by node and its pairs go to
    cells of two parts; small places share a cell.
    """
    near = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("a", "y").groupBy("a").agg(F.least("a", F.min("y")).alias("place"))
    placed = pairs.select("a", "b").join(near, "a")
    lengths = sets.select("node", F.octet_length("set").alias("bytes"))
    ends = placed.select("place", F.explode(F.array("a", "b")).alias("node")).groupBy("place", "node").agg(F.count("*").alias("n"))
    sums = ends.join(lengths, "node").groupBy("place").agg(F.sum("bytes").alias("bytes"), (F.sum("n") / 2).alias("n"))
    parts = F.greatest(F.ceil(F.col("bytes") / cell_bytes), F.ceil(F.sqrt(F.col("n") / cell_pairs)), F.lit(1)).cast("long")
    sums = materialize(sums.select("place", "bytes", parts.alias("parts")), "minhash-places")
    small = sums.filter("parts = 1").agg(F.sum("bytes")).first()[0] or 0
    shared = -1 - F.pmod(F.xxhash64("place"), F.lit(max(1, -(-small // cell_bytes))))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    cell = F.struct(F.when(F.col("parts") > 1, F.col("place")).otherwise(shared).alias("at"), F.least(part("a"), part("b")).alias("i"), F.greatest(part("a"), part("b")).alias("j"))
    asked = materialize(placed.join(sums.select("place", "parts"), "place").select(cell.alias("cell"), "a", "b"), "minhash-asked")
    held = asked.select(F.col("cell").alias("of"), F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node")

    def check(asked: pa.Table, held: pa.Table) -> pa.Table:
        at = {n: np.frombuffer(s.as_buffer(), np.uint64) for n, s in zip(held.column("node").to_pylist(), held.column("set"), strict=True)}
        a, b = asked.column("a"), asked.column("b")
        ok = [x in at and y in at and linked(at[x], at[y]) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        return pa.table({"a": a, "b": b}).filter(pa.array(ok, pa.bool_()))

    return asked.groupBy("cell").cogroup(held.groupBy("of")).applyInArrow(check, "a long, b long")


def sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and its set (sorted 64-bit hashes, binary) for nodes (node, rep, digest), each from the text of one of its documents."""
    chosen = nodes.select("node", "digest", F.col("rep.th").alias("k"), F.col("rep.doc_id").alias("id"))
    texts = docs.join(chosen, (F.col("th") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "digest", "text")

    def make(texts: list[bytes | None]) -> list:
        words = Words()
        made = [shingle_set(t, words).tobytes() for t in texts]
        return [made, [hashlib.blake2b(m, digest_size=16).digest() for m in made]]

    made = map_text(texts, "text", [("set", T.BinaryType()), ("own", T.BinaryType())], make, ("node", "digest"))
    # texts whose hash agrees by chance are others; rows may repeat
    return made.filter("own = digest").groupBy("node").agg(F.first("set").alias("set"))


def _met(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """For rows (band, key, i, j, side, node, comp, held) sorted by block, `held` a sketch: its candidates between components.

    side 0 and 1 are compared with one another, side 2 within itself. A block in which a set has more than `most` of them
    names its band and key instead, once.
    """
    names, held = ["a", "b", "band", "key"], None

    def block(rows: pa.Table) -> pa.RecordBatch:
        few, many = facing(rows.column("side").to_numpy())
        node, comp = (rows.column(c).to_numpy() for c in ("node", "comp"))
        tail = np.frombuffer(b"".join(rows.column("held").to_pylist()), np.uint8).reshape(-1, SIZE)
        low, high = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x in few.tolist():
            other = many[comp[many] != comp[x]]
            to = node[other[equal_share(tail[x], tail[other]) >= LEAST_EQUAL]]
            if len(to) > most:
                crowd = [rows.column(c)[0].as_py() for c in ("band", "key")]
                return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array(crowd[:1], pa.int32()), pa.array(crowd[1:], pa.int64())], names=names)
            low.append(np.minimum(to, node[x]))
            high.append(np.maximum(to, node[x]))
        low, high = np.concatenate(low), np.concatenate(high)
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.nulls(len(low), pa.int32()), pa.nulls(len(low), pa.int64())], names=names)

    def blocks(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
        keys = [rows.column(c).to_numpy() for c in ("band", "key", "i", "j")]
        new = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
        cuts = [0, *new.tolist(), rows.num_rows]
        for s, e in zip(cuts, cuts[1:] if last else cuts[1:-1], strict=False):
            if (found := block(rows.slice(s, e - s))).num_rows:
                yield found
        if not last:
            yield rows.slice(cuts[-2])

    for b in batches:
        if b.num_rows:
            rows = pa.Table.from_batches([b])
            rows = rows if held is None else pa.concat_tables([held, rows])
            for made in blocks(rows, False):
                if isinstance(made, pa.Table):
                    held = made
                else:
                    yield made
    if held is not None:
        yield from blocks(held, True)


def facing(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that are compared with one another, the fewer first; all with all where the sides are 2."""
    if (side == 2).all():
        return (np.arange(len(side)),) * 2
    few, many = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return (few, many) if len(few) <= len(many) else (many, few)


def in_blocks(placed: DataFrame, held: DataFrame, part: int) -> DataFrame:
    """Rows (band, key, i, j, side, node, comp, held) that bring together the components of each band in `placed`
    (band, key, node, comp, bytes), with what `held` (node, held) has of them.

    The largest component of a band only meets the others, in parts of at most about `part` sets and `CELL_BYTES`.
    """
    sizes = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    of = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "bytes", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("comps")).filter("comps > 1")
    parts = lambda n, size: F.greatest(F.ceil(n / part), F.ceil(size / CELL_BYTES)).cast("int")
    mains, rests = parts(F.col("main.n"), F.col("main.bytes")), parts(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes"))
    of = of.select("band", "key", F.col("main.comp").alias("main"), mains.alias("mains"), rests.alias("rests"))
    rows = placed.join(of, ["band", "key"]).join(held, "node")
    at_main, at_rest = F.pmod(F.xxhash64("node"), F.col("mains")).cast("int"), F.pmod(F.xxhash64("node"), F.col("rests")).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["band", "key", "node", "comp", "held"]
    main, rest = rows.filter("comp = main"), rows.filter("comp <> main")
    dealt = main.select(*own, at_main.alias("i"), spread("rests").alias("j"), F.lit(0).alias("side"))
    dealt = dealt.union(rest.select(*own, spread("mains").alias("i"), at_rest.alias("j"), F.lit(1).alias("side")))
    # the others among themselves: parts below the diagonal; negative numbers keep them apart from the blocks above
    pairs = rest.select(*own, at_rest.alias("p"), spread("rests").alias("q"))
    side = F.when(F.col("p") == F.col("q"), 2).when(F.col("p") < F.col("q"), 0).otherwise(1)
    return dealt.union(pairs.select(*own, (-1 - F.least("p", "q")).alias("i"), (-1 - F.greatest("p", "q")).alias("j"), side.alias("side")))


def across(placed: DataFrame, nodes: DataFrame, most: int, part: int = PART) -> DataFrame:
    """Candidates (a, b) between components within the bands of `placed` (band, key, node, comp), at most `most` of a set in
    a block, and (band, key) of the bands that hold more, where a and b are null."""
    dealt = in_blocks(placed.withColumn("bytes", F.lit(SIZE)), nodes.select("node", F.col("tail").alias("held")), part)
    dealt = dealt.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "node")
    return dealt.mapInArrow(lambda b: _met(b, most), "a long, b long, band int, key long").distinct()


def common(sets: list[np.ndarray], few: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Sizes of intersections, slice by slice: rows of `few`, the first of `many` that they are counted with, a matrix.

    Elements that many of the sets hold are counted by a matrix product, those of a few sets by lookup. Where `few` is
    `many`, each pair is counted once.
    """
    lengths = np.array([len(s) for s in sets])
    _, x = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(x)
    dense = DENSE * held >= len(sets)
    column, of = np.cumsum(dense) - 1, np.repeat(np.arange(len(sets)), lengths)
    product = np.zeros((len(sets), int(dense.sum())), np.float32 if lengths.max() < 1 << 24 else np.float64)  # exact to 2 ** 24
    product[of[dense[x]], column[x[dense[x]]]] = 1
    rare = (held > 1) & ~dense
    of, x = of[rare[x]], x[rare[x]]
    starts = np.searchsorted(of, np.arange(len(sets) + 1))
    at = np.full(len(sets), -1)
    at[many] = np.arange(len(many))
    to, other = at[of[at[of] >= 0]], x[at[of] >= 0]
    has, step = np.zeros(len(held), bool), max(1, SLICE // len(many))
    for s in range(0, len(few), step):
        rows, first = few[s : s + step], s if few is many else 0
        both = (product[rows] @ product[many[first:]].T).astype(np.int64)
        for k, r in enumerate(rows.tolist()):
            own = x[starts[r] : starts[r + 1]]
            if len(own):
                has[own] = True
                both[k] += np.bincount(to[has[other]], minlength=len(many))[first:]
                has[own] = False
        yield rows, first, both


def _crowd_links(rows: pa.Table) -> pa.Table:
    """Links (a, b) that join the components of a block (side, node, comp, held), `held` full sets; no more than join them."""
    few, many = facing(rows.column("side").to_numpy())
    node, comp = rows.column("node").to_numpy(), rows.column("comp").to_numpy().copy()
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("held")]
    size, a, b = np.array([len(s) for s in sets]), [], []
    for chosen, first, both in common(sets, few, many) if len(few) else ():
        other = many[first:]
        near = 100 * both >= SIMILARITY * (size[chosen][:, None] + size[other] - both)
        for x, close in zip(chosen.tolist(), near, strict=True):
            to = other[close & (comp[other] != comp[x])]
            joined, at = np.unique(comp[to], return_index=True)
            if len(joined):
                a += [node[x]] * len(joined)
                b += node[to[at]].tolist()
                comp[np.isin(comp, joined)] = comp[x]
        if (comp == comp[0]).all():
            break
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def linked_crowds(placed: DataFrame, sets: DataFrame, part: int = PART) -> DataFrame:
    """Links (a, b) that join the components within each band of `placed` (band, key, node, comp) as all links of its sets would.

    The sets come to the block that their sketches came to; pairs are counted there and are never rows.
    """
    placed = placed.join(sets.select("node", F.octet_length("set").alias("bytes")), "node")
    dealt = in_blocks(placed, sets.select("node", F.col("set").alias("held")), part)
    return dealt.groupBy("band", "key", "i", "j").applyInArrow(_crowd_links, "a long, b long")


def near_sets(nodes: DataFrame, docs: DataFrame, part: int = PART) -> DataFrame:
    """node and root of every node that links to another."""
    members = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    met = members.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(members.join(met, ["band", "key"]), "minhash-members")
    # the hub of a set is the member of its bands that meets most others
    weight = members.groupBy("node").agg(F.sum("n").alias("w"))
    rank = F.struct(F.col("w"), (-F.col("node")).alias("minus"))
    weighed = members.select("band", "key", "node").join(weight, "node")
    hubs = weighed.groupBy("band", "key").agg(F.max(rank).alias("hub"))
    star = members.select("band", "key", "node").join(hubs, ["band", "key"]).groupBy("node").agg(F.max("hub").alias("hub"))
    pairs = star.select(F.least("node", -F.col("hub.minus")).alias("a"), F.greatest("node", -F.col("hub.minus")).alias("b")).filter("a <> b").distinct()
    tried = materialize(likely(pairs, nodes), "minhash-tried")
    described = nodes.select("node", "rep", "digest")
    sets = materialize(sets_of(described.join(ends_of(tried), "node", "left_semi"), docs), "minhash-sets")
    roots = materialize(components(materialize(verified(tried, sets), "minhash-links")), "minhash-roots")
    dealt = materialize(across(in_components(members, roots), nodes, MOST, part), "minhash-dealt")
    told = materialize(dealt.filter("a is not null").select("a", "b").join(tried, ["a", "b"], "left_anti"), "minhash-told")
    crowds = materialize(members.select("band", "key", "node").join(dealt.filter("a is null").select("band", "key"), ["band", "key"], "left_semi"), "minhash-crowds")
    wanted = ends_of(told).union(crowds.select("node")).distinct().join(sets.select("node"), "node", "left_anti")
    sets = sets.union(materialize(sets_of(described.join(wanted, "node", "left_semi"), docs), "minhash-sets"))
    for links in (lambda: verified_in_cells(told, sets), lambda: linked_crowds(in_components(crowds, roots), sets, part)):
        found = materialize(links(), "minhash-links")
        if not found.isEmpty():
            roots = materialize(contracted(roots, found), "minhash-roots")
    return roots


def ends_of(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b), each once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def in_components(members: DataFrame, roots: DataFrame) -> DataFrame:
    """band, key, node and comp of `members`, the component of a node without a link being its own."""
    return members.join(roots, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("comp"))


def contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node and root after `links` (a, b) are added to the components `roots`: only the graph of roots is contracted."""
    ends = links.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    moved = materialize(components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "minhash-moved")
    old = roots.join(moved.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return old.union(moved.join(roots.select("node"), "node", "left_anti"))


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per document.

    component_id is the smallest doc_id of the documents reachable over links, itself included. Null and wordless texts have no
    shingles and link with nothing. Null ids are kept as rows and never chosen (null only where all ids of a component
    are null; such rows are kept, other rows without an id are not). Rows that share an id are linked by their own
    texts. Texts are read whole, other columns are not looked at; an empty table gives no rows.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    L, B = T.LongType(), T.BinaryType()
    fields = [("n_shingles", L), ("digest", B), ("keys", T.ArrayType(L)), ("tail", B)]
    rows = materialize(map_text(docs, "text", fields, _described, ("doc_id", "th")), "minhash-docs")
    nodes = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "th")).alias("rep"), F.min("tail").alias("tail"), F.min("keys").alias("keys"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    roots = near_sets(nodes, docs, part)
    member = nodes.select("node", "digest", "low").join(roots, "node", "left").select("digest", "low", F.coalesce("root", "node").alias("root"))
    member = materialize(member, "minhash-groups")
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = member.join(lowest, "root").select("digest", "component_id", F.lit(True).alias("has"))
    out = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("has"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and near-duplicate group of every document."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')))) END AS sh FROM d),
g AS (SELECT sh, min(doc_id) AS low, len(sh) AS n, row_number() OVER (ORDER BY min(doc_id)) AS g FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT g, n, unnest(sh) AS x FROM g),
p AS (SELECT a.g AS a, b.g AS b, a.n AS na, b.n AS nb, count(*) AS m FROM e a JOIN e b ON a.x = b.x AND a.g < b.g GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * m >= 80 * (na + nb - m)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT g AS a, g AS b FROM g UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT r.a AS g, min(g.low) AS low FROM r JOIN g ON g.g = r.b GROUP BY r.a)
SELECT doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.low, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(c.low, doc_id) AS kept
FROM s LEFT JOIN g ON s.sh = g.sh LEFT JOIN c USING (g)
"""
