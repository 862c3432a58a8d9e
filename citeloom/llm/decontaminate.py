"""Benchmark decontamination: each item's word trigrams give the stretches to verify, Sellers' edit distance the leaks.

A leak is a stretch of a document within word edit distance 20 % of a benchmark item (case and punctuation
aside). By the q-gram lemma a window within k edits of an item of L words, itself at most L + k words, shares at
least L - 2 - 3k of its word trigrams, wherever the edits lie; that is at least one for every L and k here. An
index from trigrams to items counts them for each item by itself, and every stretch that holds enough of them is
verified by Sellers' algorithm on the words themselves. Nothing is sampled, so no leak is lost; random-walk
embeddings with LSH keys, which stood here before, missed items edited at the front.

The benchmark is the stated query set; it is taken in blocks of about `block_items` items and `block_words` words at
most, each block a pass over the documents, so what the driver and a task hold is bounded, but for an item longer than that.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import explode_text, materialize, packed

#: ASCII other than letters and digits separates words; A-Z are folded here, the rest by lower() before.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
PAIRS = 1 << 22  # places times items that a task expands at once
MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def codes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def edits_allowed(n_words: int) -> int:
    """20 % of an item's words; items under 8 words must match exactly."""
    return n_words // 5 if n_words >= 8 else 0


def trigrams(codes: np.ndarray) -> np.ndarray:
    if len(codes) < 3:
        return np.empty(0, np.uint64)
    h = ((codes[:-2] * MULT) ^ codes[1:-1]) * MULT
    return ((h ^ (h >> np.uint64(31))) ^ codes[2:]) * MULT


def edited(codes: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """`codes` after k random substitutions, insertions and deletions."""
    out = codes.tolist()
    for kind in rng.integers(0, 3, k):
        at = int(rng.integers(0, len(out)))
        if kind == 0:
            out[at] = int(rng.integers(1, 1 << 32))
        elif kind == 1:
            out.insert(at, int(rng.integers(1, 1 << 32)))
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.uint64)


class Block:
    """The tables of one block of items that tasks need."""

    def __init__(self, items: list[tuple[int, bytes]]):
        found = [(i, w) for i, t in items if len(w := words_of(t)) >= 3]
        self.ids, self.words = [i for i, _ in found], [w for _, w in found]
        codes = [codes_of(w) for w in self.words]
        sizes, edits = np.array([len(c) for c in codes], np.int64), np.array([edits_allowed(len(c)) for c in codes], np.int64)
        self.longest = sizes + edits  # words of the longest window of each item
        self.least_hits = sizes - 2 - 3 * edits  # at least 1 at all sizes
        self.grams = np.unique(np.concatenate([trigrams(c) for c in codes])) if codes else np.empty(0, np.uint64)
        # which items hold a trigram: sorted pairs, trigram's number * items + item
        held = [np.searchsorted(self.grams, np.unique(trigrams(c))) * len(codes) + x for x, c in enumerate(codes)]
        self.pairs = np.sort(np.concatenate(held)) if codes else np.empty(0, np.int64)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.grams >> np.uint64(42)] = True


def sellers(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each end in `text` the least edit distance of `item` to a stretch that ends there."""
    n = len(text)
    ramp = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, w in enumerate(item, 1):
        new = np.minimum(np.concatenate([[i], row[:-1] + (text != w)]), row + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return row[1:]


def best_stretch(item: list[bytes], words: list[bytes], lo: int, hi: int, k: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the closest stretch of words[lo:hi], the leftmost of the closest, if within k."""
    numbers: dict[bytes, int] = {}
    a = np.array([numbers.setdefault(w, len(numbers)) for w in item])
    b = np.array([numbers.get(w, -1) for w in words[lo:hi]])
    if not len(b):
        return None
    d = sellers(a, b)
    end = int(d.argmin())
    if d[end] > k:
        return None
    # the stretch itself: the same from its end backwards, where the distance of a prefix counts
    back = b[: end + 1][::-1][: len(a) + k]
    row = np.arange(len(back) + 1)
    for i, w in enumerate(a[::-1], 1):
        new = np.minimum(np.concatenate([[i], row[:-1] + (back != w)]), np.concatenate([[i], row[1:] + 1]))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(d[end]), lo + end + 1 - int(row.argmin()), lo + end + 1


def stretches(item: list[bytes], words: list[bytes], lo: int, hi: int, k: int) -> list[tuple[int, int, int]]:
    """(distance, start, end) of the stretches of words[lo:hi] within k of the item, the closest where several overlap."""
    out, left = [], [(lo, hi)]
    while left:
        lo, hi = left.pop()
        if hi - lo >= len(item) - k and (best := best_stretch(item, words, lo, hi, k)):
            out.append(best)
            left += [(lo, best[1]), (best[2], hi)]
    return sorted(out, key=lambda s: s[1])


def regions(gram_at: np.ndarray, gram: np.ndarray, bounds: np.ndarray, block: Block, first: int, last: int) -> list[tuple[int, int, int, int]]:
    """(document, item, first word, word after the last) of the stretches that hold all windows with enough trigrams of an item.

    `gram_at` and `gram`: places and numbers of the items' trigrams; of the items those from `first` to `last` - 1.
    """
    n = len(block.ids)
    lo, hi = np.searchsorted(block.pairs, gram * n + first), np.searchsorted(block.pairs, gram * n + last)
    count = hi - lo
    item = block.pairs[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())] % n
    at = np.repeat(gram_at, count)
    order = np.argsort(item, kind="stable")  # places rise within an item
    item, at = item[order], at[order]
    doc = np.searchsorted(bounds, at, "right") - 1
    i = np.arange(len(item))
    j = i + block.least_hits[item] - 1
    i, j = i[j < len(item)], j[j < len(item)]
    kept = (item[i] == item[j]) & (doc[i] == doc[j]) & (at[j] - at[i] <= block.longest[item[i]] - 3)
    i, j = i[kept], j[kept]
    item, doc = item[i], doc[i]
    lo = np.maximum(at[j] + 3 - block.longest[item], bounds[doc])
    hi = np.minimum(at[i] + block.longest[item], bounds[doc + 1])
    if not len(item):
        return []
    new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] >= hi[:-1])]))
    last = np.append(new[1:], len(item)) - 1
    return sorted(zip(doc[new].tolist(), item[new].tolist(), (lo[new] - bounds[doc[new]]).tolist(), (hi[last] - bounds[doc[new]]).tolist(), strict=True))


def find_leaks(docs: list[tuple[int, bytes]], block: Block) -> list[tuple[int, int, int, int, int]]:
    """(document's place in the list, item, distance, first word, word after the last)."""
    words = [words_of(t) for t in docs]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    grams = trigrams(codes_of([w for x in words for w in x]))
    at = np.flatnonzero(block.bits[grams >> np.uint64(42)])
    at = at[np.isin(grams[at], block.grams)]
    gram, n = np.searchsorted(block.grams, grams[at]), len(block.ids)
    pairs = np.searchsorted(block.pairs, (gram + 1) * n) - np.searchsorted(block.pairs, gram * n)
    # whole documents of about PAIRS pairs at a time; if one document has more, a part of the items at a time
    doc = np.searchsorted(bounds, at, "right") - 1
    before = (np.cumsum(pairs) - pairs)[np.searchsorted(doc, doc)]
    out = []
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(before // PAIRS)) + 1):
        step = max(1, n * PAIRS // max(PAIRS, int(pairs[part].sum())))
        for x0 in range(0, n, step):
            for d, x, lo, hi in regions(at[part], gram[part], bounds, block, x0, min(n, x0 + step)):
                out += [(d, block.ids[x], *s) for s in stretches(block.words[x], words[d], lo, hi, edits_allowed(len(block.words[x])))]
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = 20_000, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, distance, start, end (words): the leaks of `benchmark` (item_id, text) in `docs` (doc_id, text).

    A row for each stretch of a document that is within 20 % word edits of an item; the closest where several
    overlap. Null texts have none, nor have items of fewer than 3 words, which are no evidence of anything.
    Repeated items are reported each, repeated documents too; null ids stay null. Other columns are not looked
    at; whole texts are read, however long; words are separated by all ASCII but letters and digits, other marks are part of
    words. An empty table on either side gives no rows.
    """
    texts = docs.select("doc_id", F.lower("text").cast("binary").alias("t")).filter("t IS NOT NULL")
    items = benchmark.select("item_id", F.lower("text").cast("binary").alias("t")).filter("t IS NOT NULL")
    n_items, n_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    n_blocks = max(1, -(-n_items // block_items), -(-n_bytes // (4 * block_words)))
    items = items.withColumn("b", F.pmod(F.xxhash64("t", "item_id"), F.lit(n_blocks)))
    fields = [("doc_id", T.LongType()), ("item_id", T.LongType()), ("distance", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType())]
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, start long, end long")
    for b in range(n_blocks):
        block = docs.sparkSession.sparkContext.broadcast(Block([(r["item_id"], bytes(r["t"])) for r in items.filter(F.col("b") == b).sort("item_id", "t").collect()]))

        def run(cols: list[list], block=block) -> list:
            rows = find_leaks(cols[1], block.value) if block.value.ids else []
            return [[cols[0][d] for d, *_ in rows], *[list(c) for c in zip(*[r[1:] for r in rows], strict=True)]] if rows else [[]] * 5

        found = found.union(explode_text(texts, ["doc_id", "t"], fields, run))
    return found


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, all columns, whatever their names.

    Every row is judged by its own whole text, whatever its id: rows that only share an id with a leaked one stay,
    leaked rows without an id go, repeated texts are treated alike, null texts stay, an empty table gives none.
    """
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaked = materialize(leaks(texts, benchmark).select(F.col("doc_id").alias("leaked")).distinct(), "leaked")
    rows = packed(docs, F.xxhash64("text").alias("th"))
    return rows.join(leaked, F.col("th") == F.col("leaked"), "left_anti").select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks of the benchmark in the documents."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
