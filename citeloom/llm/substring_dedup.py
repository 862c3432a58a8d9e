"""Substring dedup with sharded repeated-phrase automata.

A window is 20 consecutive words; each word under a window whose words also start earlier in the corpus goes.
The work is cut down to what repeats, exactly:

1. Winnowing (Schleimer et al., 2003). A window's anchor is its first smallest hash of 6 consecutive words, so
   equal windows have equal anchors. One anchor in about eight words is shuffled, as two longs and a position;
   anchors found at one place only (copies of a text count once) rule all their windows out. An anchor that
   one batch of texts holds often is salted by text there: its rows survive for certain, and one marker row
   tells the anchor's other rows, so no task gets all places of a common phrase. `heavy_in_batch` rows
   of the 10,000 texts of a batch are 0.6 % of them, so an anchor that stays whole is in fewer texts than that.
2. Texts meet the surviving anchors. Later copies of a whole text are settled here; documents without a
   surviving anchor too; the others are written out.
3. The windows of one anchor at one place form a passage of at most 34 words. Equal passages are combined
   before and after the shuffle to their first place, so a passage in a third of all documents is a row a batch.
   Passages are dealt to shards by anchor; a salted one or one with more than `hot_anchor_rows` places is dealt
   by window instead, each window a passage of its own, so that no shard grows with one phrase.
4. Each shard confirms which windows recur in it (by hash), compiles an Aho-Corasick automaton of them over word
   numbers, and streams its passages, the pieces of all documents that can match, through it. The automaton's
   matches are the occurrences: they compare the words themselves and give the first place of each window.
5. Places join their passage's row, and words under windows that start earlier are removed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import explode_text, materialize

WINDOW, GRAM = 20, 6
SPAN = WINDOW - GRAM + 1  # grams in a window
SALTS = 64
LAST = (1 << 63) - 1  # stands for a null doc_id: after all others


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 6 consecutive words, from their codes."""
    h = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        h = (h ^ codes[i : len(codes) - GRAM + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def first_smallest(h: np.ndarray) -> np.ndarray:
    """For each window of SPAN (15) hashes the position of its first smallest, by doubling: 2, 4, 8, then two eights that overlap."""
    low, at = h, np.arange(len(h))
    for step in (1, 2, 4, SPAN - 8):
        less = low[step:] < low[:-step]
        low, at = np.where(less, low[step:], low[:-step]), np.where(less, at[step:], at[:-step])
    return at


def passages_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, first window, windows) of each passage: the windows in a row that share an anchor.

    The texts are hashed as one sequence; windows across two texts are left out.
    """
    sizes = np.array([len(w) for w in texts])
    codes = np.fromiter(map(zlib.crc32, chain.from_iterable(texts)), np.uint64, int(sizes.sum()))
    if len(codes) < WINDOW:
        return (np.empty(0, np.int64),) * 4
    h = gram_hashes(codes)
    at = first_smallest(h)
    text = np.repeat(np.arange(len(texts)), sizes)
    inside = text[: len(at)] == text[WINDOW - 1 :]
    starts = np.flatnonzero(inside)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) > 1) | (np.diff(at[starts]) != 0) | (np.diff(text[starts]) != 0)
    heads = np.flatnonzero(new)
    s = starts[heads]
    t = text[s]
    return t, h[at[s]].view(np.int64), s - (np.cumsum(sizes) - sizes)[t], np.diff(np.append(heads, len(starts)))


def _anchor_rows(cols: list[list], heavy: int) -> list:
    """anchor, salt, th, start, n of a batch's passages.

    An anchor with more than `heavy` rows gets salts from 1 on, and one marker (salt 0, start -1).
    """
    made: list[list] = [[], [], [], []]
    seen: set[int] = set()
    held: list[list[bytes]] = []
    ths: list[int] = []
    words = 0

    def flush() -> None:
        t, anchor, start, n = passages_of(held)
        for to, x in zip(made, (anchor, np.array(ths, np.int64)[t], start.astype(np.int32), n.astype(np.int32)), strict=True):
            to.append(x)
        held.clear()
        ths.clear()

    for th, text in zip(*cols, strict=True):
        if th in seen:
            continue  # the copies of a text in a batch are one
        seen.add(th)
        held.append(text.split())
        ths.append(th)
        words += len(held[-1])
        if words > 1 << 18:
            flush()
            words = 0
    if held:
        flush()
    if not made[0]:
        return [[]] * 5
    anchor, th, start, n = map(np.concatenate, made)
    values, counts = np.unique(anchor, return_counts=True)
    often = values[counts > heavy]
    salt = np.where(np.isin(anchor, often), 1 + th % SALTS, 0)
    zero = np.zeros(len(often), np.int64)
    return [np.concatenate(x) for x in ((anchor, often), (salt, zero), (th, zero), (start, zero - 1), (n, zero))]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _settle(cols: list[list]) -> list:
    """Final counts of copies and of documents without surviving anchors; the others keep text and passages."""
    out: list[list] = [[] for _ in range(7)]
    for doc_id, th, text, copy, *marks in zip(*cols, strict=True):
        words = (text or b"").split()
        n = len(words)
        gone = n if copy and n >= WINDOW else 0
        more = not gone and marks[0] is not None and text is not None
        row = (doc_id, th, n, gone, None if more else _digest([] if gone else words), text if more else None, np.array(marks, np.int64).tobytes() if more else None)
        for to, x in zip(out, row, strict=True):
            to.append(x)
    return out


def passages(text: bytes, packed: bytes) -> Iterator[tuple[int, int, list[bytes], bool]]:
    """(anchor, start, words, hot) of each passage of a document whose anchor survives."""
    words = text.split()
    for a, s, n, hot in np.frombuffer(packed, np.int64).reshape(4, -1).T.tolist():
        if hot:
            for j in range(s, s + n):
                yield a, j, words[j : j + WINDOW], True
        else:
            yield a, s, words[s : s + n + WINDOW - 1], False


def _keyed(cols: list[list]) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """(shard key, passage, its digest, doc, text hash, start) of each passage of a batch."""
    for doc, th, text, packed in zip(*cols, strict=True):
        for a, start, words, hot in passages(text, packed):
            joined = b" ".join(words)
            key = hashlib.md5(joined).digest()
            yield int.from_bytes(key[:8], "little", signed=True) if hot else a, joined, key, doc, th, start


def _place_rows(cols: list[list]) -> list:
    rows = [(shard, key, doc, th, start) for shard, _, key, doc, th, start in _keyed(cols)]
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], [], []]


def _passage_rows(cols: list[list]) -> list:
    """The passages of a batch, equal ones combined to their first place before anything is shuffled."""
    first: dict[tuple[int, bytes], tuple[int, int]] = {}
    for shard, joined, _, doc, _, start in _keyed(cols):
        k = (shard, joined)
        if k not in first or (doc, start) < first[k]:
            first[k] = (doc, start)
    return [[k[0] for k in first], [k[1] for k in first], [d for d, _ in first.values()], [x for _, x in first.values()]]


def window_hashes(numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 20 consecutive word numbers."""
    h = np.zeros(max(0, len(numbers) - WINDOW + 1), np.uint64)
    for i in range(WINDOW):
        h = (h ^ numbers[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def occurrences(passages: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, place, pattern) of every occurrence of the windows that recur among passages of word numbers.

    Windows whose hash recurs are confirmed and compiled into an Aho-Corasick automaton, one pattern for each hash,
    and all passages are streamed through it. The automaton compares words: a window whose hash recurs and that no
    pattern matches (two windows of one hash) is compiled too, and the stream repeated.
    """
    sizes = np.array([len(p) for p in passages], np.int64)
    flat = np.fromiter(chain.from_iterable(passages), np.uint64, int(sizes.sum()))
    h = window_hashes(flat)
    owner = np.repeat(np.arange(len(passages)), sizes)
    begin = (np.cumsum(sizes) - sizes)[owner]
    whole = np.flatnonzero(owner[: len(h)] == owner[WINDOW - 1 :]) if len(h) else np.empty(0, np.int64)
    _, first, which, counts = np.unique(h[whole], return_index=True, return_inverse=True, return_counts=True)
    wanted = whole[counts[which] > 1]  # places of windows whose hash recurs
    new = whole[first[counts > 1]]
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    n = 0
    while len(new):
        for x in new.tolist():
            p, at = int(owner[x]), int(x - begin[x])
            key = tuple(passages[p][at : at + WINDOW])
            if key not in machine:
                machine.add_word(key, n)
                n += 1
        machine.make_automaton()
        met = [(x, end - WINDOW + 1, k) for x in np.unique(owner[wanted]).tolist() for end, k in machine.iter(tuple(passages[x]))]
        found = np.array(met, np.int64).reshape(-1, 3)
        starts = np.concatenate([[0], np.cumsum(sizes)])[found[:, 0]] + found[:, 1]
        new = np.setdiff1d(wanted, starts)
        if not len(new):
            return found[:, 0], found[:, 1], found[:, 2]
    return (np.empty(0, np.int64),) * 3


def locate(f: pd.DataFrame) -> pd.DataFrame:
    """shard, passage, doc, start of one shard -> shard, key, firsts.

    firsts: the number of windows, then runs (offset, doc, base): from that offset on, window i is first seen in
    doc at base + i.
    """
    texts, shards, docs, starts = f["passage"].tolist(), f["shard"].tolist(), f["doc"].tolist(), f["start"].tolist()
    alike = Counter(shards)
    # two windows of one passage share its anchor at different offsets and so differ: alone, it has nothing to find
    rivals = [x for x, k in enumerate(shards) if alike[k] > 1]
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers) + 1) for w in texts[x].split(b" ")] for x in rivals]
    first: dict[int, tuple[int, int]] = {}
    found: dict[int, dict[int, int]] = {}
    for r, at, k in zip(*(c.tolist() for c in occurrences(words)), strict=True):
        x = rivals[r]
        found.setdefault(x, {})[at] = k
        first[k] = min(first.get(k, (LAST, LAST)), (docs[x], starts[x] + at))
    firsts = []
    for x, t in enumerate(texts):
        n = t.count(b" ") + 2 - WINDOW
        row, run, met = [n], None, found.get(x, {})
        for i in range(n) if met else (0,):
            d, at = first[met[i]] if i in met else (docs[x], starts[x] + i)
            if run != (d, at - i):
                run = (d, at - i)
                row += [i, *run]
        firsts.append(row)
    return pd.DataFrame({"shard": f["shard"], "key": [hashlib.md5(p).digest() for p in f["passage"]], "firsts": firsts})


def _finish(cols: list[list]) -> list:
    out: list[list] = [[] for _ in range(4)]
    for doc_id, text, spans in zip(*cols, strict=True):
        words = text.split()
        gone = np.zeros(len(words) + 1, np.int64)
        packed = np.array(spans or (), np.int64)
        np.add.at(gone, packed >> 16, 1)
        np.add.at(gone, (packed >> 16) + (packed & 0xFFFF), -1)
        keep = np.cumsum(gone)[:-1] == 0
        kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        for to, x in zip(out, (doc_id, len(words), len(words) - len(kept), _digest(kept)), strict=True):
            to.append(x)
    return out


def _late_spans(cols: list[list]) -> list:
    """(doc, text hash, span) of the words under windows that start earlier elsewhere, merged within a passage.

    A span is its first word times 65,536 plus its number of words, so that a document's spans are an array of longs.
    """
    rows: list[tuple] = []
    for doc, th, start, firsts in zip(*cols, strict=True):
        late_from = -1
        for k in range(1, len(firsts), 3):
            first = firsts[k + 1]
            if first < doc or (first == doc and firsts[k + 2] < start):
                late_from = firsts[k] if late_from < 0 else late_from
            elif late_from >= 0:
                rows.append((doc, th, start + late_from << 16 | firsts[k] - 1 + WINDOW - late_from))
                late_from = -1
        if late_from >= 0:
            rows.append((doc, th, start + late_from << 16 | firsts[0] - 1 + WINDOW - late_from))
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]


def dedup_substrings(docs: DataFrame, hot_anchor_rows: int = 100_000, shard_rows: int = 20_000, heavy_in_batch: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row per document.

    Earlier: a smaller doc_id, or the same document and an earlier start; a null doc_id comes last. Rows that
    share a doc_id start at the same places, so none of them is earlier than another's same place. Null text: no
    words. Texts under 20 words have no window; longer ones are read whole, whatever their length. Other columns are not looked at; an empty table gives no rows.
    """
    L, B, I = T.LongType(), T.BinaryType(), T.IntegerType()
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    fields = [("anchor", L), ("salt", I), ("th", L), ("start", I), ("n", I)]
    rows = explode_text(docs.filter("text IS NOT NULL"), ["th", F.col("text").cast("binary").alias("t")], fields, lambda cols: _anchor_rows(cols, heavy_in_batch))
    places = rows.repartition("anchor", "salt").groupBy("anchor", "salt", "th", "start", "n").agg(F.lit(1).alias("one"))  # a text's copies once
    alike = Window.partitionBy("anchor", "salt")
    places = places.withColumns({"places": F.count("*").over(alike), "marked": F.min("start").over(alike) < 0})
    places = places.filter("start >= 0 AND (places > 1 OR salt > 0)")
    hot = (F.col("salt") > 0) | F.col("marked") | (F.col("places") > hot_anchor_rows)
    alive = places.select("th", F.struct("anchor", "start", "n", hot.cast("int").alias("hot")).alias("x"))
    alive = alive.groupBy("th").agg(F.collect_list("x").alias("xs"))
    first = docs.groupBy("th").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.sha2("text", 256).alias("s"))).alias("first"))
    known = materialize(first.join(alive, "th", "left"), "substring-known")
    met = docs.join(known.withColumnRenamed("th", "k"), F.col("th") == F.col("k"))
    copy = (F.col("first.d") < F.coalesce("doc_id", F.lit(LAST))) & (F.col("first.s") == F.sha2("text", 256))
    columns = ["doc_id", "th", F.col("text").cast("binary").alias("t"), F.coalesce(copy, F.lit(False)).alias("copy"), *[F.col(f"xs.{c}").alias(c) for c in ("anchor", "start", "n", "hot")]]
    settled = explode_text(met, columns, [("doc_id", L), ("th", L), ("n_words", L), ("n_removed", L), ("kept_sha256", T.StringType()), ("t", B), ("packed", B)], _settle)
    settled = materialize(settled, "substring-settled")
    open_docs = settled.filter("packed IS NOT NULL")
    order = F.coalesce("doc_id", F.lit(LAST)).alias("doc")

    of = [order, "th", "t", "packed"]
    shards = known.agg(F.sum(F.when(F.col("xs").isNotNull(), F.size("xs")))).first()[0] or 0
    shards = max(1, -(-shards // shard_rows))
    cut = explode_text(open_docs, of, [("shard", L), ("passage", B), ("doc", L), ("start", L)], _passage_rows)
    dealt = cut.withColumn("s", F.pmod(F.xxhash64("shard"), F.lit(shards))).repartition("s")
    dealt = dealt.groupBy("s", "shard", "passage").agg(F.min(F.struct("doc", "start")).alias("f")).select("s", "shard", "passage", "f.doc", "f.start")
    located = dealt.groupBy("s").applyInPandas(locate, "shard long, key binary, firsts array<long>")
    placed = explode_text(open_docs, of, [("shard", L), ("key", B), ("doc", L), ("th", L), ("start", L)], _place_rows)
    spans = explode_text(placed.join(located, ["shard", "key"]), ["doc", "th", "start", "firsts"], [("doc", L), ("th", L), ("span", L)], _late_spans)
    # rows that share a doc_id are told apart by their text
    spans = spans.groupBy(F.col("doc").alias("k"), F.col("th").alias("kt")).agg(F.collect_list("span").alias("spans"))
    late = open_docs.select("doc_id", "th", "t", order).join(spans, (F.col("doc") == F.col("k")) & (F.col("th") == F.col("kt")), "left")
    done = explode_text(late, ["doc_id", "t", "spans"], [("doc_id", L), ("n_words", L), ("n_removed", L), ("kept_sha256", T.StringType())], _finish)
    return done.unionByName(settled.filter("packed IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and the digest of the kept words of every document."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, r, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, r, i, array_to_string(w[i : i + 19], ' ') AS words FROM s),
f AS (SELECT doc_id, r, i, min((coalesce(doc_id, 9223372036854775807), i)) OVER (PARTITION BY words) AS first FROM k),
g AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS pos FROM f WHERE first < (coalesce(doc_id, 9223372036854775807), i)),
h AS (SELECT r, list(pos) AS gone FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN h USING (r)
"""
