"""Alignment of the tokens of two tokenizers over the same texts.

Both tokenizers cut the bytes of a text into ranges; overlapping ranges are the edges of a bipartite graph between the
tokens of the one and of the other, and its connected components, found by union-find, are the smallest groups that
both cut alike. The members of a component are expanded to its links again, and the links of all texts are counted by
pair of ids: within a task first, then in one aggregation.

A text is cut before each space that follows a visible character. No token of either vocabulary crosses such a place
(the byte-level pattern takes white space only at the front of a token or among its own kind, and `Tokenizers` looks through the
pieces for a space behind another character), so a task encodes each different piece once. A text with a piece whose tokens do not spell it is encoded whole, and has no tokens if that does not spell it either.

Texts are encoded once: what is written of each are its figures and the pairs of its links. The counts come back to them
as a sorted table: broadcast while it has at most `BROADCAST_PAIRS` rows, which is measured first, and by a join with each
text's distinct pairs beyond.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

TOKENIZERS = "/opt/tokenizers"
BROADCAST_PAIRS = 8_000_000
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
SLICE = 2 << 20  # bytes that are cut and looked up at a time
SPACES = re.compile(r"\s ")
LINKS = 1 << 20  # links that are looked up at a time
WHOLE = "\ud800"  # no text holds a lone surrogate
MOST_PIECES, MOST_POINTS = 300_000, 8 << 20  # that a worker knows at a time
#: Fixed value: how the byte-level tokenizer cuts text before its merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """The two tokenizers from the contents of their files, and the bytes of every token.

    Where the ids of the byte-level vocabulary are in the order of its merges (checked), they are the ranks that the faster of
    two public libraries encodes by; else the library that reads the file itself encodes.
    """

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        import sentencepiece

        model = json.loads(byte_level)
        letters, vocab = byte_letters(), model["model"]["vocab"]
        self.a_bytes = [b""] * (max([*vocab.values(), *[t["id"] for t in model["added_tokens"]]]) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.encode_a = self.by_rank(model, vocab) or self.by_file(byte_level)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.pair_type = np.int32 if len(self.a_size) * len(self.b_size) < 1 << 31 else np.int64
        # an id as it follows another of its group, the group's other side, and the group before
        self.a_names, self.b_names = ([f"{mark}{i}" for mark in marks for i in range(len(x))] for x, marks in ((self.a_bytes, ",;"), (self.b_bytes, ",|")))
        if any(re.search("[^▁]▁", p) for p in names):
            raise ValueError("a piece crosses the space before a word; texts cannot be cut there")

    def by_rank(self, model: dict, vocab: dict[str, int]) -> Callable[[str], list[int]] | None:
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        plain = model["normalizer"] is None and model["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        special = {t["id"] for t in model["added_tokens"]}
        if not plain or any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)) or not all(i < 256 + len(merges) or i in special for i in vocab.values()):
            return None
        import tiktoken

        ranks = {self.a_bytes[i]: i for i in vocab.values() if i not in special}
        return tiktoken.Encoding("byte level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def by_file(byte_level: bytes) -> Callable[[str], list[int]]:
        import tokenizers

        a = tokenizers.Tokenizer.from_str(byte_level.decode())
        a.encode_special_tokens = True
        return lambda text: a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        encode_a = self.encode_a
        return [encode_a(" " + t) for t in texts], self.b.encode(texts, num_threads=1)

    def spelled(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = (" " + text).encode()
        return b"".join([self.a_bytes[i] for i in a]) == whole and b"".join([self.b_bytes[i] for i in b]) == whole


def cut(text: str) -> list[str]:
    """The pieces of a text, each without the one space before it; a space behind white space or at the end does not cut."""
    parts = text.split(" ")
    if len(parts) == 1 or not (text[0] == " " or text[-1] == " " or SPACES.search(text)):
        return parts
    made, held = [], None
    for p in parts:
        held = p if held is None else f"{held} {p}"
        if held and not held[-1].isspace():
            made.append(held)
            held = None
    if held == "" and made:  # one space at the end, which the piece tokenizer would not see by itself
        made[-1] += " "
    elif held is not None:
        made.append(held)
    return made


def union(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of n nodes under edges a-b: roots are hooked on smaller ones, paths are halved."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        open_edges = ra != rb
        if not open_edges.any():
            break
        a, b, ra, rb = a[open_edges], b[open_edges], ra[open_edges], rb[open_edges]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent != (up := parent[parent])).any():
            parent = up
    return parent


class Aligned:
    """Tokens, groups and links of texts that stand one behind the other; links and groups are in order of their bytes."""

    def __init__(self, tok: Tokenizers, a: list[list[int]], b: list[list[int]]):
        flat = lambda x: (np.array(list(map(len, x)), np.int64), np.fromiter(chain.from_iterable(x), np.int64))
        (self.n_a, self.a), (self.n_b, self.b) = flat(a), flat(b)
        a_end, b_end = np.cumsum(tok.a_size[self.a]), np.cumsum(tok.b_size[self.b])
        ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")
        ends = ends[np.diff(ends, prepend=-1) > 0]  # between two neighbours lie one token of each side: a link
        left, right = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        root = union(left, right + len(self.a), len(self.a) + len(self.b))
        self.pair = (self.a[left] * len(tok.b_size) + self.b[right]).astype(tok.pair_type)
        text_of = np.repeat(np.arange(len(a)), self.n_a)
        self.n_links = np.bincount(text_of[left], minlength=len(a))
        new_a, new_b = (np.diff(r, prepend=-1) != 0 for r in (root[: len(self.a)], root[len(self.a) :]))
        self.n_groups = np.bincount(text_of[new_a], minlength=len(a))
        # members in the order of groups, first the one side, then the other
        group = np.concatenate([2 * np.cumsum(new_a), 2 * np.cumsum(new_b) + 1])
        self.order = np.argsort(group, kind="stable")
        self.named = np.concatenate([self.a + new_a * len(tok.a_size), self.b + new_b * len(tok.b_size) + len(tok.a_names)])
        self.names = tok.a_names + tok.b_names

    def groups(self) -> list[str]:
        """`;a1,a2|b1;a3|b2` of each text."""
        written = list(map(self.names.__getitem__, self.named[self.order].tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(written[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


class Index(dict):
    """The number of each different piece, given out as it is first asked for."""

    def __missing__(self, piece: str) -> int:
        return self.setdefault(piece, len(self))


class Known:
    """What is known of the pieces met so far: tokens, groups and links of each, in the order of their numbers."""

    def __init__(self, tok: Tokenizers):
        self.tok, self.index, self.size = tok, Index(), 0
        self.bad = np.empty(0, bool)
        self.figures = np.empty((4, 0), np.int64)  # n_a, n_b, n_groups, n_links
        self.groups: list[str] = []
        self.pairs, self.starts = np.empty(0, tok.pair_type), np.empty(0, np.int64)  # of all links, piece after piece

    def full(self) -> bool:
        return len(self.index) > MOST_PIECES or self.size > MOST_POINTS

    def numbers(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The pieces of each text by number; none where a text has no tokens."""
        of = []
        for t in texts:
            pieces = cut(t.decode()) if t else []
            of.append(np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces)))
        self.learn(list(islice(self.index, len(self.bad), None)))
        for k, own in enumerate(of) if self.bad.any() else ():
            if self.bad[own].any():  # the text as one piece, under a name that no piece has
                whole = texts[k].decode()
                number = self.index[WHOLE + whole]
                self.learn([whole] if number == len(self.bad) else [])
                of[k] = np.empty(0, np.int64) if self.bad[number] else np.array([number])
        return of

    def learn(self, pieces: list[str]) -> None:
        if not pieces:
            return
        a, b = self.tok.encode(pieces)
        bad = np.zeros(len(pieces), bool)
        sizes = np.array([len(p.encode()) + 1 for p in pieces])
        for ids, size, spell in ((a, self.tok.a_size, self.tok.a_bytes), (b, self.tok.b_size, self.tok.b_bytes)):
            flat = np.fromiter(chain.from_iterable(ids), np.int64)
            summed = np.bincount(np.repeat(np.arange(len(ids)), list(map(len, ids))), size[flat], len(ids))
            bad |= summed != sizes
            if b"".join(map(spell.__getitem__, flat.tolist())) != b"".join([b" " + p.encode() for p in pieces]):
                bad |= np.array([not self.tok.spelled(*x) for x in zip(pieces, a, b, strict=True)])
        for i in np.flatnonzero(bad).tolist():
            a[i], b[i] = [], []
        al = Aligned(self.tok, a, b)
        self.size += sum(map(len, pieces))
        self.bad = np.append(self.bad, bad)
        self.figures = np.concatenate([self.figures, [al.n_a, al.n_b, al.n_groups, al.n_links]], axis=1)
        self.groups += al.groups()
        self.starts = np.append(self.starts, len(self.pairs) + np.cumsum(al.n_links) - al.n_links)
        self.pairs = np.append(self.pairs, al.pair)


_KNOWN: dict[tuple[bytes, bytes], Known] = {}


def known_to_worker(files: tuple[bytes, bytes], fresh: bool = False) -> Known:
    """The pieces that this Python worker has met, over all its tasks; begun anew once they are many."""
    known = _KNOWN.get(files)
    if known is None:
        _KNOWN.clear()
        known = _KNOWN[files] = Known(Tokenizers(*files))
    elif fresh or known.full():
        known = _KNOWN[files] = Known(known.tok)
    return known


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Other columns' values and texts of at most SLICE bytes at a time, or of one row."""
    for batch in batches:
        part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            piece = batch.slice(i, j - i)
            yield [c.to_pylist() for c in piece.columns[1:]], piece.column(0).to_pylist()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(starts - ends + sizes, sizes)


def _encoded(batches: Iterator[pa.RecordBatch], files: tuple[bytes, bytes]) -> Iterator[pa.RecordBatch]:
    """The figures of each text and the pairs of ids of its links."""
    known = known_to_worker(files)
    for (doc_id,), texts in _slices(batches):
        if known.full():
            known = known_to_worker(files, True)
        of, groups = known.numbers(texts), known.groups
        pieces, size = np.concatenate([np.empty(0, np.int64), *of]), np.array([len(x) for x in of])
        ends = np.cumsum(size)
        rows = known.figures[:, pieces]
        upto = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(rows, axis=1)], axis=1)
        sums = upto[:, ends] - upto[:, ends - size]
        links = known.pairs[_ranges(known.starts[pieces], rows[3])]
        digests = [hashlib.sha256("".join(map(groups.__getitem__, own.tolist()))[1:].encode()).hexdigest() if len(own) else "" for own in of]
        pairs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sums[3])).astype(np.int32)), pa.array(links))
        yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), *map(pa.array, sums), pa.array(digests, pa.string()), pairs], names=["doc_id", *FIGURES, "groups_sha256", "pairs"])


def _summed(batches: Iterator[pa.RecordBatch], counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each text's links that are best and the sum of their counts, from the sorted table of all pairs."""
    pairs, n, best = counts
    values = np.stack([best.astype(np.int64), n])
    for whole in batches:
        part = np.cumsum(whole.column(4).to_numpy(zero_copy_only=False)) // LINKS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
        for batch in (whole.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False)):
            at = np.searchsorted(pairs, batch.column(6).flatten().to_numpy(zero_copy_only=False))
            upto = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(values[:, at], axis=1)], axis=1)
            ends = np.append(0, np.cumsum(batch.column(4).to_numpy(zero_copy_only=False)))
            sums = upto[:, ends[1:]] - upto[:, ends[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *map(pa.array, sums)], names=["doc_id", *FIGURES, "groups_sha256", "n_best", "count_sum"])


def align_tokens(docs: DataFrame, byte_level: str = f"{TOKENIZERS}/byte_bpe_50k.json", pieces: str = f"{TOKENIZERS}/piece_bpe_32k.model", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per document.

    `byte_level` and `pieces` are the tokenizers' files; the driver reads them (about 2 MB) and sends their contents. Texts
    are read whole. Null and empty texts and texts that the tokens do not spell have zeros and an empty digest. Repeated rows
    count each time, ids may be null or repeat; other columns are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(byte_level, "rb") as f, open(pieces, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    tok = Tokenizers(*files.value)
    kind = "int" if tok.pair_type is np.int32 else "long"
    source = docs.select(F.col("text").cast("binary").alias("text"), "doc_id")
    figures = ", ".join(f"{c} long" for c in FIGURES)
    texts = materialize(source.mapInArrow(lambda b: _encoded(b, files.value), f"doc_id long, {figures}, groups_sha256 string, pairs array<{kind}>"), "align-texts")
    counts = texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = materialize(counts.withColumn("b", F.col("pair") % len(tok.b_size)), "align-counts")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    counts = counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    if counts.count() <= broadcast_pairs:
        found = counts.orderBy("pair").toArrow()
        table = spark.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("pair", "n", "best")))
        rows = texts.mapInArrow(lambda b: _summed(b, table.value), f"doc_id long, {figures}, groups_sha256 string, n_best long, count_sum long")
    else:
        texts = materialize(texts.withColumn("rid", F.monotonically_increasing_id()), "align-rows")
        sums = texts.select("rid", F.explode("pairs").alias("pair")).groupBy("rid", "pair").agg(F.count("*").alias("times")).join(counts, "pair").groupBy("rid")
        sums = sums.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
        rows = texts.drop("pairs").join(sums, "rid", "left").fillna(0, ["n_best", "count_sum"])
    return rows.select("doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of every document under a byte-level and a piece tokenizer."""
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
