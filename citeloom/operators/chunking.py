"""Chunkers: lines and token windows as column expressions, heading paragraphs and page blocks in Arrow batches.

The tokenizer is pluggable: a function from a text to its token spans [(start, end), ...]. The default takes
whitespace-separated words; `citeloom.functions.tokens.BytePairs` takes the tokens of a public vocabulary.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions import text as tx
from ..functions.tokens import BytePairs, few_rows

Spans = Callable[[str], list[tuple[int, int]]]
CHUNKS = "doc_id long, ordinal int, heading_path array<string>, start_line int, end_line int, content string, content_checksum string, token_count int"
PAGE_CHUNKS = "doc_id long, page_number int, ordinal int, start_offset int, end_offset int, content string, content_checksum string, token_count int"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as one Arrow batch of a schema of this module."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def line_chunks(docs: DataFrame) -> DataFrame:
    """Non-blank lines as chunks: doc_id, workspace_id, ordinal (from 0), content."""
    lines = F.filter(F.split(tx.newlines(F.col("text")), "\n"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.col("source").alias("workspace_id"), F.posexplode(lines).alias("ordinal", "content"))


def window_starts(n: Column, config: Chunking) -> Column:
    """Starts of the token windows of a text of n tokens: one if it fits, else every target - overlap, without a tail that the overlap covers."""
    step = config.target_tokens - config.overlap_tokens
    many = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (n - s > config.overlap_tokens))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= config.max_tokens, F.array(F.lit(0))).otherwise(many)


def token_windows(docs: DataFrame, config: Chunking) -> DataFrame:
    """doc_id, ordinal, content, token_count: windows over whitespace tokens, natively."""
    words = docs.select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "").alias("words"))
    starts = words.select("doc_id", "words", F.posexplode(window_starts(F.size("words"), config)).alias("ordinal", "start"))
    size = F.when(F.size("words") <= config.max_tokens, F.size("words")).otherwise(F.lit(config.target_tokens))
    piece = F.slice("words", F.col("start") + 1, size)
    return starts.select("doc_id", "ordinal", F.array_join(piece, " ").alias("content"), F.size(piece).alias("token_count"))


HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*")


def paragraphs(text: str, markdown: bool) -> Iterator[tuple[tuple[str, ...], int, int, str]]:
    """(heading path, first line, last line, content) of each paragraph; headings are context, not content."""
    path: list[str] = []
    held: list[str] = []
    first = 0
    number = 0
    for number, line in enumerate(text.splitlines(), 1):  # noqa: B007
        heading = HEADING.fullmatch(line) if markdown else None
        if held and (heading or not line.strip()):
            yield tuple(path), first, number - 1, "\n".join(held).strip()
            held = []
        if heading:
            path = [*path[: len(heading[1]) - 1], heading[2]]
        elif line.strip():
            first = first if held else number
            held.append(line)
    if held:
        yield tuple(path), first, number, "\n".join(held).strip()


def heading_chunks(docs: DataFrame, config: Chunking | None = None, spans: Spans = word_spans) -> DataFrame:
    """Chunks of markdown and plain documents (doc_id, text, media_type), oversize paragraphs as token windows.

    A window of byte pairs is what its ids decode to: a character cut by its ends is U+FFFD there.
    """
    config = config or Chunking()

    def cut(content: str) -> Iterator[tuple[str, int]]:
        ids = isinstance(spans, BytePairs)
        at = spans.encode(content) if ids else spans(content)
        if len(at) <= config.max_tokens:
            yield content, len(at)
            return
        starts = range(0, len(at), config.target_tokens - config.overlap_tokens)
        for s in starts:
            if s == 0 or len(at) - s > config.overlap_tokens:
                piece = at[s : s + config.target_tokens]
                yield spans.decode(piece) if ids else content[piece[0][0] : piece[-1][1]], len(piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            rows = []
            for doc_id, text, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = 0
                for path, first, last, content in paragraphs((text or "").replace("\r\n", "\n").replace("\r", "\n"), kind == "text/markdown"):
                    for piece, count in cut(content):
                        rows.append((doc_id, n, list(path), first, last, piece, hashlib.sha256(piece.encode()).hexdigest(), count))
                        n += 1
            yield _batch(rows, CHUNKS)

    return docs.select(F.col("doc_id").cast("long"), "text", "media_type").mapInArrow(run, CHUNKS)


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches between empty lines, without the white space around them."""
    at = 0
    for gap in re.finditer(r"\n{2,}|\Z", text):
        piece = text[at : gap.start()]
        bare = piece.strip()
        if bare:
            start = at + len(piece) - len(piece.lstrip())
            yield start, start + len(bare)
        at = gap.end()


def pack(text: str, config: Chunking, spans: Spans = word_spans) -> list[tuple[int, int]]:
    """Ranges of a page: blocks packed up to the target, with whole blocks of overlap; oversize blocks are split.

    The page is tokenized once. A range has the tokens that start in it, so sizes are differences of token numbers, and the
    block that the next range starts with is found by bisection: all is linear in the page, but for that search. Oversize
    blocks are cut between characters; a character of more tokens than the limit is a range of its own.
    """
    tokens = spans(text)
    starts = [s for s, _ in tokens]
    numbered = [(s, e, bisect_left(starts, s), bisect_left(starts, e)) for s, e in blocks(text)]
    out: list[tuple[int, int]] = []
    for oversize, group in groupby(numbered, lambda b: b[3] - b[2] > config.max_tokens):
        run = list(group)
        if oversize:
            for _, end, first, last in run:
                whole = lambda t, last=last: next(x for x in range(t, -1, -1) if x in (0, last) or starts[x] >= tokens[x - 1][1])
                while True:
                    stop = min(first + config.max_tokens, last)
                    stop = whole(stop) if whole(stop) > first else next(x for x in range(stop, last + 1) if x == last or starts[x] >= tokens[x - 1][1])
                    out.append((starts[first], end if stop == last else tokens[stop - 1][1]))
                    if stop == last:
                        break
                    after = whole(max(stop - config.overlap_tokens, first + 1))
                    first = after if after > first else stop
            continue
        firsts, low = [b[2] for b in run], 0
        for i in range(1, len(run) + 1):
            if i < len(run) and run[i][3] - firsts[low] <= config.target_tokens:
                continue
            out.append((run[low][0], run[i - 1][1]))
            if i < len(run):  # the next begins with the last blocks that fit the overlap, as far as it stays within the limit
                fits = max(run[i - 1][3] - config.overlap_tokens, run[i][3] - config.max_tokens)
                low = bisect_left(firsts, fits, low, i)
    return out


def page_chunks(pages: DataFrame, config: Chunking | None = None, spans: Spans = word_spans) -> DataFrame:
    """Chunks of normalized pages (doc_id, page_number, text) with their offsets in the page, ordinals over the document.

    Pages are cut where they are read, one at a time; the ordinals take one sort of a document's chunks, which spills.
    A null text has no chunks.
    """
    config = config or Chunking()
    schema = ", ".join(c for c in PAGE_CHUNKS.split(", ") if not c.startswith("ordinal"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            rows: list[tuple] = []
            for doc_id, number, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                starts = [s for s, _ in spans(text)]
                for s, e in pack(text, config, spans):
                    piece = text[s:e]
                    rows.append((doc_id, number, s, e, piece, hashlib.sha256(piece.encode()).hexdigest(), bisect_left(starts, e) - bisect_left(starts, s)))
            yield _batch(rows, schema)

    made = pages.select(F.col("doc_id").cast("long"), F.col("page_number").cast("int"), "text").mapInArrow(run, schema)
    order = Window.partitionBy("doc_id").orderBy("page_number", "start_offset", "end_offset", "content_checksum")
    return made.withColumn("ordinal", F.row_number().over(order) - 1).select(*[c.split()[0] for c in PAGE_CHUNKS.split(", ")])
