"""Where the tokens of a few chunks stand, and the questions answered from that: inside tasks, over Arrow arrays.

Chunks go in slices of a bounded number of chunks and tokens. A slice holds each of its chunks whole, so it counts and matches alone,
and passes on the first k chunks a question or the chunks with every lexeme, never all pairs of question and chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

SLICE_TOKENS = 1 << 20
MOST_WANTED = 20_000  # lexemes of all questions together that tasks are given; the driver gets one more at most


@dataclass(frozen=True)
class Wanted:
    """Questions and their lexemes: a row of `question`, `lex` for each, ordered by token, `starts` where a token's begin."""

    tokens: list[str]
    starts: np.ndarray
    question: np.ndarray
    lex: np.ndarray
    n: np.ndarray
    ids: list

    @classmethod
    def of(cls, wanted: DataFrame, most: int = MOST_WANTED) -> Wanted | None:
        """From rows of query_id, n, lex, token; None where they are more than `most`."""
        rows = sorted(wanted.select("token", "query_id", "lex", "n").limit(most + 1).collect(), key=lambda r: r["token"])
        if len(rows) > most:
            return None
        ids = {r["query_id"]: r["n"] for r in rows}
        number, tokens = {q: i for i, q in enumerate(ids)}, [r["token"] for r in rows]
        firsts = [i for i, t in enumerate(tokens) if not i or t != tokens[i - 1]]
        return cls([tokens[i] for i in firsts], np.array([*firsts, len(rows)]), np.array([number[r["query_id"]] for r in rows], int), np.array([r["lex"] for r in rows], int), np.array(list(ids.values()), int), list(ids))

    def expanded(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `token`, row of a question) for every question that wants the token."""
        sizes = self.starts[token + 1] - self.starts[token]
        at = np.repeat(np.arange(len(token)), sizes)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.starts[token][at]


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """(ids ascending, number of tokens of each, all tokens in order) of batches of (id, tokens), at most `rows` chunks at a time."""
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(b.column(1)), 0), np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            stop = int(np.searchsorted(ends, ends[at] - sizes[at] + SLICE_TOKENS, "right"))
            stop = max(at + 1, min(at + rows, stop))
            order = pc.sort_indices(b.column(0).slice(at, stop - at))
            yield b.column(0).slice(at, stop - at).take(order), sizes[at:stop][order.to_numpy()], b.column(1).slice(at, stop - at).take(order).flatten()
            at = stop


def places_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk, place in it) of the tokens of chunks of these sizes."""
    return np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def indexed(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, tokens) the rows of an index: token, block, first_id, ids, places. A block is a slice, numbered by its smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, tokens in slices(batches, rows):
            if not len(tokens):
                continue
            told = tokens.dictionary_encode()
            chunk, place = places_of(sizes)
            code = told.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            code, chunk, place = code[order], chunk[order], place[order]
            pair = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])])
            row = np.flatnonzero(np.r_[True, code[pair][1:] != code[pair][:-1]])
            number = ids.to_numpy()[chunk[pair]]
            first, lengths = number[row], np.diff(np.r_[row, len(pair)])
            cut = pa.array(np.r_[row, len(pair)].astype(np.int32))
            held = pa.ListArray.from_arrays(pa.array(np.r_[pair, len(code)].astype(np.int32)), pa.array(place.astype(np.int32)))
            block = int(ids[0].as_py() * 0x9E3779B97F4A7C15 >> 24 & 0x7FFFFFFF)
            columns = [told.dictionary.take(pa.array(code[pair][row])), pa.array(np.full(len(row), block, np.int32)), pa.array(first)]
            columns += [pa.ListArray.from_arrays(cut, pa.array(number - np.repeat(first, lengths))), pa.ListArray.from_arrays(cut, held)]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "block", "first_id", "ids", "places"])

    return run


def answered(wanted: Wanted, ids: pa.Array, token: np.ndarray, chunk: np.ndarray, weight: np.ndarray, k: int | None, names: tuple[str, str], kind: pa.DataType) -> pa.RecordBatch:
    """The first `k` chunks of each question by sum of weights, then id; without k its chunks with every lexeme and its hits there.

    An occurrence has the token's number, the number of its chunk in `ids` (ascending), and a weight: a count, or, without k, its place.
    """
    at, row = wanted.expanded(token)
    cell = wanted.question[row] * len(ids) + chunk[at]
    shape = len(wanted.ids), len(ids)
    if k is not None:
        score = np.bincount(cell, weight[at], shape[0] * shape[1]).reshape(shape)
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        q, c = np.nonzero(np.take_along_axis(score, best, 1) > 0)
        c = best[q, c]
        last = pa.array(score[q, c].astype(np.int64))
    else:
        once = np.unique(cell * len(wanted.lex) + row) // max(1, len(wanted.lex))
        full = np.bincount(once, minlength=shape[0] * shape[1]).reshape(shape) == wanted.n[:, None]
        some = full.ravel()[cell]
        cell, place, lex = cell[some], weight[at][some], wanted.lex[row][some]
        order = np.lexsort((place, cell))
        cell, place, lex = cell[order], place[order], lex[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
        q, c = np.divmod(cell[first], max(1, len(ids)))
        hits = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(lex.astype(np.int32))], names=["pos", "lex"])
        last = pa.ListArray.from_arrays(pa.array(np.r_[first, len(cell)].astype(np.int32)), hits)
    columns = [pa.array([wanted.ids[i] for i in q], kind), ids.take(pa.array(c)), *([] if k is not None else [pa.array(wanted.n[q].astype(np.int32))]), last]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", *([] if k is not None else ["n"]), names[k is None]])


def from_texts(wanted: Wanted, k: int | None, rows: int, schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers from (id, tokens)."""
    kind = to_arrow_type(schema["query_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(wanted.tokens, pa.string())
        for ids, sizes, tokens in slices(batches, rows):
            chunk, place = places_of(sizes)
            token = pc.fill_null(pc.index_in(tokens, value_set=known), -1).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(token >= 0)
            yield answered(wanted, ids, token[some], chunk[some], np.ones(len(some)) if k is not None else place[some], k, ("native_rank", "hits"), kind)

    return run


def from_index(wanted: Wanted, k: int | None, schema: StructType) -> Callable[[pa.Table], pa.Table]:
    """Answers from the rows of one block of an index (token, first_id, ids, held: counts, or, without k, places)."""
    kind = to_arrow_type(schema["query_id"].dataType)

    def run(block: pa.Table) -> pa.Table:
        flat = lambda name: block[name].combine_chunks()
        lengths = np.asarray(pc.list_value_length(flat("ids")), np.int64)
        number = np.asarray(flat("ids").flatten()) + np.repeat(flat("first_id").to_numpy(), lengths)
        token = np.repeat(pc.fill_null(pc.index_in(flat("token"), value_set=pa.array(wanted.tokens, pa.string())), -1).to_numpy(zero_copy_only=False), lengths)
        ids, chunk = np.unique(number, return_inverse=True)
        held = flat("held").flatten()
        if k is None:
            sizes = np.asarray(pc.list_value_length(held), np.int64)
            token, chunk, held = np.repeat(token, sizes), np.repeat(chunk, sizes), held.flatten()
        some = token >= 0
        return pa.Table.from_batches([answered(wanted, pa.array(ids), token[some], chunk[some], np.asarray(held)[some], k, ("native_rank", "hits"), kind)])

    return run
