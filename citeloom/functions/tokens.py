"""Byte-pair tokens from a public vocabulary: counts, ids and offsets, computed over Arrow batches.

A vocabulary is a file of ranks (base64 of a token, its rank, a line each) on any file system that Spark reads; it is
never trained here. It is broadcast once, below a checked size, and each worker builds its encoder once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how the byte-level vocabulary cuts a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_BYTES = 64 << 20  # of a vocabulary that is broadcast
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_built: dict[tuple[str, str], object] = {}


class BytePairs:
    """A tokenizer from a vocabulary's ranks. Strings of control tokens inside a text are plain text.

    Called with a text it gives the code-point range of each token; a character that several tokens share is in the range of
    each of them.
    """

    def __init__(self, ranks: bytes | Broadcast, pattern: str = PATTERN, digest: str | None = None):
        self.ranks, self.pattern = ranks, pattern
        self.digest = digest or hashlib.sha256(ranks).hexdigest()

    @classmethod
    def load(cls, spark: SparkSession, path: str = RANKS, pattern: str = PATTERN) -> BytePairs:
        """From a file of ranks; one of more than `MOST_BYTES` is an error."""
        file = spark.read.format("binaryFile").load(path)
        size = file.agg(F.sum("length")).first()[0] or 0
        if not 0 < size <= MOST_BYTES:
            raise ValueError(f"a vocabulary has between 1 and {MOST_BYTES} bytes, not {size}")
        content = bytes(file.select("content").first()[0])
        return cls(spark.sparkContext.broadcast(content), pattern, hashlib.sha256(content).hexdigest())

    @property
    def encoder(self):
        key = (self.digest, self.pattern)
        if key not in _built:
            import tiktoken

            content = self.ranks.value if isinstance(self.ranks, Broadcast) else self.ranks
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
            _built[key] = tiktoken.Encoding(self.digest, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _built[key]

    def encode(self, text: str) -> list[int]:
        return self.encoder.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no character by themselves become U+FFFD."""
        return self.encoder.decode(ids, errors="replace")

    def __call__(self, text: str) -> list[tuple[int, int]]:
        out, at = [], 0
        for token in self.encoder.decode_tokens_bytes(self.encode(text)):
            inside = token[0] & 0xC0 == 0x80  # a character counts where its first byte is
            start, at = at - inside, at + sum(b & 0xC0 != 0x80 for b in token)
            out.append((start, at))
        return out


def few_rows(batches: Iterable[pa.RecordBatch], rows: int = 32) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that what Python makes of texts is held for those only, however full a batch is."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def token_ids(rows: DataFrame, key: str, text: str, tokenizer: BytePairs) -> DataFrame:
    """key, n_tokens, ids, exact (whether the ids spell the text again) of every row; a null text has no ids and is exact."""
    source = rows.select(F.col(key), F.coalesce(text, F.lit("")).alias("text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            texts = b.column(1).to_pylist()
            ids = [tokenizer.encode(t) for t in texts]
            exact = [tokenizer.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            arrays = [b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(exact, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "n_tokens", "ids", "exact"])

    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids array<int>, exact boolean")
