"""Line dedup: pairwise patience alignment of documents that share rare runs of lines.

A single line shared by many documents (a licence's first line) says little about which two documents overlap, and
pairing all of its holders would be quadratic. The keys here are runs of consecutive lines: a run counts if it has
at least `min_block_chars` characters and a line of at least `min_line_chars`. Every document gives, from each line
on and back from each line, its shortest run that counts, so each line of a block that two documents have in common
lies in a run that both give. A run is paired with its first holder (the smallest doc_id), so pairs number at most
two a line and a block whose runs have different first holders is still found, run by run.

Each document is aligned with each of its first holders by patience diff on the runs they share: runs that occur
once in the document are the anchors, a longest increasing subsequence of them is the alignment, and anchors on
one diagonal that touch grow into a block. Runs off that alignment (moved or repeated ones) are aligned by
themselves, each diagonal its own. All blocks are deleted from the later document: these are all lines that alignment with
every earlier document deletes. Only places of shared runs are shipped to a pair, never whole documents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import explode_text, materialize, packed

MIN_LINE_CHARS = 24
MIN_BLOCK_CHARS = 60
PRIME, BASE = (1 << 61) - 1, 0x1C3A5D7E9B2F4681


def longest_increasing(places: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, x in enumerate(places):
        p = bisect_left(tails, x)
        back.append(last[p - 1] if p else -1)
        tails[p : p + 1], last[p : p + 1] = [x], [k]
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(k)
        k = back[k]
    return chain[::-1]


def grown(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs (start in a, start in b, length) that touch or overlap on one diagonal, as blocks."""
    out: list[list[int]] = []
    for a, b, n in sorted(runs, key=lambda r: (r[1] - r[0], r[1])):
        if out and out[-1][1] - out[-1][0] == b - a and b <= out[-1][1] + out[-1][2]:
            out[-1][2] = max(out[-1][2], b + n - out[-1][1])
        else:
            out.append([a, b, n])
    return sorted((tuple(x) for x in out), key=lambda r: (r[1], r[0]))


def align(runs: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(aligned blocks in order, moved or repeated blocks) of the runs (start in a, start in b, length) two documents share."""
    often = Counter((a, n) for a, _, n in runs)
    anchors = sorted((r for r in runs if often[r[0], r[2]] == 1), key=lambda r: (r[1], r[2], r[0]))
    chosen = [anchors[k] for k in longest_increasing([r[0] for r in anchors])]
    blocks = grown(chosen)
    held: dict[int, list[tuple[int, int]]] = {}  # by diagonal: (first line, line after the last), apart and in order
    for a, b, n in blocks:
        held.setdefault(b - a, []).append((b, b + n))

    def inside(a: int, b: int, n: int) -> bool:
        on = held.get(b - a, [])
        k = bisect_right(on, (b, 1 << 62)) - 1
        return k >= 0 and b + n <= on[k][1]

    return blocks, grown([r for r in runs if not inside(*r)])


def _shapes(docs: DataFrame) -> DataFrame:
    """doc_id, th (xxhash64 of the text), h and size (hashes and lengths of the lines), once a document and text."""
    split = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.transform(F.split("text", "\n"), lambda x: F.trim(x)).alias("l"))
    shape = split.select("doc_id", "th", F.transform("l", lambda x: F.xxhash64(x)).alias("h"), F.transform("l", lambda x: F.length(x)).alias("size"))
    return shape.dropDuplicates(["doc_id", "th"])


def shortest_runs(size: list[int], min_line_chars: int, min_block_chars: int) -> set[tuple[int, int]]:
    """(first line, line after the last) of the shortest runs that count, from each line on and back from each line."""
    out, n = set(), len(size)
    for places, back in ((range(n), False), (range(n - 1, -1, -1), True)):
        ahead = iter(places)
        chars = long = held = 0
        for i in places:
            while held < n and (chars < min_block_chars or not long):
                x = size[next(ahead)]
                chars, long, held = chars + x, long + (x >= min_line_chars), held + 1
            if chars < min_block_chars or not long:
                break
            out.add((n - held, i + 1) if back else (i, held))
            chars, long = chars - size[i], long - (size[i] >= min_line_chars)
    return out


def _runs(cols: list[list], min_line_chars: int, min_block_chars: int) -> list:
    made: list[list] = [[], [], [], [], []]
    for doc_id, th, h, size in zip(*cols, strict=True):
        runs = shortest_runs(size, min_line_chars, min_block_chars)
        if not runs:
            continue
        prefix, power = [0], [1]  # a run's hash from those of its ends, however long it is
        for x in h:
            prefix.append((prefix[-1] * BASE + x) % PRIME)
            power.append(power[-1] * BASE % PRIME)
        for i, j in runs:
            for to, x in zip(made, (doc_id, th, (prefix[j] - prefix[i] * power[j - i]) % PRIME, i, j - i), strict=True):
                to.append(x)
    return made


KEPT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())]))
BLOCKS = T.ArrayType(T.StructType([T.StructField("earlier", T.LongType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("moved", T.BooleanType())]))


def _aligned(cols: list[list]) -> list:
    made: list[list] = [[], [], [], [], []]
    for doc_id, th, runs in zip(*cols, strict=True):
        pairs: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for r in runs:
            pairs.setdefault((r["first"], r["first_th"]), []).append((r["a"], r["b"], r["n"]))
        blocks = []
        for (earlier, _), shared in sorted(pairs.items()):
            for moved, found in enumerate(align(shared)):
                blocks += [{"earlier": earlier, "a": a, "b": b, "n": n, "moved": bool(moved)} for a, b, n in found]
        left, kept, gone = 0, [], 0  # between the blocks, however they overlap
        for b, n in sorted((x["b"], x["n"]) for x in blocks):
            if b > left:
                kept.append({"start": left, "n": b - left})
            gone += max(0, b + n - max(b, left))
            left = max(left, b + n)
        kept.append({"start": left, "n": 1 << 30})
        for to, x in zip(made, (doc_id, th, blocks, kept, gone), strict=True):
            to.append(x)
    return made


def aligned_blocks(docs: DataFrame, min_line_chars: int = MIN_LINE_CHARS, min_block_chars: int = MIN_BLOCK_CHARS) -> DataFrame:
    """doc_id, th (xxhash64 of the text), blocks, kept and gone, for documents that share a block with an earlier one.

    blocks: (earlier doc_id, its first line a, first line b here, lines n, moved) of each aligned block, by earlier
    document; kept: (first line, lines) of the stretches between them, the last open; gone: how many lines the blocks cover. A document's runs meet in one row, however many
    documents it shares them with; documents of any length are read whole.
    """
    keys = [("doc_id", T.LongType()), ("th", T.LongType())]
    fields = [*keys, ("run", T.LongType()), ("i", T.IntegerType()), ("n", T.IntegerType())]
    runs = materialize(explode_text(_shapes(docs), ["doc_id", "th", "h", "size"], fields, lambda cols: _runs(cols, min_line_chars, min_block_chars)), "line-runs")
    first = runs.groupBy("run", "n").agg(F.min(F.struct("doc_id", "th", "i")).alias("f"), F.max("doc_id").alias("last")).filter("f.doc_id < last")
    first = first.select("run", "n", F.col("f.doc_id").alias("first"), F.col("f.th").alias("first_th"), F.col("f.i").alias("a"))
    first = materialize(first, "line-first").hint("merge")  # both sides are plain shuffles, so a common run's rows can be split
    found = runs.join(first, ["run", "n"]).filter("first < doc_id")
    found = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "first_th", "a", F.col("i").alias("b"), "n")).alias("runs"))
    return explode_text(found, ["doc_id", "th", "runs"], [*keys, ("blocks", BLOCKS), ("kept", KEPT), ("gone", T.LongType())], _aligned)


def dedup_lines(docs: DataFrame, min_line_chars: int = MIN_LINE_CHARS, min_block_chars: int = MIN_BLOCK_CHARS) -> DataFrame:
    """`docs` with __lines and __gone (counts) added and text without the lines of aligned blocks.

    Null texts and rows with a null doc_id stay as they are. Rows that share a doc_id are no copies of each
    other (neither is later); they are told apart by their text, and repeated rows are treated alike. Of copies the
    one with the smallest id stays. Lines are compared without blanks around them and joined again by \\n as they
    were; texts of any length are read whole. Other columns stay, whatever their names; those named like a count
    give way to it. An empty table gives none.
    """
    gone = aligned_blocks(docs, min_line_chars, min_block_chars).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), "kept", "gone")
    gone = materialize(gone, "line-gone")
    rows = packed(docs, F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("th"))
    # always a merge join: texts are shuffled once at any size, so cost stays in proportion
    both = rows.join(gone.hint("merge"), (F.col("doc_id") == F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left")
    text = F.col("row.text")
    lines = F.split(text, "\n")
    # stretches are sliced, so a document of very many lines costs no more than its length
    kept = F.array_join(F.flatten(F.transform("kept", lambda x: F.slice(lines, x["start"] + 1, x["n"]))), "\n")
    made = {
        "text": F.when(F.col("gone").isNull(), text).otherwise(kept),
        "__lines": F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "__gone": F.coalesce("gone", F.lit(0)),
    }
    names = [*[c for c in docs.columns if c not in ("__lines", "__gone")], "__lines", "__gone"]
    return both.select(*[made[c].alias(c) if c in made else F.col(f"row.`{c}`") for c in names])


def drop_duplicate_lines(docs: DataFrame) -> DataFrame:
    """The pipeline's form: texts without deleted lines (n_chars follows); documents of which only blanks are left go.

    Columns stay as they are, apart from these two; the rest is as in `dedup_lines`.
    """
    done = dedup_lines(docs)
    left = (F.col("__gone") == 0) | (F.length(F.trim(F.col("text"))) > 0)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("__gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.filter(left).select([F.col(f"`{c}`") for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, deleted lines and the digest of the kept text of every document (null text: null digest)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = dedup_lines(docs)
    return done.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
