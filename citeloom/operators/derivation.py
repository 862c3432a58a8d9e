"""Embeddings, identities and digests of derived data, and the sinks that reuse what exists."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical_object


def deterministic_vector(text: str, dimensions: int) -> np.ndarray:
    """Unit vector from the SHAKE-256 stream of the text, 16 bits a component."""
    raw = np.frombuffer(hashlib.shake_256(text.encode()).digest(2 * dimensions), ">u2").astype(np.float64)
    values = raw / 32767.5 - 1.0
    return values / (np.sqrt((values * values).sum()) or 1.0)


def embed(rows: DataFrame, text: str, dimensions: int = 64) -> DataFrame:
    """`rows` with `vector`; a null text has a null vector."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda s: None if s is None else deterministic_vector(s, dimensions).tolist())

    return rows.withColumn("vector", vectors(F.col(text)))


def chunk_set_digests(chunks: DataFrame) -> DataFrame:
    """doc_id, n_chunks, digest: SHA-256 over ordinal NUL checksum LF of the chunks in order. A document's chunks meet in one task."""
    line = F.concat(F.col("ordinal").cast("string"), F.lit("\0"), F.sha2("content", 256), F.lit("\n"))
    held = F.array_sort(F.collect_list(F.struct(F.col("ordinal").alias("o"), line.alias("v"))))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sha2(F.array_join(F.transform(held, lambda x: x["v"]), ""), 256).alias("digest"))


def population_digests(sets: DataFrame, by: str) -> DataFrame:
    """by, n_documents, digest: SHA-256 over source_key NUL chunk_set_id NUL digest LF of the members by source key.

    The digest is one hash over all members in order, so a population passes through one task; it is sorted there (and
    spilled) and streamed, a member at a time, so that nothing but the hash is held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, h = None, 0, hashlib.sha256()
        for f in frames:
            for k, *member in zip(f["by"], f["source_key"], f["chunk_set_id"], f["digest"], strict=True):
                if n and k != key:
                    yield pd.DataFrame({"by": [key], "n": [n], "digest": [h.hexdigest()]})
                    n, h = 0, hashlib.sha256()
                key, n = k, n + 1
                h.update("\0".join(member).encode() + b"\n")
        if n:
            yield pd.DataFrame({"by": [key], "n": [n], "digest": [h.hexdigest()]})

    rows = sets.select(F.col(by).alias("by"), "source_key", "chunk_set_id", "digest").repartition("by").sortWithinPartitions("by", "source_key", "chunk_set_id")
    kind = dict(sets.dtypes)[by]
    return rows.mapInPandas(run, f"by {kind}, n long, digest string").select(F.col("by").alias(by), F.col("n").alias("n_documents"), "digest")


def ambiguous_members(sets: DataFrame, by: str) -> DataFrame:
    """Members whose source key occurs more than once in their population: no digest of it is authoritative."""
    return sets.groupBy(by, "source_key").agg(F.count("*").alias("n")).filter("n > 1")


def reuse_or_create(prepared: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """`prepared` with outcome: reused where the key exists, created else."""
    known = existing.select(*key).distinct().withColumn("__known", F.lit(True))
    return prepared.join(known, key, "left").withColumn("outcome", F.when(F.col("__known"), "reused").otherwise("created")).drop("__known")


def missing(prepared: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """What a sink still has to append; appending it twice appends nothing the second time."""
    return prepared.join(existing.select(*key).distinct(), key, "left_anti").dropDuplicates(key)


def identities(docs: DataFrame) -> DataFrame:
    """doc_id, checksum, first_doc_id, is_duplicate: documents of equal text share the first one's identity."""
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))
    first = rows.groupBy("checksum").agg(F.min("doc_id").alias("first_doc_id"))
    return rows.join(first, "checksum").select("doc_id", "checksum", "first_doc_id", (F.col("doc_id") != F.col("first_doc_id")).alias("is_duplicate"))


def cutover_gaps(members: DataFrame) -> DataFrame:
    """source_key, gap: a row for each thing that keeps a corpus from its cutover.

    `members`: source_key, before_digest, after_digest, complete, vectors_new, v1_immutable. Gaps: PENDING, CHUNK_SET_CHANGED,
    V2_VECTOR_NOT_NEW, V1_MUTATED, and DUPLICATE_MEMBER for a source key that occurs more than once.
    """
    said = F.array_compact(
        F.array(
            F.when(~F.col("complete"), F.lit("PENDING")),
            F.when(F.col("before_digest") != F.col("after_digest"), F.lit("CHUNK_SET_CHANGED")),
            F.when(~F.col("vectors_new"), F.lit("V2_VECTOR_NOT_NEW")),
            F.when(~F.col("v1_immutable"), F.lit("V1_MUTATED")),
        )
    )
    twice = members.groupBy("source_key").agg(F.count("*").alias("n")).filter("n > 1")
    return members.select("source_key", F.explode(said).alias("gap")).union(twice.select("source_key", F.lit("DUPLICATE_MEMBER")))


def cutover(members: DataFrame) -> DataFrame:
    """One row: allowed, n_members and the number of gaps of each kind; gaps themselves stay rows (`cutover_gaps`). No members, no cutover."""
    gaps = cutover_gaps(members)
    counts = gaps.agg(F.count_if(F.col("gap") == "PENDING").alias("n_pending"), F.count_if(F.col("gap") != "PENDING").alias("n_violations"))
    total = members.agg(F.count("*").alias("n_members")).crossJoin(counts)
    return total.select(((F.col("n_members") > 0) & (F.col("n_pending") == 0) & (F.col("n_violations") == 0)).alias("allowed"), "n_members", "n_pending", "n_violations")


def derivation_identity(**configuration: Column) -> Column:
    """The identity of a derivation: SHA-256 over the canonical JSON of its configuration."""
    return F.sha2(canonical_object(**configuration), 256)


def derivation_breaches(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, rule: pages (doc_id, page_number, text, checksum) and chunks (doc_id, ordinal, page_number, start, end, content, checksum, token_count) that do not bear each other out."""
    page_rules = {"page number": F.col("page_number") >= 1, "page checksum": F.col("checksum") == F.sha2("text", 256)}
    twice = pages.groupBy("doc_id", "page_number").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit("page once").alias("rule"))
    rows = chunks.join(pages.select("doc_id", "page_number", "text"), ["doc_id", "page_number"], "left")
    chunk_rules = {
        "page": F.col("text").isNotNull(),
        "offsets": (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text")),
        "content": F.col("content") == F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")),
        "checksum": F.col("checksum") == F.sha2("content", 256),
        "tokens": F.col("token_count") > 0,
    }
    gaps = chunks.groupBy("doc_id").agg((F.min("ordinal") == 0).alias("a"), (F.max("ordinal") == F.count("*") - 1).alias("b"), (F.count_distinct("ordinal") == F.count("*")).alias("c"))
    said = lambda rules: F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))).alias("rule")
    return pages.select("doc_id", said(page_rules)).union(twice).union(rows.select("doc_id", said(chunk_rules))).union(gaps.filter("NOT (a AND b AND c)").select("doc_id", F.lit("ordinals")))


def active_corpus(documents: DataFrame, versions: DataFrame, chunk_sets: DataFrame, chunks: DataFrame, embedding_sets: DataFrame, embeddings: DataFrame, configuration: str) -> DataFrame:
    """The chunks that can be searched: those of documents whose active, completed embedding set has this configuration.

    documents (document_id, workspace_id, source_key, version_id, embedding_set_id) to versions (version_id, document_id), chunk
    sets (chunk_set_id, version_id), embedding sets (embedding_set_id, chunk_set_id, configuration_id, status), chunks
    (chunk_id, chunk_set_id, ordinal, content) and embeddings (chunk_id, embedding_set_id, vector): five equi-joins on keys; the
    filters are below the joins.
    """
    ready = embedding_sets.filter((F.col("configuration_id") == configuration) & (F.col("status") == "completed")).select("embedding_set_id", "chunk_set_id")
    rows = documents.join(ready, "embedding_set_id").join(chunk_sets, "chunk_set_id").join(versions, ["version_id", "document_id"])
    return rows.join(chunks, "chunk_set_id").join(embeddings, ["chunk_id", "embedding_set_id"])


def unresolved_candidates(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Trace candidates (query_id, workspace_id, chunk_id) that the active corpus of their workspace does not hold."""
    return candidates.join(corpus.select("workspace_id", "chunk_id"), ["workspace_id", "chunk_id"], "left_anti")


def reembedding_plan(members: DataFrame, existing: DataFrame) -> DataFrame:
    """by workspace: members, those still to embed, and whether activation and the gate may follow (all of them embedded, none repeated).

    `members`: workspace_id, source_key, chunk_set_id; `existing`: chunk_set_id of sets embedded under the new configuration.
    Vectors are written first (`missing` gives what to write), pointers move after all exist, the gate opens last.
    """
    rows = members.join(existing.select("chunk_set_id").distinct().withColumn("__has", F.lit(True)), "chunk_set_id", "left")
    counts = rows.groupBy("workspace_id").agg(F.count("*").alias("n_members"), F.count_if(F.col("__has").isNull()).alias("to_embed"), F.count_distinct("source_key").alias("keys"))
    return counts.select("workspace_id", "n_members", "to_embed", ((F.col("to_embed") == 0) & (F.col("keys") == F.col("n_members"))).alias("may_activate"))


def pair_digest(pairs: DataFrame) -> DataFrame:
    """One row: n_pairs and the digest over the pairs' digests in order; `pairs`: left_id, right_id, exact, overlap. Streamed through one task, as population digests are."""
    said = canonical_object(calibration_item_id=F.col("left_id"), development_item_id=F.col("right_id"), exact_normalized_copy=F.col("exact"), normalized_token_overlap=F.format_string("%.12f", "overlap"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, h = 0, hashlib.sha256()
        for f in frames:
            for d in f["d"]:
                h.update(("\n" if n else "").encode() + d.encode())
                n += 1
        yield pd.DataFrame({"n_pairs": [n], "digest": [h.hexdigest()]})

    rows = pairs.select("left_id", "right_id", F.sha2(said, 256).alias("d")).repartition(1).sortWithinPartitions("left_id", "right_id")
    return rows.mapInPandas(run, "n_pairs long, digest string")
