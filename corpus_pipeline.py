"""From raw documents to a training mix: five stages, each an operator of citeloom.llm over all that is left.

Every stage gets the documents its predecessor kept (read from Parquet) and returns those it keeps with the
columns of `documents`; the last returns the mix: how many words of each document it takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm.common import discard, materialize
from citeloom.llm.decontaminate import drop_leaked
from citeloom.llm.line_dedup import drop_duplicate_lines
from citeloom.llm.mix_sources import mix, sized_documents
from citeloom.llm.quality import keep_good
from citeloom.llm.simhash_dedup import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; documents of which nothing is left go."""
    return drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target and taken (words) of each document."""
    return mix(sized_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
]

#: Classifier, fingerprints and edit distances have no SQL form; a test holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)  # only what a stage wrote
    return docs
