"""Sources and sinks: documents and objects as files, inventories, datasets, manifests, reports and tables."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

INVENTORY = "workspace_id string, object_key string, created_at string"
M3_CASE = (
    "id string, category string, workspace_id string, question string, expected_behavior string, "
    "retrieval_relevance struct<applicable:boolean,acceptable_relevant_chunks:array<string>>, "
    "answer_expectations struct<required_facts:array<string>,reference_answer:string>, "
    "evidence_expectations struct<expected_source_documents:array<string>,acceptable_cited_chunks:array<string>>, "
    "refusal_expectation string"
)
M1_CASE = (
    "id string, category string, workspace_id string, question string, expected_behavior string, "
    "expected_source_documents array<string>, acceptable_relevant_chunks array<string>, required_facts array<string>, reference_answer string"
)


def media_type(path: Column) -> Column:
    """text/markdown, text/plain or application/pdf by suffix; null for others."""
    p = F.lower(path)
    return F.when(p.endswith(".md") | p.endswith(".markdown"), "text/markdown").when(p.endswith(".txt"), "text/plain").when(p.endswith(".pdf"), "application/pdf")


def documents(spark: SparkSession, path: str, max_bytes: int = 1 << 20) -> DataFrame:
    """source_key, media_type, text, checksum, problem: text files with why one is refused, if it is.

    Refused: another type, more than `max_bytes`, or bytes that are not UTF-8. Line ends become LF.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = media_type(F.col("path"))
    problem = F.when(kind.isNull() | (kind == "application/pdf"), "UNSUPPORTED_DOCUMENT_TYPE").when(F.col("length") > max_bytes, "DOCUMENT_TOO_LARGE").when(~F.is_valid_utf8(F.col("content").cast("string")), "INVALID_ENCODING")
    rows = files.select(tx.basename(F.col("path")).alias("source_key"), kind.alias("media_type"), problem.alias("problem"), tx.newlines(F.col("content").cast("string")).alias("t"))
    text = F.when(F.col("problem").isNull(), F.col("t"))
    return rows.select("source_key", "media_type", text.alias("text"), F.sha2(text, 256).alias("checksum"), "problem")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """object_key, length, sha256 of stored objects; any file system that Spark reads, s3a included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(tx.basename(F.col("path")).alias("object_key"), "length", F.sha2("content", 256).alias("sha256"))


def inventory(spark: SparkSession, path: str, workspace_id: str | None = None) -> DataFrame:
    """An inventory feed (JSON lines); malformed lines and times without an offset fail the read."""
    rows = spark.read.schema(INVENTORY).option("mode", "FAILFAST").json(path)
    at = F.when(F.col("created_at").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.to_timestamp("created_at")).otherwise(F.raise_error(F.lit("created_at needs an offset")).cast("timestamp"))
    rows = rows.withColumn("created_at", at)
    return rows if workspace_id is None else rows.filter(F.col("workspace_id") == workspace_id)


def cases(spark: SparkSession, path: str, schema: str = M3_CASE) -> DataFrame:
    """An evaluation dataset (JSON lines)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest, one JSON value a file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def checksum_breaches(manifest_rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Manifest entries (path, sha256) whose object is missing or differs."""
    keyed = manifest_rows.select(tx.basename(F.col("path")).alias("object_key"), F.col("sha256").alias("expected"))
    rows = keyed.join(stored.select("object_key", "sha256"), "object_key", "left")
    return rows.filter(~F.col("sha256").eqNullSafe(F.col("expected")))


def sealed_totals(entries: DataFrame, stored: DataFrame, items: int, size: int) -> DataFrame:
    """One row: items, bytes and matches of manifest entries (path, sha256) against stored objects, and whether they are the sealed totals."""
    keyed = entries.select(tx.basename(F.col("path")).alias("object_key"), F.col("sha256").alias("expected"))
    rows = keyed.join(stored.select("object_key", "length", "sha256"), "object_key", "left")
    done = rows.agg(F.count("*").alias("items"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_if(F.col("sha256").eqNullSafe(F.col("expected"))).alias("matches"))
    return done.withColumn("sealed", (F.col("items") == items) & (F.col("bytes") == size) & (F.col("matches") == F.col("items")))


def publication(stored: DataFrame) -> DataFrame:
    """One row: the number of objects, their bytes, and a digest over checksums and keys in order of the lines.

    The digest is one hash over all lines, so they pass through one task; they are sorted there and streamed.
    """

    def run(frames):
        n, size, h = 0, 0, hashlib.sha256()
        for f in frames:
            for line, length in zip(f["line"], f["length"], strict=True):
                h.update(("\n" if n else "").encode() + line.encode())
                n, size = n + 1, size + int(length)
        yield pd.DataFrame({"n_objects": [n], "bytes": [size], "digest": [h.hexdigest()]})

    lines = stored.select(F.concat_ws("  ", "sha256", "object_key").alias("line"), "length").repartition(1).sortWithinPartitions("line")
    return lines.mapInPandas(run, "n_objects long, bytes long, digest string")


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """The trace sink: rows are appended, never changed."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_once(rows: DataFrame, path: str) -> None:
    """The report sink: fails if the report exists."""
    rows.coalesce(1).write.mode("errorifexists").json(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pdf_pages(spark: SparkSession, path: str, max_pages: int = 500, max_page_bytes: int = 4 << 20, max_bytes: int = 64 << 20) -> DataFrame:
    """source_key, page_number, text of PDF files within their budgets of pages, bytes a page and bytes in all; needs the optional package pypdf on the executors."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pypdf") from e
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.lower("path").endswith(".pdf"))

    def run(frames):
        import io

        import pypdf

        for f in frames:
            rows = []
            for key, content in zip(f["source_key"], f["content"], strict=True):
                reader = pypdf.PdfReader(io.BytesIO(content))
                if len(reader.pages) > max_pages:
                    raise ValueError(f"{key}: more than {max_pages} pages")
                total = 0
                for n, page in enumerate(reader.pages, 1):
                    text = page.extract_text() or ""
                    size = len(text.encode())
                    total += size
                    if size > max_page_bytes or total > max_bytes:
                        raise ValueError(f"{key}: page {n} is too large" if size > max_page_bytes else f"{key}: the text is too large")
                    rows.append((key, n, text))
            yield pd.DataFrame(rows, columns=["source_key", "page_number", "text"])

    return files.select(tx.basename(F.col("path")).alias("source_key"), "content").mapInPandas(run, "source_key string, page_number int, text string")
