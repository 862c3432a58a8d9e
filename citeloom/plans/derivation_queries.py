"""Derived sets that are committed in versions, and the pointers that are moved to them, over the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import table
from ..sources.versions import VersionedTable, activate, derive, once, shared_folder
from ..streaming.work_queue import event_stream


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, checksum, n_chars, labelled."""
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"), "n_chars")
    return rows.join(labelled, "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


def _table(spark: SparkSession, schema: str) -> VersionedTable:
    return VersionedTable(spark, f"{shared_folder(spark)}/versioned-{uuid.uuid4().hex}", schema)


def derivation_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sink did with the set of each document: labelled documents are derived first, then all; a reader stays on the first version."""
    docs, sets = _documents(spark, sf_dir), _table(spark, "checksum string, n_chars long")
    first, _ = derive(sets, docs.filter("labelled").select("checksum", "n_chars"), ["checksum"])
    pinned = sets.read(first).select("checksum", F.lit(True).alias("pinned"))
    _, said = derive(sets, docs.select("checksum", "n_chars"), ["checksum"])
    return docs.join(said, "checksum").join(pinned, "checksum", "left").select("doc_id", "outcome", F.coalesce("pinned", F.lit(False)).alias("in_first_version"))


COMMITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT DISTINCT t FROM d WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, CASE WHEN f.t IS NULL THEN 'created' ELSE 'reused' END AS outcome, f.t IS NOT NULL AS in_first_version FROM d LEFT JOIN f USING (t)"""


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers of all documents moved to new sets; those of labelled documents were set before, and every other of these is not as the writer expects."""
    docs, active = _documents(spark, sf_dir), _table(spark, "document_id long, set_id string")
    old, new = F.concat(F.lit("r1-"), "checksum"), F.concat(F.lit("r2-"), "checksum")
    activate(active, docs.filter("labelled").select(F.col("doc_id").alias("document_id"), old.alias("set_id")), docs.select(old.alias("set_id")))
    expected = F.when(F.col("labelled") & (F.col("doc_id") % 2 == 1), "another").when(F.col("labelled"), old)
    _, said = activate(active, docs.select(F.col("doc_id").alias("document_id"), new.alias("set_id"), expected.alias("expected_set_id")), docs.select(new.alias("set_id")))
    return said


ACTIVATIONS_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS s, doc_id % 2 = 1 AND doc_id IN (SELECT doc_id FROM labels) AS stale FROM documents)
SELECT doc_id AS document_id, CASE WHEN stale THEN 'r1-' ELSE 'r2-' END || s AS set_id, NOT stale AS activation_changed FROM d"""


def events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type after a stream of them has run into the exactly-once sink twice, the second time without its checkpoint."""
    base, kept = f"{shared_folder(spark)}/once-{uuid.uuid4().hex}", _table(spark, "event_id long, event_type string")
    for run in range(2):  # the second run hands in the same batches again
        query = event_stream(spark, sf_dir).select("event_id", "event_type").writeStream.foreachBatch(once(kept, "events")).option("checkpointLocation", f"{base}/{run}").trigger(availableNow=True).start()
        query.awaitTermination()
    return kept.read().groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_distinct"))


ONCE_SQL = "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM events GROUP BY event_type"


QUERIES = {f.__name__: f for f in (derivation_commits, activations, events_once)}

ORACLE_SQL = {"derivation_commits": COMMITS_SQL, "activations": ACTIVATIONS_SQL, "events_once": ONCE_SQL}
