"""Versioned tables: Spark writes data files under names of their own, and a small manifest makes them a version.

A version is the file `versions/<number>.json`, which names the folders of its rows. It is staged under another name and
then linked or renamed to its place where none may be, so of two writers that both follow version n one makes n + 1 and the
other gets `Conflict` and leaves nothing behind. Readers are pinned to the folders of the version they opened; no folder
of a version is ever changed. The atomic step is a hard link on a local file system and a rename without overwrite elsewhere
(atomic where the store's rename is, as on HDFS).
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


TRIES = 20  # of an optimistic writer


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); where it is unset, a temporary one in local runs and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="citeloom-")


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class Files:
    """The few calls that the protocol needs of the file system that holds a folder, as Spark sees it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def publish(self, staged: str, name: str) -> bool:
        """Move a staged file to a name that must be free; False if it is taken."""
        if self.fs.getScheme() == "file":
            local = lambda n: self.jvm.java.nio.file.Paths.get(self.path(n).toUri().getPath(), self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("java.lang.String"), 0))
            try:
                self.jvm.java.nio.file.Files.createLink(local(name), local(staged))
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                    return False
                raise
            finally:
                self.delete(staged)
            return True
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)
        try:
            context.rename(self.path(staged), self.path(name), self._no_overwrite())
        except Py4JJavaError as e:
            self.delete(staged)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _no_overwrite(self):
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        return options


class VersionedTable:
    """A table of numbered versions in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str):
        self.spark, self.root = spark, root
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.files = Files(spark, root)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.root}/versions") if n.endswith(".json") and n[:-5].isdigit()]

    def latest(self) -> int:
        """The number of the last version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.root}/versions/{version:020d}.json")) if version else {"version": 0, "data": [], "said": {}}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last, if none is named), whatever is written meanwhile."""
        folders = [f"{self.root}/{d}" for d in self.manifest(self.latest() if version is None else version)["data"]]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame | None, after: int, replace: bool = False, said: dict | None = None) -> int:
        """Make the version that follows `after`: its rows and `rows`, or `rows` alone with `replace`. `said` is added to what the manifest before says.

        Raises Conflict if `after` is not the last version any more; the data files written for it are deleted. What a writer
        leaves that dies in between is read by nobody and goes with `vacuum`.
        """
        if self.latest() != after:
            raise Conflict(f"version {after} is not the last one")
        names = [f.name for f in self.schema.fields]
        data, folder = [] if replace else list(self.manifest(after)["data"]), f"data/{uuid.uuid4().hex}"
        if rows is not None:
            rows.select(names).to(self.schema).write.parquet(f"{self.root}/{folder}")
            data.append(folder)
        manifest = {"version": after + 1, "data": data, "said": self.manifest(after)["said"] | (said or {})}
        staged = f"{self.root}/versions/.staged-{uuid.uuid4().hex}"
        self.files.write(staged, json.dumps(manifest, sort_keys=True, separators=(",", ":")))
        if not self.files.publish(staged, f"{self.root}/versions/{after + 1:020d}.json"):
            if rows is not None:
                self.files.delete(f"{self.root}/{folder}")
            raise Conflict(f"version {after + 1} was made by another writer")
        return after + 1

    def compact(self) -> int:
        """A version with the rows of the last one in one folder; a version that is made meanwhile is a Conflict."""
        after = self.latest()
        return self.commit(self.read(after), after, replace=True) if after else 0

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete data folders that none of the last `keep` versions names, and staged manifests; returns their names. Only while no writer runs."""
        used = {d for v in self.versions()[-keep:] for d in self.manifest(v)["data"]}
        gone = [d for n in self.files.names(f"{self.root}/data") if (d := f"data/{n}") not in used]
        gone += [f"versions/{n}" for n in self.files.names(f"{self.root}/versions") if n.startswith(".staged-")]
        for d in gone:
            self.files.delete(f"{self.root}/{d}")
        return gone


def once(table: VersionedTable, stream: str) -> Callable[[DataFrame, int], None]:
    """A writer for foreachBatch that adds each batch of a stream once, however often it is handed in.

    The rows of a batch and its number become visible in one step, as both are in the manifest of the version: a crash before it
    leaves neither, a replay after it finds the number and adds nothing. Several streams, and other writers, may share a table.
    """

    def write(rows: DataFrame, batch: int) -> None:
        for _ in range(TRIES):
            after = table.latest()
            done = table.manifest(after)["said"].get("batches", {})
            if done.get(stream, -1) >= batch:
                return
            try:
                table.commit(rows, after, said={"batches": done | {stream: batch}})
                return
            except Conflict:
                continue
        raise Conflict(f"{TRIES} conflicts in a row")

    return write


def derive(table: VersionedTable, prepared: DataFrame, key: list[str]) -> tuple[int, DataFrame]:
    """The derivation sink: append the prepared rows whose key the table does not hold, and say of each key what was done.

    Returns the version that holds them all and `key`, outcome (reused or created), judged on the version that was followed, so
    a lost race is judged again. Rows that repeat a key are one; nothing new makes no version.
    """
    for _ in range(TRIES):
        followed = table.latest()
        rows = prepared.join(table.read(followed).select(*key).distinct(), key, "left_anti").dropDuplicates(key)
        try:
            version = followed if rows.isEmpty() else table.commit(rows, followed)
            break
        except Conflict:
            continue
    else:
        raise Conflict(f"{TRIES} conflicts in a row")
    known = table.read(followed).select(*key).distinct().withColumn("__known", F.lit(True))
    outcome = F.when(F.col("__known"), "reused").otherwise("created")
    return version, prepared.select(*key).distinct().join(known, key, "left").select(*key, outcome.alias("outcome"))


def activate(active: VersionedTable, wanted: DataFrame, ready: DataFrame) -> tuple[int, DataFrame]:
    """Move pointers (document_id to set_id) to `wanted` in one version, if all of its sets are in `ready` (set_id).

    Rows of `wanted` whose document has a pointer other than `expected_set_id` (null: none yet) are stale and stay as they are,
    where that column is given. Returns the version and document_id, set_id, activation_changed. Some set that is not ready
    raises, and nothing moves.
    """
    lacking = wanted.join(ready.select("set_id").distinct(), "set_id", "left_anti")
    if not lacking.isEmpty():
        raise ValueError("some sets are not complete; no pointer was moved")
    for _ in range(TRIES):
        before = active.latest()
        rows = active.read(before).select("document_id", F.col("set_id").alias("__old")).join(wanted, "document_id", "full_outer")
        fresh = F.col("set_id").isNotNull()
        if "expected_set_id" in wanted.columns:
            fresh = fresh & F.col("__old").eqNullSafe(F.col("expected_set_id"))
        rows = rows.withColumn("set_id", F.when(fresh, F.col("set_id")).otherwise(F.col("__old")))
        try:
            version = active.commit(rows.filter("set_id IS NOT NULL"), before, replace=True)
            break
        except Conflict:
            continue
    else:
        raise Conflict(f"{TRIES} conflicts in a row")
    old = active.read(before).select("document_id", F.col("set_id").alias("__old"))
    rows = wanted.select("document_id").join(active.read(version), "document_id", "left").join(old, "document_id", "left")
    return version, rows.select("document_id", "set_id", (~F.col("set_id").eqNullSafe(F.col("__old"))).alias("activation_changed"))
