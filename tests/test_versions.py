"""Versioned tables: races, crashes, pinned readers, the derivation sink and activation."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from citeloom.sources import versions as ve


def ids(df):
    return sorted(r[0] for r in df.select("k").collect())


def frame(spark, *keys):
    return spark.createDataFrame([(k, str(k)) for k in keys], "k long, v string")


@pytest.fixture
def table(spark, tmp_path):
    return ve.VersionedTable(spark, str(tmp_path / "t"), "k long, v string")


def test_versions_append_and_replace(spark, table):
    assert table.latest() == 0 and ids(table.read()) == []
    assert table.commit(frame(spark, 1, 2), 0) == 1
    assert table.commit(frame(spark, 3), 1, said={"why": "more"}) == 2
    assert table.commit(frame(spark, 9), 2, replace=True) == 3
    assert [ids(table.read(v)) for v in (0, 1, 2, 3)] == [[], [1, 2], [1, 2, 3], [9]]
    assert table.manifest(2)["said"] == {"why": "more"}


def test_a_late_writer_conflicts_and_leaves_nothing(spark, table, tmp_path):
    table.commit(frame(spark, 1), 0)
    with pytest.raises(ve.Conflict):
        table.commit(frame(spark, 2), 0)
    assert len(os.listdir(tmp_path / "t" / "data")) == 1 and table.latest() == 1


def test_of_racing_writers_one_makes_the_version(spark, table, tmp_path, monkeypatch):
    """All have written their data before any publishes its manifest."""
    n, gate, publish = 4, threading.Barrier(4), ve.Files.publish

    def together(self, staged, name):
        gate.wait(60)
        return publish(self, staged, name)

    monkeypatch.setattr(ve.Files, "publish", together)
    done = []

    def write(k):
        try:
            done.append((k, table.commit(frame(spark, k), 0)))
        except ve.Conflict:
            done.append((k, None))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(n)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [k for k, v in done if v == 1]
    assert len(done) == n and len(winners) == 1 and ids(table.read()) == winners
    assert len(os.listdir(tmp_path / "t" / "data")) == 1
    assert [x for x in os.listdir(tmp_path / "t" / "versions") if "staged" in x] == []


def test_readers_stay_on_their_version(spark, table):
    table.commit(frame(spark, 1), 0)
    reader = table.read()
    table.commit(frame(spark, 2), 1)
    table.commit(frame(spark, 3), 2, replace=True)
    assert ids(reader) == [1] and ids(table.read()) == [3]


def test_a_writer_that_dies_before_its_manifest_is_not_seen(spark, table, tmp_path, monkeypatch):
    table.commit(frame(spark, 1), 0)
    with monkeypatch.context() as m:
        m.setattr(ve.Files, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.commit(frame(spark, 2), 1)
    assert ids(table.read()) == [1] and table.latest() == 1
    assert len(table.vacuum()) == 2  # its data and its staged manifest
    assert table.commit(frame(spark, 3), 1) == 2 and ids(table.read()) == [1, 3]
    assert len(os.listdir(tmp_path / "t" / "data")) == 2


def test_vacuum_keeps_what_kept_versions_name(spark, table):
    table.commit(frame(spark, 1), 0)
    table.commit(frame(spark, 2), 1, replace=True)
    assert table.vacuum(keep=2) == [] and len(table.vacuum(keep=1)) == 1
    assert ids(table.read()) == [2]


def test_derive_appends_only_what_is_new(spark, table):
    version, said = ve.derive(table, frame(spark, 1, 2, 2), ["k"])
    assert version == 1 and {r["k"]: r["outcome"] for r in said.collect()} == {1: "created", 2: "created"}
    version, said = ve.derive(table, frame(spark, 2, 3), ["k"])
    assert version == 2 and {r["k"]: r["outcome"] for r in said.collect()} == {2: "reused", 3: "created"}
    version, said = ve.derive(table, frame(spark, 1, 3), ["k"])
    assert version == 2 and {r["outcome"] for r in said.collect()} == {"reused"}
    assert ids(table.read()) == [1, 2, 3]


def test_derive_after_a_lost_race_judges_again(spark, table, monkeypatch):
    commit, raced = ve.VersionedTable.commit, []

    def lose_once(self, rows, after, *a, **k):
        if not raced:
            raced.append(1)
            commit(self, frame(spark, 2), after)
        return commit(self, rows, after, *a, **k)

    monkeypatch.setattr(ve.VersionedTable, "commit", lose_once)
    version, said = ve.derive(table, frame(spark, 1, 2), ["k"])
    assert version == 2 and {r["k"]: r["outcome"] for r in said.collect()} == {1: "created", 2: "reused"}
    assert ids(table.read()) == [1, 2]


def test_activation_moves_all_pointers_or_none(spark, tmp_path):
    active = ve.VersionedTable(spark, str(tmp_path / "a"), "document_id long, set_id string")
    wanted = spark.createDataFrame([(1, "x"), (2, "y")], "document_id long, set_id string")
    with pytest.raises(ValueError):
        ve.activate(active, wanted, spark.createDataFrame([("x",)], "set_id string"))
    assert active.latest() == 0
    ready = spark.createDataFrame([("x",), ("y",), ("z",)], "set_id string")
    version, said = ve.activate(active, wanted, ready)
    assert version == 1 and {tuple(r) for r in said.collect()} == {(1, "x", True), (2, "y", True)}
    later = spark.createDataFrame([(1, "z", "x"), (2, "z", "old"), (3, "z", None)], "document_id long, set_id string, expected_set_id string")
    version, said = ve.activate(active, later, ready)
    assert version == 2 and {tuple(r) for r in said.collect()} == {(1, "z", True), (2, "y", False), (3, "z", True)}
    assert {tuple(r) for r in active.read(1).collect()} == {(1, "x"), (2, "y")}
    version, said = ve.activate(active, wanted.filter(F.col("document_id") == 2), ready)
    assert {tuple(r) for r in said.collect()} == {(2, "y", False)}


def test_a_folder_behind_another_file_system(spark, tmp_path):
    """Spark's own path names, with a scheme."""
    table = ve.VersionedTable(spark, f"file://{tmp_path}/t", "k long, v string")
    assert table.commit(frame(spark, 1), 0) == 1 and ids(table.read()) == [1]
    files = ve.Files(spark, f"file://{tmp_path}/t")
    files.write(f"file://{tmp_path}/t/a", "1")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.root.toUri(), files.conf)
    context.rename(files.path(f"file://{tmp_path}/t/a"), files.path(f"file://{tmp_path}/t/b"), files._no_overwrite())
    assert files.read(f"file://{tmp_path}/t/b") == "1"


def test_a_replayed_batch_adds_nothing(spark, table, monkeypatch):
    write = ve.once(table, "s")
    write(frame(spark, 1), 0)
    write(frame(spark, 1), 0)
    write(frame(spark, 2), 1)
    write(frame(spark, 1), 0)
    ve.once(table, "other")(frame(spark, 7), 0)  # another stream counts for itself
    assert ids(table.read()) == [1, 2, 7]
    ve.derive(table, frame(spark, 8), ["k"])  # other writers keep what is said
    write(frame(spark, 2), 1)
    with monkeypatch.context() as m:  # the crash between the rows and their number
        m.setattr(ve.Files, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            write(frame(spark, 3), 2)
    assert ids(table.read()) == [1, 2, 7, 8]
    write(frame(spark, 3), 2)
    assert ids(table.read()) == [1, 2, 3, 7, 8]
    assert table.compact() == table.latest() and len(table.manifest(table.latest())["data"]) == 1
    write(frame(spark, 3), 2)
    assert ids(table.read()) == [1, 2, 3, 7, 8]
