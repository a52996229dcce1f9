"""Snapshots: whole or not at all, replays, conflicts, partitions that stay."""

import pytest
from pyspark.sql import functions as F

from laminaflow.sources import snapshots


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, day string, seen int, v double")


def content(spark, path, version=None):
    return sorted((r.id, r.day, r.seen, r.v) for r in snapshots.read(spark, path, version).collect())


def put(spark, path, name, *rows, **more):
    return snapshots.upsert(spark, path, batch(spark, *rows), ["id"], F.col("seen"), name, "day", **more)


def test_upsert_replay_and_time_travel(spark, tmp_path):
    path = str(tmp_path / "t")
    assert put(spark, path, "b1", (1, "mon", 1, 1.0), (2, "tue", 1, float("nan")))
    assert put(spark, path, "b2", (1, "mon", 2, 5.0), (3, "mon", 1, 3.0), (2, "tue", 0, 9.0))
    wanted = [(1, "mon", 2, 5.0), (2, "tue", 1, None), (3, "mon", 1, 3.0)]
    assert content(spark, path) == wanted
    assert not put(spark, path, "b1", (1, "mon", 7, 7.0)) and content(spark, path) == wanted
    assert content(spark, path, 1) == [(1, "mon", 1, 1.0), (2, "tue", 1, None)]


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, "b1", (1, "mon", 1, 1.0), (2, "tue", 1, 2.0))
    before = snapshots.manifest(spark, path)["parts"]
    put(spark, path, "b2", (3, "tue", 1, 3.0))
    after = snapshots.manifest(spark, path)["parts"]
    assert len(before) == len(after) == 2 and len(set(before.values()) & set(after.values())) == 1
    assert snapshots.vacuum(spark, path, keep=1) == 0 and content(spark, path) == [(1, "mon", 1, 1.0), (2, "tue", 1, 2.0), (3, "tue", 1, 3.0)]


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put(spark, path, "b1", (1, "mon", 1, 1.0))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # rows are written, the manifest is not
        m.setattr(snapshots, "_publish", die)
        with pytest.raises(KeyboardInterrupt):
            put(spark, path, "b2", (1, "mon", 2, 2.0), (2, "tue", 1, 2.0))
    assert content(spark, path) == [(1, "mon", 1, 1.0)] and snapshots.versions(spark, path) == [1]
    assert put(spark, path, "b2", (1, "mon", 2, 2.0), (2, "tue", 1, 2.0))
    assert content(spark, path) == [(1, "mon", 2, 2.0), (2, "tue", 1, 2.0)]
    assert snapshots.vacuum(spark, path, keep=1) == 2  # what the dead writer left and the first snapshot
    assert content(spark, path) == [(1, "mon", 2, 2.0), (2, "tue", 1, 2.0)]


def test_a_second_writer_of_the_same_version_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put(spark, path, "b1", (1, "mon", 1, 1.0))
    old = snapshots.manifest(spark, path)
    put(spark, path, "b2", (2, "mon", 1, 2.0))
    with monkeypatch.context() as m:  # began before b2 was there
        m.setattr(snapshots, "manifest", lambda *a, **k: old)
        with pytest.raises(snapshots.Conflict):
            put(spark, path, "b3", (3, "mon", 1, 3.0))
    assert [r[0] for r in content(spark, path)] == [1, 2]
    assert put(spark, path, "b3", (3, "mon", 1, 3.0)) and [r[0] for r in content(spark, path)] == [1, 2, 3]


def test_more_columns_and_no_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.versions(spark, path) == []
    with pytest.raises(ValueError):
        snapshots.read(spark, path)
    one = spark.createDataFrame([(1, 1, "a")], "id int, seen int, x string")
    two = spark.createDataFrame([(1, 2, 5), (2, 1, None)], "id int, seen int, y int")
    snapshots.upsert(spark, path, one, ["id"], F.col("seen"), "a")
    snapshots.upsert(spark, path, two, ["id"], F.col("seen"), "b")
    assert sorted((r.id, r.seen, r.x, r.y) for r in snapshots.read(spark, path).collect()) == [(1, 2, "a", 5), (2, 1, None, None)]
    snapshots.upsert(spark, path, two.limit(0), ["id"], F.col("seen"), "nothing")
    assert snapshots.read(spark, path).count() == 2
