"""Replacing a table as a whole: readers and writers that die."""

import pytest
from pyspark.sql import functions as F

from answerlab.sources import versions


def rows(spark, table, **options):
    return sorted(tuple(r) for r in versions.read_current(spark, table, **options).collect())


def frame(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}", [i]) for i in ids], "id int, `a b` string, v array<int>")


def test_versions_replace_each_other(spark, tmp_path):
    table = str(tmp_path / "t")
    assert versions.current_version(spark, table) is None
    with pytest.raises(ValueError, match="no version"):
        versions.read_current(spark, table)
    assert versions.replace_table(frame(spark, 1, 2), table) == 1
    held = versions.read_current(spark, table)
    # Made from itself, as an in-place save is.
    assert versions.replace_table(held.withColumn("metric", F.col("id") * 0.5), table, expected=1) == 2
    assert rows(spark, table) == [(1, "t1", [1], 0.5), (2, "t2", [2], 1.0)]
    assert versions.read_current(spark, table).columns == ["id", "a b", "v", "metric"]
    # A reader of the old version is not disturbed.
    assert held.count() == 2 and rows(spark, table, version=1) == [(1, "t1", [1]), (2, "t2", [2])]
    assert versions.replace_table(frame(spark), table) == 3
    assert rows(spark, table) == [] and versions.read_current(spark, table).columns == ["id", "a b", "v"]


@pytest.mark.parametrize("step", ["data", "write", "move"])
def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch, step):
    table = str(tmp_path / "t")
    versions.replace_table(frame(spark, 1), table)

    def die(*_, **__):
        raise KeyboardInterrupt(step)

    with monkeypatch.context() as killed:
        if step == "data":
            broken = frame(spark, 5).withColumn("x", F.raise_error(F.lit("dies")).cast("int"))
        else:
            killed.setattr(versions._Store, step, die)
            broken = frame(spark, 5)
        with pytest.raises(BaseException):  # noqa: B017 - of Spark or the one above
            versions.replace_table(broken, table)
    assert rows(spark, table) == [(1, "t1", [1])] and versions.current_version(spark, table) == 1
    assert versions.replace_table(frame(spark, 6), table) == 2 and rows(spark, table) == [(6, "t6", [6])]
    # What it left is removed once it is old enough, and not before.
    assert not any("data" in name and "0002" in name for name in versions.remove_old(spark, table, keep=2))
    versions.remove_old(spark, table, keep=2, unfinished_seconds=-60)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2
    assert not list((tmp_path / "t" / "versions").glob("*.tmp"))
    assert rows(spark, table, version=1) == [(1, "t1", [1])]


def test_a_writer_that_dies_within_the_manifest(spark, tmp_path, monkeypatch):
    """Half a manifest never gets its number."""
    table = str(tmp_path / "t")
    versions.replace_table(frame(spark, 1), table)
    whole = versions._Store.write

    def half(store, name, text):
        whole(store, name, text[: len(text) // 2])
        raise OSError("disk full")

    with monkeypatch.context() as killed:
        killed.setattr(versions._Store, "write", half)
        with pytest.raises(OSError):
            versions.replace_table(frame(spark, 2), table)
    assert rows(spark, table) == [(1, "t1", [1])]


def test_two_writers(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    versions.replace_table(frame(spark, 1), table)
    move = versions._Store.move

    def late(store, old, new):
        monkeypatch.setattr(versions._Store, "move", move)
        versions.replace_table(frame(spark, 7), table)
        move(store, old, new)

    monkeypatch.setattr(versions._Store, "move", late)
    with pytest.raises(versions.Conflict):
        versions.replace_table(frame(spark, 8), table)
    assert rows(spark, table) == [(7, "t7", [7])] and versions.current_version(spark, table) == 2
    with pytest.raises(versions.Conflict, match="at version 2, not 1"):
        versions.replace_table(frame(spark, 9), table, expected=1)


def test_old_versions_go(spark, tmp_path):
    table = str(tmp_path / "t")
    for i in range(5):
        versions.replace_table(frame(spark, i), table)
    assert len(versions.remove_old(spark, table, keep=2)) == 3
    assert rows(spark, table) == [(4, "t4", [4])] and rows(spark, table, version=4) == [(3, "t3", [3])]
    with pytest.raises(ValueError, match="no version 2"):
        versions.read_current(spark, table, 2)
    assert versions.replace_table(frame(spark, 9), table) == 6
    with pytest.raises(ValueError, match="newest"):
        versions.remove_old(spark, table, keep=0)
    with pytest.raises(ValueError, match="cannot overwrite"):
        versions.replace_table(frame(spark, 9), table, sources=[table + "/data"])
