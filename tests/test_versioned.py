"""Merges against plain ones, how many files they rewrite, versions, and merges that are cut off."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import materialize, store, versioned

ROWS = "day long, id long, x string"


def some(first, last, x="old"):
    return [(k // 10, k, f"{x} {k}") for k in range(first, last)]


def names(table, spark, version=None):
    return {r.file for r in table.manifest(spark, version).collect()}


@pytest.fixture
def table(spark, tmp_path):
    return versioned.create(spark.createDataFrame(some(0, 400), ROWS), f"{tmp_path}/t", ("day", "id"), 8)


def test_merge_as_upserted(spark, table):
    old = spark.createDataFrame(some(0, 400), ROWS)
    new = spark.createDataFrame(some(350, 420, "new"), ROWS)
    assert table.merge(new) == 1
    want = store.upserted(old, new, ["day", "id"])
    assert sorted(table.read(spark).collect()) == sorted(want.collect())
    assert sorted(table.read(spark, 0).collect()) == sorted(old.collect())
    assert table.versions(spark) == [0, 1] and table.manifest(spark).agg(F.sum("rows")).first()[0] == 420
    with pytest.raises(ValueError, match="no version"):
        table.read(spark, 7)


def test_only_touched_files_are_rewritten(spark, table):
    before = names(table, spark)
    assert len(before) == 8
    table.merge(spark.createDataFrame([(3, 33, "new")], ROWS))
    assert len(before - names(table, spark)) == 1
    table.merge(spark.createDataFrame([(900, 9000, "beyond all ranges")], ROWS))
    assert len(names(table, spark, 1) - names(table, spark)) == 0 and len(names(table, spark)) == 9
    table.delete(spark.createDataFrame([(5, 55), (5, 55), (77, 1)], "day long, id long"))
    assert len(names(table, spark, 2) - names(table, spark)) == 1 and table.read(spark).count() == 400
    table.delete_where(spark, F.col("id") == 9000)
    assert table.read(spark).count() == 399 and len(names(table, spark)) == 8


def test_a_merge_that_is_cut_off_changes_nothing(spark, table, monkeypatch):
    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versioned.Table, "_commit", broken)
        with pytest.raises(RuntimeError, match="lost"):
            table.merge(spark.createDataFrame(some(0, 50, "new"), ROWS))
    assert table.versions(spark) == [0] and sorted(table.read(spark).collect()) == sorted(map(tuple, some(0, 400)))
    assert table.merge(spark.createDataFrame(some(0, 50, "new"), ROWS)) == 1


def test_the_second_of_two_merges_fails(spark, table):
    manifest = table.manifest(spark)
    table._commit(spark, manifest, 1)
    with pytest.raises(Exception, match="(?i)exist"):
        table._commit(spark, manifest, 1)
    assert table.read(spark).count() == 400


def test_odd_keys(spark, tmp_path):
    table = versioned.create(spark.createDataFrame([], ROWS), f"{tmp_path}/t", ("day", "id"))
    assert table.read(spark).count() == 0
    table.merge(spark.createDataFrame([(None, 1, "a"), (1, 1, None)], ROWS))
    table.merge(spark.createDataFrame([(None, 1, "b"), (1, 1, "c")], ROWS))
    assert sorted((r.x for r in table.read(spark).collect())) == ["a", "b", "c"]
    with pytest.raises(Exception, match="key twice"):
        table.merge(spark.createDataFrame([(1, 2, "a"), (1, 2, "b")], ROWS))
    with pytest.raises(ValueError, match="there is a table"):
        versioned.create(spark.createDataFrame([], ROWS), f"{tmp_path}/t", ("day", "id"))


def test_many_keys_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Sorted keys pack so well that the planner takes millions of them for a small table."""
    joins, files = [], versioned.Table._written

    def seen(table, session, rows):
        joins.append(rows._jdf.queryExecution().executedPlan().toString())
        return files(table, session, rows)

    old, new = spark.createDataFrame(some(0, 400), ROWS), spark.createDataFrame(some(350, 420, "new"), ROWS)
    table = versioned.create(old, f"{tmp_path}/t", ("day", "id"), 8)
    monkeypatch.setattr(materialize, "FEW", 10, raising=False)
    monkeypatch.setattr(versioned.Table, "_written", seen)
    table.merge(new)
    table.delete(new.where("id % 2 = 0"))
    assert len(joins) == 2 and all("Join" in x and "Broadcast" not in x for x in joins)
    assert sorted(r.id for r in table.read(spark).collect()) == [*range(350), *range(351, 420, 2)]
