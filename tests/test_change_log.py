import pytest
from pyspark.sql import functions as F

from tidepool.operators import change_log as log
from tidepool.operators import writes
from tidepool.sources.memory import memories, now_column

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def part_files(folder):
    return [p for p in folder.rglob("*.parquet")]


def test_touches_write_what_they_change(spark, tmp_path):
    folder = str(tmp_path / "store")
    m = memories(spark, DATA)
    log.create(m, folder)
    want, written = m, 0
    for ids in ([3, 4], [4, 4, 9], [11]):
        acts = spark.createDataFrame([(i,) for i in ids], "id long")
        want = writes.touched(want, acts, now_column())
        changes = log.touch_changes(log.snapshot(spark, folder), acts, now_column())
        version = log.append(changes, folder)
        kept = spark.read.parquet(f"{folder}/changes/version={version}")
        assert 0 < kept.count() <= 6 * len(set(ids))  # each touched row and five that it reaches
        written += kept.count()
        assert rows(log.snapshot(spark, folder)) == rows(want)
    assert written < m.count()
    assert rows(log.snapshot(spark, folder, version=0)) == rows(m)
    assert log.versions(spark, folder, "changes") == [1, 2, 3]


def test_ten_touches_of_a_million_rows(spark, tmp_path):
    folder = str(tmp_path / "store")
    base = spark.range(1_000_000).select("id", (F.col("id") % 7).cast("double").alias("activation_count"))
    log.create(base, folder)
    changes = base.where("id < 1000000 AND id % 100000 = 0").withColumn("activation_count", F.lit(-1.0))
    log.append(changes, folder)
    assert spark.read.parquet(f"{folder}/changes/version=1").count() == 10
    got = log.snapshot(spark, folder)
    assert got.count() == 1_000_000 and got.where("activation_count < 0").count() == 10
    assert got.agg(F.sum("activation_count")).first()[0] == base.where("id % 100000 <> 0").agg(F.sum("activation_count")).first()[0] - 10


def test_compaction_removal_and_repeated_writes(spark, tmp_path):
    folder = str(tmp_path / "store")
    table = spark.createDataFrame([(1, "a", [1]), (2, None, None), (3, "c", [3])], "id long, name string, tags array<int>")
    log.create(table, folder)
    after = spark.createDataFrame([(1, "a", [1]), (2, "b", None), (4, None, [])], "id long, name string, tags array<int>")
    changes = log.changes_between(table, after)
    assert sorted((r.id, r[log.REMOVED]) for r in changes.collect()) == [(2, False), (3, True), (4, False)]
    assert log.append(changes, folder) == 1
    assert log.append(changes, folder, version=1) == 1  # the same write again
    assert rows(log.snapshot(spark, folder)) == rows(after)
    assert log.compact(spark, folder) == 1 and log.compact(spark, folder) == 1
    assert rows(log.snapshot(spark, folder)) == rows(after) and rows(log.snapshot(spark, folder, version=0)) == rows(table)
    with pytest.raises(ValueError):
        log.append(changes, folder, version=1)
    back = log.changes_between(after, table)
    assert log.append(back, folder) == 2 and rows(log.snapshot(spark, folder)) == rows(table)
    assert log.changes_between(table, table).count() == 0


def test_a_write_cut_short_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "store")
    table = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, activation_count double")
    log.create(table, folder)
    change = table.where("id = 2").withColumn("activation_count", F.lit(5.0))
    log.append(change, folder)
    (tmp_path / "store/changes/version=1/_SUCCESS").unlink()
    assert rows(log.snapshot(spark, folder)) == rows(table)
    assert log.append(change, folder) == 1
    assert {r.id: r.activation_count for r in log.snapshot(spark, folder).collect()} == {1: 1.0, 2: 5.0}


def test_the_base_is_not_shuffled_for_few_changes(spark, tmp_path):
    folder = str(tmp_path / "store")
    log.create(spark.range(1000).select("id", F.lit(0.0).alias("activation_count")), folder)
    log.append(spark.createDataFrame([(5, 1.0)], "id long, activation_count double"), folder)
    plan = log.snapshot(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
