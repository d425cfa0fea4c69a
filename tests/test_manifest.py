"""Appends that count once, and the run log built on them."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tremolite.session import scratch_path
from tremolite.sources import manifest as mf, runlog as rl

KEYS = ["run_id", "iter"]


def rows(spark, values):
    return spark.createDataFrame(values, "run_id string, iter int, v int")


def stored(spark, path):
    return sorted((r["run_id"], r["iter"], r["v"]) for r in mf.read_committed(spark, path, KEYS).collect())


def test_a_second_append_of_a_key_replaces_its_rows_only(spark):
    path = scratch_path(spark, "manifest")
    mf.append_once(rows(spark, [("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", 1, 4)]), path, KEYS)
    mf.append_once(rows(spark, [("a", 1, 1), ("a", 1, 2)]), path, KEYS)
    assert stored(spark, path) == [("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", 1, 4)]
    mf.append_once(rows(spark, [("a", 2, 9), ("c", 7, 5)]), path, KEYS)
    assert stored(spark, path) == [("a", 1, 1), ("a", 1, 2), ("a", 2, 9), ("b", 1, 4), ("c", 7, 5)]
    assert mf.history(spark, path, KEYS).where("run_id = 'a' and iter = 1").count() == 2


def test_a_broken_append_stays_unseen(spark):
    path = scratch_path(spark, "manifest")
    mf.append_once(rows(spark, [("a", 1, 1)]), path, KEYS)
    broken = rows(spark, [("a", 1, 2), ("b", 1, 3)]).withColumn("v", F.when(F.col("v") < 3, F.col("v")).otherwise(F.raise_error(F.lit("lost")).cast("int")))
    with pytest.raises(Exception, match="lost"):
        mf.append_once(broken, path, KEYS)
    assert stored(spark, path) == [("a", 1, 1)]
    # Rows that are written but not published don't count either.
    commit = mf.write_rows(rows(spark, [("a", 1, 5)]), path, KEYS)
    assert stored(spark, path) == [("a", 1, 1)]
    mf.publish(spark, path, KEYS, commit)
    assert stored(spark, path) == [("a", 1, 5)]


def test_an_empty_append_changes_nothing(spark):
    path = scratch_path(spark, "manifest")
    mf.append_once(rows(spark, [("a", 1, 1)]), path, KEYS)
    mf.append_once(rows(spark, []), path, KEYS)
    assert stored(spark, path) == [("a", 1, 1)]


def test_a_repeated_cycle_replaces_its_rows(spark):
    cell = spark.range(3).select(F.col("id").cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("k"), F.lit(5.0).alias("vp"))
    step = lambda x: SimpleNamespace(
        correction=spark.createDataFrame([(1, x)], "cell long, x double"), weights=cell, residuals=cell, sums=cell.limit(2)
    )
    log = rl.RunLog(spark, scratch_path(spark, "run"), "run_1")
    for iteration, x in ((1, 0.5), (2, 0.25), (1, 0.75)):
        log.cycle(iteration, cell, step(x))
    other = rl.RunLog(spark, log.folder, "run_2")
    other.cycle(1, cell, step(9.0))
    assert sorted((r["iter"], r["x"]) for r in log.read("delta_s").collect()) == [(1, 0.75), (2, 0.25)]
    assert log.read("model").count() == 6 and log.read("timing").count() == 2 and log.read("ray_sums").count() == 4
    assert [(r["iter"], r["x"]) for r in other.read("delta_s").collect()] == [(1, 9.0)]
