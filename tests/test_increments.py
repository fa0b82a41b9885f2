"""Batches that are appended once, and counts that follow a growing log."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import attempts
from loomwright.operators.increments import RunningCounts
from loomwright.sources.append import Appended

LOG = "task long, model string, attempt int, status string"


def log_rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(k, rng.choice("ab"), rng.randint(0, 6), rng.choice(("pass", "fail", "PASS", None))) for k in range(n)]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    table, rows = Appended(spark, f"{tmp_path}/t"), spark.createDataFrame(log_rows(20, 1), LOG)
    assert table.append(rows, 0) and not table.append(rows, 0) and table.append(rows, 1) and table.append(rows, 0, "other")
    assert table.read().count() == 60 and table.batches() == ["other-000000000000", "run-000000000000", "run-000000000001"]
    assert {r["_batch"] for r in table.read().select("_batch").distinct().collect()} == set(table.batches())


def test_a_write_that_fails_counts_once_it_is_repeated(spark, tmp_path):
    table = Appended(spark, f"{tmp_path}/t")
    rows = spark.createDataFrame([(k,) for k in range(100)], "n long").repartition(4)
    failing = rows.select(F.when(F.col("n") == 77, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("n")).alias("n"))
    with pytest.raises(Exception, match="lost"):
        table.append(failing, 5)
    assert table.batches() == [] and table.read("n long").count() == 0
    assert table.append(rows, 5) and sorted(r["n"] for r in table.read().collect()) == list(range(100))


def test_a_stream_that_fails_between_batches_appends_each_once(spark, tmp_path):
    """The sink fails after it has written a batch, before the stream has noted it: the batch runs again."""
    for k in range(3):
        spark.createDataFrame([(k, j) for j in range(5)], "k long, j long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    table = Appended(spark, f"{tmp_path}/t")
    sink, failed = table.sink(), []

    def once(rows, number):
        sink(rows, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("after the write")

    def run():
        stream = spark.readStream.schema("k long, j long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        stream.writeStream.foreachBatch(once).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="after the write"):
        run()
    run()
    assert failed == [1] and sorted((r["k"], r["j"]) for r in table.read().collect()) == [(k, j) for k in range(3) for j in range(5)]


def test_columns_may_differ(spark, tmp_path):
    table = Appended(spark, f"{tmp_path}/t")
    table.append(spark.createDataFrame([(1, "a")], "x long, y string"), 0)
    table.append(spark.createDataFrame([(2, 3.0)], "x long, z double"), 1)
    assert sorted((r["x"], r["y"], r["z"]) for r in table.read().collect()) == [(1, "a", None), (2, None, 3.0)]


def test_increments_equal_one_full_run(spark, tmp_path):
    log = Appended(spark, f"{tmp_path}/log")
    counts = RunningCounts(spark, f"{tmp_path}/counts", log)
    assert counts.update() == [] and counts.passes().count() == 0
    parts = [log_rows(50, 2), [], log_rows(30, 3)]
    for k, rows in enumerate(parts):
        log.append(spark.createDataFrame(rows, LOG), k)
        log.append(spark.createDataFrame(rows, LOG), k)
        assert counts.update() == [f"run-{k:012d}"] and counts.update() == []
    whole = attempts.influence(spark.createDataFrame(sum(parts, []), LOG))
    assert sorted(map(tuple, attempts.hazards(counts.passes()).select("model", F.explode("steps").alias("x")).select("model", "x.*").collect())) == sorted(map(tuple, whole.collect()))


def test_a_batch_that_two_updates_count_counts_once(spark, tmp_path):
    log = Appended(spark, f"{tmp_path}/log")
    log.append(spark.createDataFrame(log_rows(40, 4), LOG), 0)
    one, two = (RunningCounts(spark, f"{tmp_path}/counts", log) for _ in range(2))
    two.counted = lambda: []
    one.update()
    two.update()
    assert sum(r["total"] for r in one.passes().collect()) == 40


def test_only_new_batches_are_read(spark, tmp_path):
    log = Appended(spark, f"{tmp_path}/log")
    counts = RunningCounts(spark, f"{tmp_path}/counts", log)
    log.append(spark.createDataFrame(log_rows(10, 5), LOG), 0)
    counts.update()
    # Were the first batch read again, its columns would fail.
    spark.createDataFrame([("x",)], "other string").write.mode("overwrite").parquet(f"{tmp_path}/log/run-000000000000")
    log.append(spark.createDataFrame(log_rows(10, 6), LOG), 1)
    assert counts.update() == ["run-000000000001"] and sum(r["total"] for r in counts.passes().collect()) == 20
