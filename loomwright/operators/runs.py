"""Recorded runs of programs: outcome of each task, progress, and rows for the attempt log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .attempts import LAST_ATTEMPT

#: Tasks whose running counts are made together, and blocks whose counts are; so one task sees one row for a million tasks.
BLOCK = 1000


def outcomes(runs: DataFrame, last: int = LAST_ATTEMPT) -> DataFrame:
    """``task, attempt, status``: the first attempt that returned 0, else the last one made; attempts beyond ``last`` aren't."""
    made = runs.where(F.col("attempt") <= last)
    solved = F.min(F.when(F.col("returncode") == 0, F.col("attempt")))
    return made.groupBy("task").agg(F.coalesce(solved, F.max("attempt")).alias("attempt"), F.when(solved.isNotNull(), "pass").otherwise("fail").alias("status"))


def progress(done: DataFrame) -> DataFrame:
    """Adds ``n_solved`` and ``n_unsolved`` up to each task, in the order of tasks."""
    block = F.floor(F.col("task") / BLOCK)
    flagged = done.withColumn("block", block).withColumn("ok", (F.col("status") == "pass").cast("long"))
    inner = Window.partitionBy("block").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
    sums = flagged.groupBy("block").agg(F.sum("ok").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = sums.withColumn("top", F.floor(F.col("block") / BLOCK))
    all_before = Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    tops = sums.groupBy("top").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    tops = tops.select("top", F.coalesce(F.sum("s").over(all_before), F.lit(0)).alias("st"), F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("nt"))
    before = Window.partitionBy("top").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.join(tops, "top").select("block", (F.col("st") + F.coalesce(F.sum("s").over(before), F.lit(0))).alias("s0"), (F.col("nt") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("n0"))
    own = flagged.withColumns({"s1": F.sum("ok").over(inner), "n1": F.count(F.lit(1)).over(inner)}).join(offsets, "block")
    return own.select("task", "attempt", "status", (F.col("s0") + F.col("s1")).alias("n_solved"), (F.col("n0") + F.col("n1") - F.col("s0") - F.col("s1")).alias("n_unsolved"))


def result_rows(log: DataFrame, by_library: bool) -> DataFrame:
    """Rows of the results file: by problem and library for data sets that have libraries, else by task."""
    own = ("problem_id", "library") if by_library else ("task_id",)
    return log.select(*own, F.col("attempt").alias("fix_mode_attempt_count"), "status")


def appended(results: DataFrame, more: DataFrame) -> DataFrame:
    """Results with further rows; columns that one side doesn't have are null there."""
    return results.unionByName(more, allowMissingColumns=True)
