"""Queries whose tables arrive in batches: streams and increments over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import attempts, runs
from ..operators.increments import RunningCounts
from ..sources.append import Appended
from ..sources.shared import shared_folder
from ..streaming import attempts as arriving
from ..streaming import history
from ..streaming.run import drained
from . import derived

#: Batches that a table is cut into, and files of each.
BATCHES, FILES = 3, 4


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/arriving-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, folder: str, batches: list[DataFrame]) -> DataFrame:
    """A stream of these tables, which are written in turn; one of its batches is about one of them."""
    for k, rows in enumerate(batches):
        rows.repartition(FILES).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in/*")


def _drained(stream: DataFrame, folder: str, mode: str = "append") -> Appended:
    return drained(stream, Appended(stream.sparkSession, f"{folder}/out"), f"{folder}/checkpoint", mode=mode)


def run_status_stream(spark, sf_dir):
    """The rows of ``run_status`` from runs that arrive out of order, some of them twice."""
    folder = _folder(spark)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("attempt"))
    made = derived.view(spark, sf_dir, derived.RUNS, "lineitem").select("task", F.col("attempt").cast("int").alias("attempt"), "returncode", at.alias("at"))
    number = F.pmod(F.xxhash64("task", "attempt"), F.lit(BATCHES))
    batches = [made.where((number == k) | ((number == k - 1) & (F.col("task") % 5 == 0))) for k in range(BATCHES)]
    changed = _drained(arriving.tallies(_stream(spark, folder, batches), late="1 day"), folder, "update")
    return runs.progress(arriving.settled(changed.read()).withColumn("attempt", F.col("attempt").cast("long")))


def chat_history_stream(spark, sf_dir):
    """The rows of ``chat_history_k3`` from turns that arrive two or three at a time."""
    folder = _folder(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    ends = [0, 2, 5, None]
    batches = [turns.where((F.col("turn") >= a) & (F.lit(True) if b is None else F.col("turn") < b)) for a, b in zip(ends, ends[1:])]
    rows = _drained(history.histories(_stream(spark, folder, batches)), folder).read()
    flat = F.array_join(F.transform("history", lambda p: F.concat(p["question"], F.lit("|"), p["answer"])), "~")
    return rows.select("conv_id", "turn", F.size("history").alias("n"), flat.alias("history"), "original", "last_question")


def _batched_log(spark, sf_dir) -> list[DataFrame]:
    log = derived.view(spark, sf_dir, derived.ATTEMPT_LOG, "orders")
    return [log.where(F.pmod(F.xxhash64("task"), F.lit(BATCHES)) == k) for k in range(BATCHES)]


def ddi_incremental(spark, sf_dir):
    """The rows of ``ddi_influence`` from a log that grows: each batch is written twice and counted once, when it is new."""
    folder = _folder(spark)
    log = Appended(spark, f"{folder}/log")
    counts = RunningCounts(spark, f"{folder}/counts", log)
    for k, rows in enumerate(_batched_log(spark, sf_dir)):
        log.append(rows, k)
        log.append(rows, k)
        counts.update()
    steps = attempts.hazards(counts.passes()).select("model", F.explode("steps").alias("x"))
    return steps.select("model", "x.i", "x.S_i", "x.N_i", rounded(F.col("x.I_i"), 9).alias("I_i"), "x.pct")


def results_appended(spark, sf_dir):
    """Results of data sets with and without libraries, appended by a stream whose last batch is tried again."""
    folder = _folder(spark)
    table = Appended(spark, f"{folder}/results")
    log = derived.view(spark, sf_dir, derived.ATTEMPT_LOG, "orders").withColumns({"problem_id": F.col("task").cast("string"), "library": F.col("model"), "task_id": F.col("task").cast("string")})
    by_library = F.col("task") % 2 == 0
    for k, rows in enumerate((runs.result_rows(log.where(by_library), True), runs.result_rows(log.where(~by_library), False))):
        table.append(rows, k)
        table.append(rows, k)
    return table.read().select("problem_id", "library", "fix_mode_attempt_count", "status", "task_id")


QUERIES = (run_status_stream, chat_history_stream, ddi_incremental, results_appended)

#: Each has the rows of a query that reads its tables at once.
SAME_AS = {"run_status_stream": "run_status", "chat_history_stream": "chat_history_k3", "ddi_incremental": "ddi_influence", "results_appended": "result_schema_dispatch"}
