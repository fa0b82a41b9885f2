"""Progress of downloads as events: the state of each model, stops at targets, stalls, retries and the fallback."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import megabytes, percent
from ..schemas import PULL_PROGRESS


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PULL_PROGRESS).json(folder)


def latest(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row for each model: status, percent and megabytes of its latest event. Works on tables and streams."""
    timed = events.withWatermark("at", late) if events.isStreaming else events
    last = F.max_by(F.struct("status", "completed", "total"), "at")
    return timed.groupBy("model").agg(last.alias("x"), F.max("at").alias("at")).select("model", "at", "x.status", percent(F.col("x.completed"), F.col("x.total")).alias("percent"), megabytes(F.col("x.completed")).alias("mb"))


#: Interventions of one download, rounds of the fallback, and its seconds.
INTERVENTIONS, ROUNDS, INTERVAL = 5, 10, 30
_MATCHES = "model string, intervention int, target double, actual double, at "


def interventions(events: DataFrame, targets: list[float], most: int | None = INTERVENTIONS) -> DataFrame:
    """``model, intervention, target, actual, at``: the first event after the intervention before whose percentage reaches each target.

    A download is stopped and begun again there; targets after the first that isn't reached have no
    row. Of the targets the first ``most`` count, or all of them if it is None. The events are read
    once, however many targets there are: those of a model are streamed in their order by one task.
    """
    wanted = [float(t) for t in targets[:most]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number, since = run, 0, None
        for batch in batches:
            found = []
            for row in zip(batch.column("model").to_pylist(), batch.column("percent").to_pylist(), batch.column("at").to_pylist()):
                if row[0] != model:
                    model, number, since = row[0], 0, None
                if number < len(wanted) and row[1] >= wanted[number] and (since is None or row[2] > since):
                    found.append((model, number + 1, wanted[number], row[1], row[2]))
                    number, since = number + 1, row[2]
            if found:
                names = [x.split()[0] for x in _MATCHES.split(", ")]
                kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), batch.schema.field("at").type)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names)

    timed = events.select("model", percent(F.col("completed"), F.col("total")).alias("percent"), "at")
    # No other event can be a match.
    some = timed.where((F.col("percent") >= min(wanted, default=0.0)) & F.col("model").isNotNull() & F.col("at").isNotNull())
    return (some if wanted else some.limit(0)).repartition("model").sortWithinPartitions("model", "at", "percent").mapInArrow(run, _MATCHES + dict(events.dtypes)["at"])


def rounds(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """``model, began, ended, n, top, done``: stretches of a download's events without a longer pause than ``gap``; a pause is a stall.

    ``top`` is the highest percentage, ``done`` whether one of the events tells success. Works on tables and streams.
    """
    timed = events.withWatermark("at", late) if events.isStreaming else events
    share = F.max(percent(F.col("completed"), F.col("total"))).alias("top")
    told = F.bool_or(F.lower("status").contains("success")).alias("done")
    grouped = timed.groupBy("model", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), share, told, F.min("at").alias("began"), F.max("at").alias("ended"))
    return grouped.select("model", "began", "ended", "n", "top", F.coalesce("done", F.lit(False)).alias("done"))


def retried(found: DataFrame, most: int = ROUNDS) -> DataFrame:
    """``model, outcome, rounds, top``: a download by its rounds: ``pulled`` in the first ``most``, ``failed`` once these are over, else ``open``.

    ``rounds`` are those up to the success, or as many as were tried.
    """
    number = F.row_number().over(Window.partitionBy("model").orderBy("began"))
    numbered = found.withColumn("number", number).where(F.col("number") <= most)
    first = F.min(F.when(F.col("done"), F.col("number")))
    by = numbered.groupBy("model").agg(first.alias("first"), F.max("number").alias("last"), F.max("top").alias("top"))
    outcome = F.when(F.col("first").isNotNull(), "pulled").when(F.col("last") >= most, "failed").otherwise("open")
    return by.select("model", outcome.alias("outcome"), F.coalesce("first", "last").alias("rounds"), "top")


def fallback(events: DataFrame, since: DataFrame, seconds: int = INTERVAL, most: int = ROUNDS) -> DataFrame:
    """``model, pulled, round``: attempts of ``seconds`` each, after the last intervention (``model, at``; without one from the first event on).

    The first success in one of ``most`` attempts ends them; one that comes later counts for nothing.
    """
    began = events.groupBy("model").agg(F.min("at").alias("first")).join(since.groupBy("model").agg(F.max("at").alias("last")), "model", "left")
    began = began.select("model", F.coalesce("last", "first").alias("since"))
    # One row for each model; Spark sends it to all tasks if it is small and splits a skewed join otherwise.
    told = events.where(F.lower("status").contains("success")).join(began, "model").where("at >= since")
    number = F.floor(F.timestamp_diff("MICROSECOND", F.col("since"), F.col("at")) / (seconds * 1_000_000)).cast("int") + 1
    first = told.groupBy("model").agg(F.min(number).alias("round")).where(F.col("round") <= most)
    return began.select("model").join(first, "model", "left").select("model", F.col("round").isNotNull().alias("pulled"), "round")
