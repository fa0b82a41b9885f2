"""Runs of programs as they arrive: the outcome of each task so far, kept as state.

A task's state is the attempts that were made and those that returned 0, as bits, and the
time of its latest run. Bits add up, whatever the order of the runs and however often one
arrives, so late and repeated runs change nothing that is settled: the outcome is the first
attempt that returned 0, else the last one made. A change of a task's state gives a row. A
task without a run for some time is closed by a timer and its state dropped; a run that
comes later begins a new state, whose rows add to the others. Runs without a time, of a
task that never had one, set no timer; attempts beyond the last that counts are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.attempts import LAST_ATTEMPT

STATE = "made long, passed long, until long"
CHANGES = "task long, made long, passed long, closed boolean, at timestamp"


class _Task(StatefulProcessor):
    def __init__(self, last: int, patience: int):
        self.last, self.patience = last, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        made, passed, until = self.state.get() if self.state.exists() else (0, 0, 0)
        before, latest = (made, passed), None
        for r in rows:
            if r["attempt"] is None or not 0 <= r["attempt"] <= self.last:
                continue
            made |= 1 << r["attempt"]
            passed |= (r["returncode"] == 0) << r["attempt"]
            if r["at"] is not None and (latest is None or r["at"] > latest):
                latest = r["at"]
        due = until if latest is None else max(until, int(latest.timestamp() * 1000) + self.patience)
        if due > until:
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(due)
        if due > until or (made, passed) != before:
            self.state.update((made, passed, due))
        if (made, passed) != before:
            yield Row(task=key[0], made=made, passed=passed, closed=False, at=latest)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.state.exists():
            made, passed, _ = self.state.get()
            self.state.clear()
            yield Row(task=key[0], made=made, passed=passed, closed=True, at=None)

    def close(self) -> None:
        pass


def changes(runs: DataFrame, last: int = LAST_ATTEMPT, late: str = "10 minutes", patience_seconds: int = 3600) -> DataFrame:
    """``task, made, passed, closed, at``: a row for each change of a task's state; ``runs`` is a stream of ``task, attempt, returncode, at``.

    The query needs RocksDB as its state store, as all queries with such state do.
    """
    timed = runs.select(F.col("task").cast("long").alias("task"), F.col("attempt").cast("int").alias("attempt"), F.col("returncode").cast("int").alias("returncode"), "at").withWatermark("at", late)
    return timed.groupBy("task").transformWithState(_Task(last, patience_seconds * 1000), CHANGES, "Append", "EventTime")


def tallies(runs: DataFrame, last: int = LAST_ATTEMPT, late: str = "10 minutes", span: str = "1 day") -> DataFrame:
    """``task, made, passed`` by tasks and spans of time, for sinks in update mode: Spark's own aggregate holds the bits, so no row goes through Python.

    For many tasks, where nobody waits for their ends. The state of a span is dropped when no more
    runs of it are waited for; a later span's rows add to the others. Runs without a time are passed over.
    """
    bit = F.expr("shiftleft(1L, attempt)")
    timed = runs.select(F.col("task").cast("long").alias("task"), F.col("attempt").cast("int").alias("attempt"), F.col("returncode").cast("int").alias("returncode"), "at").where(F.col("attempt").between(0, last)).withWatermark("at", late)
    passed = F.when(F.col("returncode") == 0, bit).otherwise(F.lit(0).cast("long"))
    return timed.groupBy("task", F.window("at", span)).agg(F.bit_or(bit).alias("made"), F.bit_or(passed).alias("passed")).select("task", "made", "passed")


def _lowest(bits: Column) -> Column:
    """The number of the lowest bit that is set."""
    return F.log2(bits.bitwiseAND(-bits).cast("double")).cast("int")


def settled(changed: DataFrame, every: int = 0) -> DataFrame:
    """``task, attempt, status`` of each task by all rows of ``changes`` or ``tallies`` so far, and with ``every`` its ``fresh_starts``: attempts made whose number is a multiple."""
    bits = changed.groupBy("task").agg(F.bit_or("made").alias("made"), F.bit_or("passed").alias("passed"))
    attempt = F.when(F.col("passed") > 0, _lowest(F.col("passed"))).otherwise(F.floor(F.log2(F.col("made").cast("double"))).cast("int"))
    out = bits.select("task", attempt.alias("attempt"), F.when(F.col("passed") > 0, "pass").otherwise("fail").alias("status"), "made")
    if not every:
        return out.drop("made")
    multiples = sum(1 << k for k in range(0, 63, every))
    return out.withColumn("fresh_starts", F.bit_count(F.col("made").bitwiseAND(F.lit(multiples)))).drop("made")
