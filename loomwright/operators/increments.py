"""Hazards of a growing attempt log, brought up to date by its new batches alone.

What an attempt log says of a group are counts, and counts of parts add up. So each batch
of the log (``Appended``) is counted once, by group, and its counts are kept as rows that
bear its name: the batches that have been counted are those that have such rows. An update
reads the others. Rows that two updates at once wrote for one batch are taken once, and an
update that fails leaves nothing that counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.append import Appended
from .attempts import LAST_ATTEMPT, PASS


class RunningCounts:
    """Counts of a log's batches in a folder."""

    def __init__(self, spark: SparkSession, folder: str, log: Appended, keys: tuple[str, ...] = ("model",), last: int = LAST_ATTEMPT):
        self.spark, self.log, self.keys, self.last = spark, log, keys, last
        self.kept = Appended(spark, folder)

    def _columns(self) -> list[str]:
        return [f"s{i}" for i in range(self.last + 1)]

    def _rows(self) -> DataFrame:
        keys = [f"`{k}` string" for k in self.keys]
        counts = [f"{c} long" for c in ("total", *self._columns())]
        return self.kept.read(", ".join(["source string", *keys, *counts])).drop("_batch")

    def counted(self) -> list[str]:
        """The batches whose counts are kept, as rows of one column for each; a batch without rows is one as well."""
        return sorted(r["source"] for r in self._rows().select("source").distinct().collect())

    def update(self) -> list[str]:
        """Counts the log's new batches and gives their names."""
        done = set(self.counted())
        new = [b for b in self.log.batches() if b not in done]
        if not new:
            return []
        rows = self.log.read(names=new).withColumnRenamed("_batch", "source")
        passed = F.col("status") == PASS
        counts = [F.count(F.when(passed & (F.col("attempt") == i), 1)).alias(c) for i, c in enumerate(self._columns())]
        parts = rows.groupBy("source", *(F.col(k).cast("string").alias(k) for k in self.keys)).agg(F.count(F.lit(1)).alias("total"), *counts)
        # A batch without rows is counted by a row of no group.
        marks = self.spark.createDataFrame([(b,) for b in new], "source string").join(parts.select("source").distinct(), "source", "left_anti")
        self.kept.append(parts.unionByName(marks, allowMissingColumns=True), 0, uuid.uuid4().hex)
        return new

    def passes(self) -> DataFrame:
        """The groups' rows ``total`` and passes ``s``, as ``attempts.passes`` gives them for the whole log."""
        rows = self._rows().where("total IS NOT NULL").dropDuplicates(["source", *self.keys])
        sums = [F.sum(c).alias(c) for c in ("total", *self._columns())]
        return rows.groupBy(*self.keys).agg(*sums).select(*self.keys, "total", F.array(*self._columns()).alias("s"))
