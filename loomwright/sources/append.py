"""A table that batches are appended to, each of them once.

A batch has a number, and the name of the run that numbers them. It is a folder of its own,
named by both, and counts once Spark has written it whole. Writing it again does nothing
then; what a failed write left behind is written over. So a stream that runs a batch again
after a failure, and a job that is started twice, add nothing twice. Batches may have
different columns; those that one doesn't have are null there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import complete


class Appended:
    """A folder of batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def batches(self) -> list[str]:
        """The names of the batches that are written whole."""
        return [path.rpartition("/")[2] for path in complete(self.spark, f"{self.folder}/*")]

    def append(self, rows: DataFrame, number: int, run: str = "run") -> bool:
        """Writes a batch unless it is there; tells whether it was written now."""
        name = f"{run}-{number:012d}"
        if "/" in run or run.startswith(("_", ".")):
            raise ValueError("a run's name is part of a folder's name")
        if name in self.batches():
            return False
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return True

    def sink(self, run: str = "run") -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: batches of a stream by their numbers."""

        def write(rows: DataFrame, number: int) -> None:
            # The stream's own session may differ from ours.
            Appended(rows.sparkSession, self.folder).append(rows, number, run)

        return write

    def read(self, schema: str | None = None, names: list[str] | None = None) -> DataFrame:
        """The rows of all batches, or of those named, with the batch's name in ``_batch``."""
        chosen = self.batches() if names is None else names
        if not chosen:
            if schema is None:
                raise ValueError("no batch is there yet, so a schema is needed")
            return self.spark.createDataFrame([], schema).withColumn("_batch", F.lit(None).cast("string"))
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", "true")
        rows = reader.parquet(*(f"{self.folder}/{name}" for name in chosen))
        return rows.withColumn("_batch", F.element_at(F.split("_metadata.file_path", "/"), -2))
