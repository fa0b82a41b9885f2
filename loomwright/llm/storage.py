"""Intermediate tables in the folder that the cluster shares for checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder

#: Rows of an Arrow batch: texts of some thousand bytes make batches of some megabytes, on both sides of the pipe.
BATCH_ROWS = 2000
#: Makes Spark delete an execution's shuffle files at its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(table: DataFrame) -> DataFrame:
    """The table; its session's Arrow batches get ``BATCH_ROWS`` rows if it has left Spark's default."""
    conf = table.sparkSession.conf
    if conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return table


class Workspace:
    """Tables of one run. Written ones cut the lineage and outlive the executors that made them; their shuffle files go at once."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/loomwright-{uuid.uuid4().hex}"

    def keep(self, name: str, table: DataFrame) -> DataFrame:
        at = f"{self.path}/{name}"
        conf = self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            table.write.mode("overwrite").parquet(at)
        finally:
            conf.set(_CLEANUP, before) if before else conf.unset(_CLEANUP)
        return self.spark.read.schema(table.schema).parquet(at)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
