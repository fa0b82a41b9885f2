"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own if Spark runs in this process, else an error."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        if "folder" not in _own:
            _own["folder"] = tempfile.mkdtemp(prefix="loomwright-")
        folder = _own["folder"]
    return folder.rstrip("/")


def complete(spark: SparkSession, pattern: str) -> list[str]:
    """The folders of this pattern that Spark has written whole, in the order of their names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().getParent().toString() for f in files or [])
