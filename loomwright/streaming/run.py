"""Running a stream over everything that is there, in one go or from where it was left."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.append import Appended

_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession):
    """RocksDB as the state store while a query is started; the session's own setting comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def drained(stream: DataFrame, to: Appended, checkpoint: str, run: str = "run", mode: str = "append") -> Appended:
    """Runs a stream over all input that is there and appends each of its batches to a table, once.

    What was read and the state are kept in ``checkpoint``, so a later call goes on from there.
    """
    with _state_store(stream.sparkSession):
        query = stream.writeStream.foreachBatch(to.sink(run)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return to
