"""Reading data sets and documents, writing results."""

from __future__ import annotations

import argparse
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, fields
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..schemas import ATTEMPT_LOG
from .shared import shared_folder


def _placed(numbered: DataFrame, name: str, *place: Column) -> DataFrame:
    """Rows with Spark's ids in ``_id`` numbered from 0 on, without one task for all: ids go up by one within a place; the rows of places before are added.

    One small row for each place is gathered.
    """
    found = numbered.groupBy(F.struct(*(c.alias(f"p{k}") for k, c in enumerate(place))).alias("_place")).agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))
    total, starts = 0, []
    for at, first, n in sorted(tuple(r) for r in found.collect()):
        starts.append((at, total - first))
        total += n
    offsets = F.broadcast(numbered.sparkSession.createDataFrame(starts, f"_place {found.schema['_place'].dataType.simpleString()}, _offset long").select("_place.*", "_offset"))
    keyed = numbered.withColumns({f"p{k}": c for k, c in enumerate(place)})
    keys = [f"p{k}" for k in range(len(place))]
    return keyed.join(offsets, keys).withColumn(name, F.col("_offset") + F.col("_id")).drop("_id", "_offset", *keys)


def with_positions(frame: DataFrame, name: str = "_pos") -> DataFrame:
    """Numbers rows from 0 on in the order of the partitions, whose number Spark's ids have in the upper bits."""
    numbered = frame.withColumn("_id", F.monotonically_increasing_id())
    return _placed(numbered, name, F.shiftright("_id", 33))


def with_file_positions(frame: DataFrame, name: str = "_pos") -> DataFrame:
    """Numbers the rows of files by the files' paths and in the order of each file; Spark deals splits to partitions by their size."""
    numbered = frame.select("*", F.monotonically_increasing_id().alias("_id"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return _placed(numbered, name, F.col("_file"), F.col("_block")).drop("_file", "_block")


def positions_by(frame: DataFrame, *order: Column, name: str = "_pos") -> DataFrame:
    """Numbers rows from 0 on in this order.

    The sorted rows are written with their ids first: the bounds of a sort's partitions are drawn anew in each run.
    """
    at = f"{shared_folder(frame.sparkSession)}/positions-{uuid.uuid4().hex}"
    frame.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(at)
    return _placed(frame.sparkSession.read.parquet(at), name, F.shiftright("_id", 33))


def read_jsonl(spark: SparkSession, path: str, schema: str, subset_size: int | None = None) -> DataFrame:
    """One object per line with positions; with ``subset_size`` the first ones only. A bad line fails the read."""
    rows = with_file_positions(spark.read.schema(schema).option("mode", "FAILFAST").json(path))
    return rows if subset_size is None else rows.where(F.col("_pos") < subset_size)


def at_position(rows: DataFrame, index: int) -> DataFrame:
    """The row of that position; none if there is no such row."""
    return rows.where(F.col("_pos") == index)


def in_order(rows: DataFrame) -> Iterator[Row]:
    """Rows by position, one partition at a time."""
    return rows.orderBy("_pos").toLocalIterator()


class Cursor:
    """Rows one by one in their order: ``next`` gives None at the end, ``reset`` begins anew, ``len`` is their number."""

    def __init__(self, rows: DataFrame, process: Callable[[Row], object] = lambda row: row):
        self.rows, self.process = rows, process
        self.reset()

    def reset(self) -> None:
        self._left = None

    def next(self) -> object:
        if self._left is None:
            self._left = in_order(self.rows)
        row = next(self._left, None)
        return None if row is None else self.process(row)

    def __len__(self) -> int:
        return self.rows.count()


def mapped(rows: DataFrame, process: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Rows through a pluggable function of column batches, which gives the columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield process(batch)

    return rows.mapInArrow(run, schema)


def has_keys(record: Column, keys: Iterable[str]) -> Column:
    """Whether a map is there and has all these keys."""
    found = F.lit(True)
    for key in keys:
        found = found & F.map_contains_key(record, key)
    return F.coalesce(found, F.lit(False))


def selected(loaders: dict[str, Callable[[], DataFrame]], names: Iterable[str]) -> list[tuple[str, DataFrame]]:
    """The data sets of these names in the order asked for; an unknown name is an error."""
    return [(name, loaders[name]()) for name in names]


def read_attempt_log(spark: SparkSession, path: str, schema: str = ATTEMPT_LOG) -> DataFrame:
    """A results file; a missing one fails as Spark reports it."""
    return spark.read.schema(schema).option("header", True).csv(path)


def result_path(folder: str, model: str, dataset: str, suffix: str = "") -> str:
    return f"{folder}/{model}_{dataset}_results{suffix}.csv"


def record_path(folder: str, model: str, dataset: str = "N/A", suffix: str = "") -> str:
    return f"{folder}/{model}{'' if dataset == 'N/A' else '_' + dataset}_DDI{suffix}.json"


def projected(results: DataFrame, columns: list[str]) -> DataFrame:
    """These columns in this order; those that are missing are null."""
    return results.select(*(F.col(f"`{c}`") if c in results.columns else F.lit(None).cast("string").alias(c) for c in columns))


def write_results(results: DataFrame, path: str, columns: list[str]) -> None:
    projected(results, columns).write.mode("overwrite").option("header", True).csv(path)


def write_record(record: DataFrame, path: str) -> None:
    record.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def guarded(write: Callable[[], None], report: Callable[[str], None] = print) -> bool:
    """Runs a write; a failure is reported, not raised."""
    try:
        write()
    except Exception as e:  # noqa: BLE001  results of a long experiment shouldn't be lost to its last step
        report(f"could not save: {e}")
        return False
    return True


def read_documents(spark: SparkSession, path: str, parse_pdf: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``path, text`` of documents by their extension: whole text files, rows of CSV files, PDF through a given parser."""
    kind = path.lower().rpartition(".")[2]
    if kind == "txt":
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if kind == "csv":
        rows = spark.read.option("header", True).csv(path)
        lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in rows.columns]
        return rows.select(F.col("_metadata.file_path").alias("path"), F.concat_ws("\n", *lines).alias("text"))
    if kind == "pdf":
        if parse_pdf is None:
            raise ValueError("PDF documents need a parser")
        return parse_pdf(spark.read.format("binaryFile").load(path))
    raise ValueError(f"no reader for .{kind} documents")


def read_tuning_pairs(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    return reader.format(kind).load(path)


def solved_status(returncode: Column) -> Column:
    return F.when(returncode == 0, "pass").otherwise("fail")


@dataclass
class Settings:
    """Parameters with their defaults; values of a file take their place."""

    max_attempts: int = 5
    timeout: int = 10
    max_history: int = 3
    chunk_size: int = 1000
    chunk_overlap: int = 100
    top_k: int = 3
    temperature: float = 1.0
    learning_rate: float = 2e-4
    subset_size: int | None = None
    datasets: tuple[str, ...] = ("mbpp",)

    def updated(self, values: dict) -> Settings:
        known = {f.name for f in fields(self)}
        merged = {f.name: getattr(self, f.name) for f in fields(self)} | {k: v for k, v in values.items() if k in known}
        merged["learning_rate"] = float(merged["learning_rate"])
        if not 0 <= float(merged["temperature"]) <= 1:
            merged["temperature"] = self.temperature
        return Settings(**merged)

    @classmethod
    def read(cls, path: str) -> Settings:
        """Defaults with the values of a YAML file in their place."""
        import yaml

        return cls().updated(yaml.safe_load(Path(path).read_text()) or {})

    @classmethod
    def of_arguments(cls, argv: Sequence[str]) -> Settings:
        """Defaults with ``--subset-size`` and ``--datasets`` of a command line in their place."""
        parser = argparse.ArgumentParser()
        parser.add_argument("--subset-size", type=int, default=None)
        parser.add_argument("--datasets", nargs="+", choices=DATASETS, default=["mbpp"])
        known = parser.parse_args(list(argv))
        return cls().updated({"subset_size": known.subset_size, "datasets": tuple(known.datasets)})


# Names of the data sets that can be asked for.
DATASETS = ("ds1000", "humaneval", "mbpp")


def read_prompt(path: str, raw: bool = False) -> str:
    """A prompt or template from a file, without white space around it unless it is wanted raw."""
    text = Path(path).read_text()
    return text if raw else text.strip()
