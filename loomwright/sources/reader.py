"""Data sources of our own: JSON lines with their positions, as tables and streams, and documents by extension.

``positioned_jsonl`` numbers the rows of a file, or of the files of a folder in the order of
their names, from 0 on in ``_pos``. Files are read in splits of ``SPLIT`` bytes; a split has
the lines that begin in it. Where a split's rows begin to count has to be known beforehand:
``read_positioned`` counts the lines of all splits in a job of their own, and the reader by
itself counts them while it plans. With ``subset_size``, or a condition on ``_pos`` and the
option ``push_filters``, only the splits that hold those rows are planned and
read, and only as much is counted.

Paths without a scheme are files; others go through Arrow's file systems. Blank lines are no
rows; a line that isn't an object, or doesn't fit the schema, fails the read.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.json as pajson
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

SPLIT = 64 << 20
#: Bytes of lines that are parsed at a time.
_BATCH = 4 << 20
POSITION = "_pos"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """The file itself or the folder's visible files by name, with their sizes."""
    system, bare = _opened(path)
    info = system.get_file_info(bare)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = [x for x in system.get_file_info(pafs.FileSelector(bare)) if x.type == pafs.FileType.File and x.base_name[0] not in "_."]
    return sorted((f"{path.rstrip('/')}/{x.base_name}", x.size) for x in found)


def _blocks(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin from ``start`` to before ``end``, some megabytes at a time."""
    system, bare = _opened(path)
    with system.open_input_file(bare) as f:
        f.seek(max(start - 1, 0))
        # What stands before the first line end belongs to the split before.
        skip, at, rest = start > 0, max(start - 1, 0), b""
        while chunk := f.read(_BATCH):
            data, rest = rest + chunk, b""
            if skip:
                cut = data.find(b"\n")
                if cut < 0:
                    at += len(data)
                    continue
                data, at, skip = data[cut + 1 :], at + cut + 1, False
            if at >= end:
                return
            if at + len(data) > end:
                # The last line begins before the end and may go on behind it.
                stop = data.find(b"\n", end - 1 - at)
                if stop >= 0:
                    yield data[: stop + 1]
                    return
            stop = data.rfind(b"\n", 0, max(end - at, 0)) + 1
            if stop:
                yield data[:stop]
            at, rest = at + stop, data[stop:]
        if rest and not skip and at < end:
            yield rest


def _lines(block: bytes) -> list[bytes]:
    return [x for x in block.split(b"\n") if x.strip()]


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    #: The position of its first row, and how many of its rows are wanted.
    first: int = 0
    limit: int | None = None

    def __post_init__(self):
        super().__init__((self.path, self.start))


def splits_of(path: str, size: int = SPLIT) -> list[Split]:
    return [Split(name, at, min(at + size, whole)) for name, whole in files_of(path) for at in range(0, whole, size)]


def count(split: Split) -> int:
    return sum(len(_lines(b)) for b in _blocks(split.path, split.start, split.end))


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.path, self.split = options["path"], int(options.get("split_bytes") or SPLIT)
        self.until = int(options["subset_size"]) if options.get("subset_size") else None
        self.since = 0
        self.starts = json.loads(options["starts"]) if options.get("starts") else None

    def partitions(self) -> list[Split]:
        out, first = [], 0
        for k, split in enumerate(splits_of(self.path, self.split)):
            if self.until is not None and first >= self.until:
                break
            n = self.starts[k] if self.starts else count(split)
            if first + n > self.since:
                out.append(Split(split.path, split.start, split.end, first, n if self.until is None else min(n, self.until - first)))
            first += n
        return out or [Split("", 0, 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        return _rows(split, self.schema)


class _FilteredReader(_Reader):
    """Spark gives filters to sources like this one only where ``spark.sql.python.filterPushdown.enabled`` is set, and fails readers that take them elsewhere."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == (POSITION,):
                if isinstance(f, EqualTo):
                    self.since, top = max(self.since, f.value), f.value + 1
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    top = f.value + isinstance(f, LessThanOrEqual)
                else:
                    top = None
                self.until = self.until if top is None else top if self.until is None else min(self.until, top)
            # Spark tests the rows again, so nothing depends on what was taken from the filter.
            yield f


def _rows(split: Split, schema: StructType) -> Iterator[pa.RecordBatch]:
    own = to_arrow_schema(StructType([f for f in schema if f.name != POSITION]))
    at, left = split.first, split.limit
    for block in _blocks(split.path, split.start, split.end) if split.path else ():
        lines = _lines(block)[:left]
        if lines:
            options = pajson.ParseOptions(explicit_schema=own, unexpected_field_behavior="ignore")
            table = pajson.read_json(io.BytesIO(b"\n".join(lines)), pajson.ReadOptions(block_size=2 * _BATCH + max(map(len, lines))), options)
            if table.num_rows != len(lines):
                raise ValueError(f"{split.path}: a line is not one object")
            place = pa.array(range(at, at + len(lines)), pa.int64())
            columns = [place if f.name == POSITION else table.column(f.name) if f.name in table.column_names else pa.nulls(len(lines), own.field(f.name).type) for f in schema]
            yield from pa.table(columns, names=schema.names).combine_chunks().to_batches()
            at += len(lines)
        left = None if left is None else left - len(lines)
        if left is not None and left <= 0:
            return


class _Stream(DataSourceStreamReader):
    """Files by their names: what comes later must have a later name. An offset is the last file and the rows up to its end."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.ends: dict[str, int] = {}

    def _known(self, until: str | None = None) -> list[tuple[str, int, int]]:
        """Each file with the position of its first row and after its last one."""
        out, first = [], 0
        for name, size in files_of(self.path):
            if until is not None and name > until:
                break
            if name not in self.ends:
                self.ends[name] = first + count(Split(name, 0, size))
            out.append((name, first, self.ends[name]))
            first = self.ends[name]
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "rows": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        known = self._known()
        return {"file": known[-1][0], "rows": known[-1][2]} if known else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Split]:
        sizes = dict(files_of(self.path))
        new = [x for x in self._known(end["file"]) if x[0] > start["file"]]
        return [Split(name, 0, sizes[name], first) for name, first, _ in new]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        return _rows(split, self.schema)


class PositionedJsonl(DataSource):
    """``spark.read.format("positioned_jsonl").schema(...).load(path)``, or ``readStream``; options ``subset_size``, ``split_bytes``, ``push_filters`` and ``starts``."""

    @classmethod
    def name(cls) -> str:
        return "positioned_jsonl"

    def schema(self) -> str:
        raise ValueError("positioned_jsonl needs a schema")

    def reader(self, schema: StructType) -> _Reader:
        return (_FilteredReader if self.options.get("push_filters") == "true" else _Reader)(schema, self.options)

    def streamReader(self, schema: StructType) -> _Stream:  # noqa: N802
        return _Stream(schema, self.options)


class _Documents(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Split]:
        found = [Split(name, 0, size) for name, size in files_of(self.path)]
        for split in found:
            if split.path.lower().rpartition(".")[2] not in ("txt", "csv"):
                raise ValueError(f"no reader for {split.path}")
        return found or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[tuple]:
        if not split.path:
            return
        system, bare = _opened(split.path)
        with system.open_input_stream(bare) as f:
            if split.path.lower().endswith(".txt"):
                yield split.path, 0, f.read().decode()
                return
            # A row for each record, streamed; columns without a value are blank.
            rows = csv.DictReader(io.TextIOWrapper(f, "utf-8", newline=""))
            for k, row in enumerate(rows):
                yield split.path, k, "\n".join(f"{c}: {row[c] or ''}" for c in rows.fieldnames or [])


class Documents(DataSource):
    """``spark.read.format("documents").load(path)``: ``path, part, text`` of whole text files and of the records of CSV files."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "path string, part int, text string"

    def reader(self, schema: StructType) -> _Documents:
        return _Documents(self.options)


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session."""
    spark.dataSource.register(PositionedJsonl)
    spark.dataSource.register(Documents)


def read_positioned(spark: SparkSession, path: str, schema: str, subset_size: int | None = None, split: int = SPLIT) -> DataFrame:
    """Objects of a file or folder with ``_pos``; splits are counted by a job, whose result is one number for each of them."""
    register(spark)
    reader = spark.read.format(PositionedJsonl.name()).schema(StructType.fromDDL(schema).add(POSITION, LongType())).option("split_bytes", split)
    if subset_size is not None:
        return reader.option("subset_size", subset_size).load(path) if subset_size > 0 else reader.option("starts", "[0]").load(path).limit(0)
    splits = splits_of(path, split)
    numbered = spark.sparkContext.parallelize(list(enumerate(splits)), max(1, len(splits))) if len(splits) > 1 else None
    counts = [count(s) for s in splits] if numbered is None else [n for _, n in sorted(numbered.map(lambda x: (x[0], count(x[1]))).collect())]
    return reader.option("starts", json.dumps(counts)).load(path)
