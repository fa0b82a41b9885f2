"""Our own data sources against Spark's readers."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from loomwright.sources import io, reader

SCHEMA = "k long, text string, more struct<a:string,b:array<long>>"


def written(folder, n: int, seed: int = 0, end: str = "\n") -> list[dict]:
    rng = random.Random(seed)
    rows = [{"k": k, "text": "é" * rng.randrange(40) + "\\n\" {", "more": {"a": None if k % 3 else "x", "b": [k, k + 1]}, "unknown": True} | ({} if k % 7 else {"text": None}) for k in range(n)]
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "rows.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) + ("\n  " if r["k"] % 11 == 0 else "") for r in rows) + end)
    return rows


def plain(frame):
    return sorted(map(repr, frame.select("_pos", "k", "text", "more").collect()))


@pytest.mark.parametrize(("split", "end"), [(1 << 20, "\n"), (97, ""), (1000, "\n")])
def test_rows_and_positions_are_those_of_the_json_reader(spark, tmp_path, split, end):
    written(tmp_path / "in", 120, end=end)
    path = f"{tmp_path}/in/rows.jsonl"
    assert plain(reader.read_positioned(spark, path, SCHEMA, split=split)) == plain(io.read_jsonl(spark, path, SCHEMA))
    assert plain(reader.read_positioned(spark, path, SCHEMA, 13, split)) == plain(io.read_jsonl(spark, path, SCHEMA, 13))
    assert reader.read_positioned(spark, path, SCHEMA, 0, split).count() == 0 and reader.read_positioned(spark, path, SCHEMA, 500, split).count() == 120


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 9])
def test_a_line_belongs_to_the_split_that_it_begins_in(tmp_path, size):
    for text in (b"ab\ncdefghijkl\n\nm\n", b"a\n", b"abc", b"\n\n", b"abcdefg\nh", b"abcdefgh\ni\n"):
        (tmp_path / "f").write_bytes(text)
        found = [reader._lines(b"".join(reader._blocks(f"{tmp_path}/f", a, min(a + size, len(text))))) for a in range(0, len(text), size)]
        assert sum(found, []) == [x for x in text.split(b"\n") if x]
        for k, lines in enumerate(found):
            assert all(text.index(x) // size == k for x in lines)


def test_only_the_splits_of_a_head_are_planned(spark, tmp_path):
    written(tmp_path / "in", 200)
    path = f"{tmp_path}/in/rows.jsonl"
    every, head = reader.read_positioned(spark, path, SCHEMA, split=500), reader.read_positioned(spark, path, SCHEMA, 5, 500)
    parts = lambda frame: frame.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts(every) == every.rdd.getNumPartitions() > 20 and head.rdd.getNumPartitions() <= 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        reader.register(spark)
        load = lambda: spark.read.format("positioned_jsonl").schema(SCHEMA + ", _pos long").option("push_filters", "true").option("split_bytes", 500).load(path)
        assert load().where("_pos < 5").rdd.getNumPartitions() <= 2 and load().where("_pos = 150").rdd.getNumPartitions() == 1
        assert [r["k"] for r in load().where("_pos = 150").collect()] == [150] and load().where("_pos <= 9 AND k > 3").count() == 6
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_bad_line_fails_and_a_missing_path_too(spark, tmp_path):
    (tmp_path / "bad").write_text('{"k": 1}\n{"k": 2')
    with pytest.raises(Exception, match="JSON|Missing|object"):
        reader.read_positioned(spark, f"{tmp_path}/bad", SCHEMA).collect()
    with pytest.raises(FileNotFoundError):
        reader.read_positioned(spark, f"{tmp_path}/nowhere", SCHEMA)


def test_a_stream_goes_on_with_positions(spark, tmp_path):
    reader.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def more(name, rows):
        (folder / name).write_text("".join(json.dumps({"k": k}) + "\n" for k in rows))

    def run():
        stream = spark.readStream.format("positioned_jsonl").schema("k long, _pos long").load(str(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["_pos"], r["k"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    more("a", range(5))
    more("b", range(5, 8))
    assert run() == [(k, k) for k in range(8)]
    more("c", range(8, 12))
    assert run() == [(k, k) for k in range(12)]


def test_documents_by_extension(spark, tmp_path):
    reader.register(spark)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("whole\n\ntext é")
    (tmp_path / "d" / "b.csv").write_text('x,y\n1,"two\nlines"\n,z\n')
    got = sorted((r["path"].rpartition("/")[2], r["part"], r["text"]) for r in spark.read.format("documents").load(f"{tmp_path}/d").collect())
    assert got == [("a.txt", 0, "whole\n\ntext é"), ("b.csv", 0, "x: 1\ny: two\nlines"), ("b.csv", 1, "x: \ny: z")]
    (tmp_path / "d" / "c.doc").write_text("x")
    with pytest.raises(Exception, match="no reader"):
        spark.read.format("documents").load(f"{tmp_path}/d").collect()
