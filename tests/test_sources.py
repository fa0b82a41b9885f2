from __future__ import annotations

import json

import pytest

from loomwright.operators import runs
from loomwright.schemas import ATTEMPT_LOG, PULL_PROGRESS, TASK
from loomwright.sources import io
from loomwright.streaming import progress


def test_jsonl_subset_and_positions(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("".join(json.dumps({"task_id": f"t{k}", "prompt": "p"}) + "\n" for k in range(20)))
    rows = io.read_jsonl(spark, str(tmp_path / "d.jsonl"), TASK)
    assert [r["task_id"] for r in io.in_order(rows)] == [f"t{k}" for k in range(20)]
    assert io.read_jsonl(spark, str(tmp_path / "d.jsonl"), TASK, 5).count() == 5
    assert io.read_jsonl(spark, str(tmp_path / "d.jsonl"), TASK, 50).count() == 20
    assert io.at_position(rows, 3).first()["task_id"] == "t3" and io.at_position(rows, 99).count() == 0


def test_results_round_trip(spark, tmp_path):
    log = spark.createDataFrame([("a", 0, "pass"), ("b", 5, "fail")], ATTEMPT_LOG)
    path = io.result_path(str(tmp_path), "m", "d")
    io.write_results(log, path, ["task_id", "fix_mode_attempt_count", "status"])
    assert sorted(map(tuple, io.read_attempt_log(spark, path).collect())) == sorted(map(tuple, log.collect()))
    assert io.projected(log, ["status", "other"]).columns == ["status", "other"]
    assert runs.appended(log, log.drop("status")).where("status IS NULL").count() == 2
    io.write_record(log.limit(1), io.record_path(str(tmp_path), "m"))
    said = []
    assert not io.guarded(lambda: 1 / 0, said.append) and said


def test_documents_by_extension(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    assert io.read_documents(spark, str(tmp_path / "a.txt")).first()["text"] == "one\ntwo"
    assert io.read_documents(spark, str(tmp_path / "b.csv")).first()["text"] == "x: 1\ny: 2"
    for name in ("c.pdf", "d.doc"):
        with pytest.raises(ValueError):
            io.read_documents(spark, str(tmp_path / name))


def test_settings():
    assert io.Settings().updated({"learning_rate": "1e-3", "temperature": 7}).learning_rate == 1e-3
    with pytest.raises(ValueError):
        io.Settings().updated({"learning_rate": "fast"})


def test_progress_stream(spark, tmp_path):
    lines = [{"model": "m", "status": "pulling", "completed": k * 1048576, "total": 4194304, "at": f"2024-01-01T00:00:0{k}Z"} for k in range(4)]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, lines)))
    expected = progress.latest(spark.read.schema(PULL_PROGRESS).json(str(tmp_path))).collect()
    query = progress.latest(progress.read_progress(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("pulls").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT * FROM pulls").collect() == expected
    assert expected[0]["percent"] == 75.0 and expected[0]["mb"] == 3.0


def test_cursor_and_row_functions(spark):
    rows = io.with_positions(spark.createDataFrame([("a",), ("b",), ("c",)], "x string").coalesce(1))
    cursor = io.Cursor(rows, lambda r: r["x"].upper())
    assert [cursor.next() for _ in range(4)] == ["A", "B", "C", None] and len(cursor) == 3
    cursor.reset()
    assert cursor.next() == "A"
    got = io.mapped(rows.select("x"), lambda b: b, "x string")
    assert [r["x"] for r in got.collect()] == ["a", "b", "c"]
    keyed = spark.createDataFrame([({"a": 1, "b": None},), ({"a": 1},), ({},), (None,)], "m map<string,int>")
    assert [r[0] for r in keyed.select(io.has_keys(keyed["m"], ("a", "b"))).collect()] == [True, False, False, False]
    assert [name for name, _ in io.selected({"x": lambda: 1, "y": lambda: 2}, ("y", "x"))] == ["y", "x"]
    with pytest.raises(KeyError):
        io.selected({}, ("z",))


def test_settings_from_files_and_arguments(tmp_path):
    (tmp_path / "c.yaml").write_text("learning_rate: 1e-4\nmax_history: 5\nother: 1\n")
    assert (io.Settings.read(str(tmp_path / "c.yaml")).learning_rate, io.Settings.read(str(tmp_path / "c.yaml")).max_history) == (1e-4, 5)
    (tmp_path / "none.yaml").write_text("")
    assert io.Settings.read(str(tmp_path / "none.yaml")) == io.Settings()
    assert io.Settings.of_arguments([]).datasets == ("mbpp",)
    asked = io.Settings.of_arguments(["--subset-size", "7", "--datasets", "humaneval", "mbpp"])
    assert (asked.subset_size, asked.datasets) == (7, ("humaneval", "mbpp"))
    with pytest.raises(SystemExit):
        io.Settings.of_arguments(["--datasets", "other"])
    (tmp_path / "p.txt").write_text("\n hi \n")
    assert io.read_prompt(str(tmp_path / "p.txt")) == "hi" and io.read_prompt(str(tmp_path / "p.txt"), raw=True) == "\n hi \n"


def test_interventions(spark):
    events = spark.createDataFrame([("m", k * 10, 100, f"2024-01-01 00:00:{k:02d}") for k in range(8)] + [("n", None, 100, "2024-01-01 00:00:00"), ("o", 99, 100, "2024-01-01 00:00:01")], "model string, completed long, total long, at string").selectExpr("model", "completed", "total", "CAST(at AS timestamp) AS at")
    got = [(r["model"], r["intervention"], r["actual"]) for r in progress.interventions(events, [30, 30, 65, 90]).orderBy("model", "intervention").collect()]
    assert got == [("m", 1, 30.0), ("m", 2, 40.0), ("m", 3, 70.0), ("o", 1, 99.0)]
    assert progress.interventions(events, []).count() == 0
