"""Streams in several batches against the same tables read at once."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomwright.operators import chat, runs
from loomwright.sources.append import Appended
from loomwright.streaming import attempts, history
from loomwright.streaming.run import drained

RUN = "task long, attempt int, returncode int, at timestamp"
TURN = "conv_id long, turn long, role string, text string"
NOON = datetime(2024, 1, 1, 12)


def streamed(spark, folder, schema, batches, name):
    """A stream whose batches are these lists of rows, in this order."""
    path = folder / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def outcome(rows):
    return sorted(tuple(r) for r in rows.select("task", "attempt", "status").collect())


def test_late_and_repeated_runs_settle_as_one_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(t, a, int(rng.random() < 0.6), NOON + timedelta(minutes=a)) for t in range(40) for a in range(rng.randint(1, 9))]
    rows = [r for r in rows if not (r[1] and any(s[0] == r[0] and s[1] < r[1] and s[2] == 0 for s in rows))]
    arrived = rng.sample(rows, len(rows)) + rng.sample(rows, 30)
    batches = [arrived[k::4] for k in range(4)]
    stream = attempts.changes(streamed(spark, tmp_path, RUN, batches, "in"), late="1 day")
    table = drained(stream, Appended(spark, f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
    every = spark.createDataFrame(rows, RUN)
    got = attempts.settled(table.read(), every=2)
    assert outcome(got) == outcome(runs.outcomes(every))
    fresh = {r["task"]: r["n"] for r in every.where("attempt <= 5 AND attempt % 2 = 0").groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["task"]: r["fresh_starts"] for r in got.collect()} == fresh
    # Repeated runs gave no further rows.
    changed = table.read().where("NOT closed")
    assert changed.count() == changed.select("task", "made", "passed").distinct().count()


def test_tasks_that_nobody_goes_on_with_are_closed(spark, tmp_path):
    hours = lambda h: NOON + timedelta(hours=h)
    batches = [[(1, 0, 1, hours(0)), (2, 0, 1, hours(0))], [(2, 1, 1, hours(1))], [(3, 0, 0, hours(5))], [(3, 0, 0, hours(5))], [(1, 1, 0, hours(6)), (4, 0, 1, None)], [(3, 0, 0, hours(20))]]
    stream = attempts.changes(streamed(spark, tmp_path, RUN, batches, "in"), late="10 minutes", patience_seconds=7200)
    table = drained(stream, Appended(spark, f"{tmp_path}/out"), f"{tmp_path}/checkpoint").read()
    closed = {(r["task"], r["made"], r["passed"]) for r in table.where("closed").collect()}
    assert {(1, 1, 0), (2, 3, 0)} <= closed
    # What comes after a task was closed adds to what is known of it.
    assert {(1, 1, "pass"), (2, 1, "fail"), (3, 0, "pass"), (4, 0, "fail")} == set(outcome(attempts.settled(table)))


def test_tallies_settle_as_one_table_without_python(spark, tmp_path):
    rng = random.Random(4)
    rows = [(t, a, int(rng.random() < 0.6), NOON + timedelta(hours=9 * a)) for t in range(40) for a in range(rng.randint(1, 9))]
    rows = [r for r in rows if not (r[1] and any(s[0] == r[0] and s[1] < r[1] and s[2] == 0 for s in rows))]
    arrived = rng.sample(rows, len(rows)) + rng.sample(rows, 30)
    stream = attempts.tallies(streamed(spark, tmp_path, RUN, [arrived[k::3] for k in range(3)], "in"), late="10 days")
    assert "Python" not in stream._jdf.queryExecution().logical().toString() and "TransformWithState" not in stream._jdf.queryExecution().logical().toString()
    table = drained(stream, Appended(spark, f"{tmp_path}/out"), f"{tmp_path}/checkpoint", mode="update")
    assert outcome(attempts.settled(table.read())) == outcome(runs.outcomes(spark.createDataFrame(rows, RUN)))


def turns(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(c, t, rng.choice(("user", "assistant", "system", "assistant")) if rng.random() < 0.3 else ("user", "assistant")[t % 2], rng.choice((f"text {t}", "", None))) for c in range(12) for t in range(rng.randint(0, 14))]


@pytest.mark.parametrize("parts", [1, 4])
def test_any_split_gives_the_histories_of_the_whole_table(spark, tmp_path, parts):
    rows = sorted(turns(1), key=lambda r: r[1])
    cuts = [len(rows) * k // parts for k in range(parts + 1)]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    table = drained(history.histories(streamed(spark, tmp_path, TURN, batches, "in")), Appended(spark, f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
    names = ["conv_id", "turn", "question", "answer", "history", "original", "last_question"]
    expected = chat.with_history(chat.qa_pairs(spark.createDataFrame(rows, TURN))).select(names)
    assert sorted(map(repr, table.read().select(names).collect())) == sorted(map(repr, expected.collect()))


def test_clear_keeps_the_question_and_reset_drops_it(spark, tmp_path):
    talk = lambda t, q, a: [(1, t, "user", q), (1, t + 1, "assistant", a)]
    batches = [talk(0, "q0", "a0") + talk(2, "q1", "a1"), [(1, 4, "clear", None), *talk(5, "q2", "a2")], [*talk(7, "q3", "a3"), (1, 9, "reset", None)], talk(10, "q4", "a4")]
    table = drained(history.histories(streamed(spark, tmp_path, TURN, batches, "in"), 2), Appended(spark, f"{tmp_path}/out"), f"{tmp_path}/checkpoint").read()
    got = [(r["question"], [p["question"] for p in r["history"]], r["original"], r["last_question"]) for r in table.orderBy("turn").collect()]
    assert got == [("q0", [], "q0", "q0"), ("q1", ["q0"], "q0", "q0"), ("q2", [], "q0", "q0"), ("q3", ["q2"], "q0", "q2"), ("q4", [], "q4", "q4")]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Input that comes after the first call is all that the second one reads; its batches are further ones."""
    first = streamed(spark, tmp_path, TURN, [[(1, 0, "user", "q"), (1, 1, "assistant", "a")]], "in")
    out = Appended(spark, f"{tmp_path}/out")
    drained(history.histories(first), out, f"{tmp_path}/checkpoint")
    assert out.read().count() == 1
    spark.createDataFrame([(1, 2, "user", "r"), (1, 3, "assistant", "b")], TURN).coalesce(1).write.parquet(f"{tmp_path}/in/900")
    drained(history.histories(spark.readStream.schema(TURN).parquet(f"{tmp_path}/in/*")), out, f"{tmp_path}/checkpoint")
    assert [(r["question"], len(r["history"])) for r in out.read().orderBy("turn").collect()] == [("q", 0), ("r", 1)]
