"""Conversations of any length in blocks, the splitter as a table function, downloads in rounds."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomwright.operators import chat, responses, retrieval
from loomwright.plans import catalogue
from loomwright.streaming import progress

TURN = "conv_id long, turn long, role string, text string"
NOON = datetime(2024, 1, 1, 12)


def test_all_pairs_of_a_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(responses, "BLOCK", 7)
    rows = [(1, t, ("user", "assistant", "system", "user")[t % 4], f"{t}") for t in range(1500)] + [(2, 0, "assistant", "a"), (2, 5, "user", "q"), (2, None, "user", "none"), (3, 0, "user", None)]
    asked = {c: [r[3] for r in sorted((r for r in rows if r[0] == c and r[2] == "user"), key=lambda r: (r[1] is not None, r[1] or 0))] for c in (1, 2, 3)}
    told = {c: [r[3] for r in rows if r[0] == c and r[2] == "assistant"] for c in (1, 2, 3)}
    got = sorted(map(tuple, responses.paired_turns(spark.createDataFrame(rows, TURN)).collect()))
    assert got == sorted((c, k, q, a) for c in (1, 2, 3) for k, (q, a) in enumerate(zip(asked[c], told[c])))


def test_a_long_conversation_is_spread_over_tasks(spark):
    turns = spark.range(1_000_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "cast(id AS string) AS text")
    # Half a million short rows are little to Spark, which would put its partitions together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in responses._numbered(turns, "user").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 500_000 and max(sizes) < 250_000
    assert responses.paired_turns(turns).where("answer = question + 1 AND k = question / 2").count() == 500_000


def test_pieces_are_the_whole_rendering(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 5)
    rows = [(c, t, ("system", "user", "assistant")[t % 3], None if t == 4 else f"text {t}" if t % 5 else " ") for c, n in ((1, 37), (2, 1), (3, 5)) for t in range(n)]
    turns = spark.createDataFrame(rows, TURN)
    pieces = chat.rendered_pieces(turns, start="<s>", add_prompt=True).collect()
    got = {c: "".join(r["text"] for r in sorted(pieces, key=lambda r: r["piece"]) if r["conv_id"] == c) for c in (1, 2, 3)}
    whole = chat.conversation_messages(turns).select("conv_id", chat.templated(F.col("messages"), "<s>", True).alias("text"))
    assert got == {r["conv_id"]: r["text"] for r in whole.collect()} and sum(r["conv_id"] == 1 for r in pieces) == 8


def test_the_table_function_gives_the_chunks(spark, sf_dir):
    both = [sorted(map(tuple, catalogue.queries()[name](spark, sf_dir).collect())) for name in ("doc_chunks", "doc_chunks_sql")]
    assert both[0] == both[1]
    retrieval.register_splitter(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM split_text('abcdef', 4, 1)").collect()] == [(0, "abcd"), (1, "def")]
    assert spark.sql("SELECT * FROM split_text(CAST(NULL AS string))").count() == 0


def test_rounds_retries_and_fallback(spark):
    at = lambda s: NOON + timedelta(seconds=s)
    rows = [("a", "pulling", 10, 100, at(0)), ("a", "pulling", 30, 100, at(5)), ("a", "pulling", 50, 100, at(100)), ("a", "Success", None, None, at(104))]
    rows += [("b", "pulling", k, 100, at(100 * k)) for k in range(12)] + [("b", "success", None, None, at(1200)), ("c", "pulling", 1, 100, at(0))]
    events = spark.createDataFrame(rows, "model string, status string, completed long, total long, at timestamp")
    found = progress.rounds(events, "30 seconds")
    assert [(r["n"], r["top"], r["done"]) for r in found.where("model = 'a'").orderBy("began").collect()] == [(2, 30.0, False), (2, 50.0, True)]
    assert sorted((r["model"], r["outcome"], r["rounds"]) for r in progress.retried(found).collect()) == [("a", "pulled", 2), ("b", "failed", 10), ("c", "open", 1)]
    stops = progress.interventions(events, [30.0])
    assert sorted(tuple(r) for r in progress.fallback(events, stops, 30).collect()) == [("a", True, 4), ("b", False, None), ("c", False, None)]


def test_any_number_of_targets_in_one_pass(spark):
    rows = [("m", "pulling", k, 100, NOON + timedelta(seconds=k)) for k in range(100)]
    events = spark.createDataFrame(rows, "model string, status string, completed long, total long, at timestamp")
    targets = [float(t) for t in range(0, 80, 10)]
    assert progress.interventions(events, targets).count() == 5
    got = progress.interventions(events, targets, most=None)
    assert [(r["intervention"], r["actual"]) for r in got.orderBy("intervention").collect()] == [(k + 1, max(t, 1.0 * k)) for k, t in enumerate(targets)]
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan") <= 1
