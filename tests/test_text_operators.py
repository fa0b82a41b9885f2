from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import text as tx
from loomwright.operators import calls, chat, errors, responses, retrieval, runs


def one(spark, column, *values):
    names = [f"v{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first()["x"]


TB = 'Traceback (most recent call last):\n  File "a.py", line 1\n'


@pytest.mark.parametrize("text", [
    TB + "ValueError: x", TB + "ValueError: x\n\n" + TB + "KeyError: 'é'", TB + "ValueError: x\n" + TB + "Exception: y", "fine", TB + "NameError: a\n",
    TB + "ValueError: one\ntwo\n   \nrest",
])
def test_tracebacks_as_python_finds_them(spark, text):
    pattern = re.compile(errors.TRACEBACK.replace("(?sd)", ""), re.DOTALL)
    expected = pattern.findall(text)
    assert one(spark, errors.found_tracebacks, text) == expected


def test_error_types(spark):
    assert one(spark, errors.error_type, TB + "NameError: name 'x'") == "NameError"
    assert one(spark, errors.error_type, "Generated code is running infinite loop") == "Infinite Loop"
    assert one(spark, errors.error_type, "Exception: x") is None
    assert one(spark, errors.is_unittest, "Ran 3 tests in 0.01s") and one(spark, errors.is_unittest, "a\nOK")
    assert not one(spark, errors.is_unittest, "  \n ") and not one(spark, errors.is_unittest, "FAILED (expected failures=1)")
    assert one(spark, errors.outcome_summary, "..F") == "Your solution passed 2 test cases.\nYour solution failed 1 test case."


def test_calls(spark):
    assert calls.signature_of("foo(4, 5)") == "foo(arg_int: int, arg_int_2: int)"
    assert calls.split_call("foo(1, )") == ("foo", ["1", ""]) and calls.split_call("foo(1,)") == ("foo", ["1"]) and calls.signature_of("foo(1, )") == "foo(arg_int: int, arg_str: str)"
    assert calls.signature_of("f()") == "f()" and calls.signature_of("none") is None
    assert calls.signature_of("f([1, 2], Root(5))") == "f(arg_list_int: List[int], arg_root: Root)"
    assert calls.signature_of("f(__import__('os').getcwd())") == "f(arg___import: __import__)"
    assert one(spark, responses.uncast, "int(foo(5))") == "foo(5)" and one(spark, responses.uncast, "foo(5)") == "foo(5)"
    assert one(spark, responses.asserted_call, "assert foo(5) == 10") == "foo(5) "
    assert one(spark, responses.without_brackets, "(foo(1))") == "foo(1)" and one(spark, responses.without_brackets, "foo(1)") == "foo(1)"
    source = "import os\nfrom a import b as c\ndef f():\n    return 1\nx = f()\n"
    assert calls.function_names(source) == ["f", "c"] and calls.has_example_call(source, "f") and not calls.has_example_call(source, "g")
    assert calls.kept_blocks("x =") == "x =" and "x = f()" not in calls.kept_blocks(source)


def test_identifiers_and_names(spark):
    for name, expected in (("1a-b_", "_1a_b"), ("class", "class_var"), ("", "_")):
        assert one(spark, tx.identifier, name) == expected
    assert one(spark, tx.is_allowed, "a.b_c:1-x") and not one(spark, tx.is_allowed, "a b")
    assert one(spark, tx.tagged, "m") == "m:latest" and one(spark, tx.tagged, "m:7b") == "m:7b"
    assert one(spark, lambda c: tx.before_stops(c, ("\n\nHuman:",)), "a\n\nHuman: b") == "a"


def test_responses(spark):
    assert one(spark, responses.parsed, "### Requirements\nnone\n### Code\n```python\nx\n```")["requirements"] == []
    got = one(spark, responses.parsed, "### Requirements\npandas, numpy\n### Code\n```\nx\n```")
    assert got["requirements"] == ["pandas", "numpy"] and got["code"] == "x"
    assert one(spark, responses.parsed, "") is None
    assert one(spark, responses.tuning_text, "Q", "A") == "<s>### Instruction:\nQ\n### Response: A</s>"
    assert one(spark, lambda q: responses.tuning_text(q, F.lit(None).cast("string")), "Q").endswith("None</s>")


def python_wrap(text: str, width: int) -> str:
    out = []
    for line in text.split("\n"):
        if len(line) <= width:
            out.append(line)
            continue
        held = ""
        for word in line.split(" "):
            if len(held) + len(word) + 1 <= width:
                held = f"{held} {word}" if held else word
            else:
                out.append(held)
                held = word
        out += [held] if held else []
    return "\n".join(out)


def test_wrapping(spark):
    texts = ["a b c", "x" * 30 + " y z", "one two three four five six", "  a  b " * 5, "", "short\n" + "long words in a line " * 3]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", tx.wrapped(F.col("t"), 12).alias("w")).collect()
    assert {r["k"]: r["w"] for r in rows} == {k: python_wrap(t, 12) for k, t in enumerate(texts)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400))
def test_chunks_are_bounded_and_whole(text):
    got = retrieval.split_text(text, 40, 8)
    assert all(0 < len(c) <= 40 for c in got)
    assert set(text.split()) <= {w for c in got for w in c.split()} | {w for w in text.split() if len(w) > 8} or len(text) <= 40


def test_nearest_breaks_ties_by_id(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    got = retrieval.nearest(base, base.where("vec_id = 2"), 2).orderBy("rank").collect()
    assert [(r["qid"], r["vec_id"]) for r in got] == [(2, 1), (2, 2)]


def test_history_is_bounded_and_turns_alternate(spark):
    turns = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(12)] + [(2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", " ")], "conv_id long, turn long, role string, text string")
    rows = chat.with_history(chat.qa_pairs(turns)).withColumn("m", chat.messages(F.col("history"), F.col("question"))).collect()
    for r in rows:
        assert len(r["history"]) <= 3
        assert [m["role"] for m in r["m"]] == ["user", "assistant"] * (len(r["m"]) // 2) + ["user"]


def test_outcomes(spark):
    rows = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 0, 1), (2, 5, 1), (2, 6, 0)], "task long, attempt int, returncode int")
    assert sorted(map(tuple, runs.outcomes(rows).collect())) == [(1, 1, "pass"), (2, 5, "fail")]


def test_prompts_beside_columns_of_any_name(spark):
    """Helper columns take no name that is there; every kind of a runner's line is seen."""
    names = ("plain", "core", "_kind", "SHORT", "first", "unittest", "prompt")
    rows = [(TB + "NameError: name 'x'", *names), ("Process Process-3:\n" + TB + "KeyError: 'a'", *names), (None, *names)]
    frame = spark.createDataFrame(rows, "stderr string, " + ", ".join(f"`{n}` string" for n in names))
    got = errors.with_prompt(frame, "stderr", "told")
    assert got.columns == [*frame.columns, "told"] and {tuple(r)[1:-1] for r in got.collect()} == {names}
    assert [r["told"] is not None for r in got.collect()] == [True, True, False]
    for line in ("FAIL: test_a (x.T)", "ERROR: test_b (x.T)", "FAILED (errors=1)", "OK", "Ran 1 test in 0.1s"):
        assert one(spark, errors.is_unittest, f"..\n{line}\n")
