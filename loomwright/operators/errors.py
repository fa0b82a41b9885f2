"""Tracebacks and test output: extraction, classification and prompts, as column expressions.

Where a message breaks a rule that the original would raise for, the result is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free
from ..functions.text import count_of, let, strip

# The patterns, markers and phrases that results depend on.
TRACEBACK = r"(?sd)(Traceback[\s\S]*?(?:[A-Za-z\.]+[Ee]rror(?::\s*.*?)?|Exception(?::\s*.*?)?)(?=\s*Traceback|\n\s*\n|\n\s*$|$))"
ERROR_LINE = r"^[A-Za-z\.]+[Ee]rror.*"
GENERIC = "This is a generic error message."
ENDLESS = "Generated code is running infinite loop"
TARGET = "/usr/src/app/main.py"
TEST_CASE = r"(?sd)(?<=assert)(.*=?)(?=\nAssertionError)"
UNITTEST = (r"(?Ud)^Ran\s+\d+\s+tests?\s+in\s+[\d\.]+s$", r"(?d)^OK$", r"(?Ud)^FAILED\s+\((?:\w+=\d+,?\s*)+\)$", r"(?Ud)^FAIL:\s+test_\w+\s+\(\w+(\.\w+)*\)$", r"(?Ud)^ERROR:\s+test_\w+\s+\(\w+(\.\w+)*\)$")
OUTCOMES = {".": "passed", "f": "failed", "e": "resulted error in", "s": "skipped", "x": "expected failure in", "u": "got unexpected success in"}
FAILED_CASE = "Your generated code failed the following test case - {}.\nPlease update the function logic so all test cases will pass. Error message added for your reference - \n{}"
FAILED_ANY = "Your generated code failed a test case.\nPlease update the function logic so all test cases will pass. Error message added for your reference - \n{}"
NAME_PROMPT = "Your generated code had a NameError.\nPlease check the function, variable names in your generated code and make sure they are same as instruction.\nError message added for your reference - {}"
RECURSION_PROMPT = "Your generated code had a RecursionError.\nPlease chnage the function logic to avoid infinite recursion.\nError message added for your reference - RecursionError: maximum recursion depth exceeded in comparison"
OTHER_PROMPT = "Your generated code had a/an {}.\nPlease check the following error message for more details - \n{}"
UNITTEST_PROMPT = "Please check the following error messages from the python compiler for your generated solution - \n{}"


def _filled(template: str, *values: Column) -> Column:
    """The template with a value in each pair of braces."""
    pieces = template.split("{}")
    out = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        out += [value, F.lit(piece)]
    return F.concat(*out)


def found_tracebacks(message: Column) -> Column:
    """All traceback blocks; a message without the word isn't searched."""
    return F.when(F.contains(message, F.lit("Traceback")), F.regexp_extract_all(message, F.lit(TRACEBACK), F.lit(1))).when(message.isNotNull(), F.array().cast("array<string>"))


def tracebacks(message: Column) -> Column:
    """All traceback blocks; null if there aren't as many as the word occurs."""
    return let(found_tracebacks(message), lambda blocks: F.when(F.size(blocks) == count_of(message, "Traceback"), blocks))


def without_generic(message: Column) -> Column:
    """Without the wrapper's own traceback, the last one, where its text is present; null if that can't be told."""
    last_gone = let(tracebacks(message), lambda blocks: F.when(F.size(blocks) > 1, strip(F.replace(message, F.element_at(blocks, -1), F.lit("")))))
    return F.when(~F.contains(message, F.lit(GENERIC)), strip(message)).when(message.isNotNull(), last_gone)


def type_of_core(plain: Column) -> Column:
    """The error type of a message that has lost the wrapper's part already."""
    lines = F.filter(F.reverse(F.split(plain, "\n")), lambda line: line.rlike(ERROR_LINE))
    named = F.transform(F.slice(lines, 1, 1), lambda line: strip(F.split(line, ":")[0]))
    return F.when(F.contains(plain, F.lit(ENDLESS)), F.lit("Infinite Loop")).otherwise(F.get(named, F.lit(0)))


def error_type(message: Column) -> Column:
    """What the last line that looks like an error says before its colon; null if none does."""
    return let(strip(without_generic(message)), type_of_core)


def from_target(message: Column, target: str = TARGET) -> Column:
    """From the first mention of the target file on; all of it if there is none."""
    return F.coalesce(strip(F.regexp_substr(message, F.lit(f'(?s)File\\s"\\Q{target}\\E.*'))), message)


def concise(message: Column, target: str = TARGET) -> Column:
    """The message's type and its text without the wrapper's and other files' parts."""
    return F.struct(error_type(message).alias("error_type"), from_target(without_generic(message), target).alias("message"))


def test_case(message: Column, old_name: str | None = None, entry_point: Column | None = None) -> Column:
    """The assertion that failed; empty for other types, null where an AssertionError shows none."""
    found = F.when(message.rlike(TEST_CASE), F.regexp_extract(message, TEST_CASE, 1))
    if old_name is not None:
        found = F.replace(found, F.lit(old_name), entry_point)
    return let(error_type(message), lambda kind: F.when(kind == "AssertionError", strip(found)).when(kind.isNotNull(), F.lit("")))


def name_error_line(message: Column) -> Column:
    """A NameError's last line; other messages whole."""
    return F.when(error_type(message) == "NameError", strip(F.element_at(F.split(message, "\n"), -1))).otherwise(message)


def is_unittest(message: Column) -> Column:
    """Whether a line has the form of a test runner's output."""
    plain = strip(F.coalesce(message, F.lit("")))
    lines = F.split(plain, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]")

    def like(line: Column) -> Column:
        out = F.lit(False)
        for pattern in UNITTEST:
            out = out | line.rlike(pattern)
        return out

    # Every such line has one of these words.
    told = F.contains(plain, F.lit("OK")) | F.contains(plain, F.lit("Ran")) | F.contains(plain, F.lit("FAIL")) | F.contains(plain, F.lit("ERROR"))
    return F.when(told, F.exists(lines, like)).otherwise(False)


def outcome_counts(line: Column) -> Column:
    """Counts of each character of a line of test outcomes, in lower case, in the order of their first places."""
    chars = F.filter(F.split(F.lower(line), ""), lambda c: c != "")
    return F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("char"), F.size(F.filter(chars, lambda x: x == c)).alias("n")))


def outcome_summary(line: Column) -> Column:
    def told(x: Column) -> Column:
        said = F.concat(F.lit("got "), x["char"], F.lit(" in"))
        for char, text in OUTCOMES.items():
            said = F.when(x["char"] == char, F.lit(text)).otherwise(said)
        return F.concat(F.lit("Your solution "), said, F.lit(" "), x["n"].cast("string"), F.when(x["n"] == 1, F.lit(" test case.")).otherwise(F.lit(" test cases.")))

    return F.array_join(F.transform(outcome_counts(line), told), "\n")


def failures(line: Column) -> Column:
    return F.aggregate(outcome_counts(line), F.lit(0), lambda s, x: s + F.when(x["char"] != ".", x["n"]).otherwise(0))


def with_prompt(frame: DataFrame, message: str, name: str = "prompt", send_original: bool = False, extract_test_case: bool = False, old_name: str | None = None, entry_point: Column | None = None) -> DataFrame:
    """Adds what to tell the author of a program about its error, by the error's type; null where the type can't be told.

    For a test run that is the first of its different errors, in the order in which they appear.
    The steps are columns of their own, so that no search is made twice.
    """
    rule = "-" * 50
    names = free(frame.columns, "plain", "core", "unittest", "kind", "short", "first")
    plain, core, unittest, kind, short, first = map(F.col, names)
    # Most messages have no process's name, and are spared the search for one.
    unnamed = F.when(F.contains(F.col(message), F.lit("Process Process-")), F.regexp_replace(message, r"Process Process-\d+:", "")).otherwise(F.col(message))
    steps = frame.withColumn(names[0], strip(unnamed))
    steps = steps.withColumn(names[1], without_generic(plain)).withColumn(names[2], is_unittest(plain))
    steps = steps.withColumn(names[3], type_of_core(core)).withColumn(names[4], from_target(core))
    steps = steps.withColumn(names[5], F.when(unittest, F.get(F.coalesce(tracebacks(core), F.array(F.lit(None).cast("string"))), F.lit(0))))
    block = F.concat(F.lit(f"{rule}\nError 1:\nError type: "), type_of_core(strip(first)), F.lit("\n"), first, F.lit(rule))
    asserted = _filled(FAILED_CASE, test_case(short, old_name, entry_point), short) if extract_test_case else _filled(FAILED_ANY, short)
    # What is left from the target file on has no wrapper's text, or the type would be null.
    other = plain if send_original else _filled(OTHER_PROMPT, type_of_core(short), short)
    told = (
        F.when(unittest, strip(_filled(UNITTEST_PROMPT, F.when(F.size(found_tracebacks(core)) == 0, F.lit(rule)).otherwise(block))))
        .when(kind == "AssertionError", asserted)
        .when(kind == "NameError", _filled(NAME_PROMPT, F.when(type_of_core(short) == "NameError", strip(F.element_at(F.split(short, "\n"), -1))).otherwise(short)))
        .when(kind == "RecursionError", F.lit(RECURSION_PROMPT))
        .when(kind.isNotNull(), other)
    )
    return steps.withColumn(name, told).drop(*names)
