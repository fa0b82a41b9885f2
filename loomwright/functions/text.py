"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is made once and held, not once for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """All white space off both ends, Unicode's too; Spark's ``trim`` takes spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def count_of(text: Column, word: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def joined(parts: Column, by: str = "\n") -> Column:
    return F.array_join(parts, by)


#: Names that stay free in Python.
KEYWORDS = (
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except", "finally", "for",
    "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
)


def identifier(name: Column) -> Column:
    """A valid variable name: other characters become ``_``, none stay at the end, digits and keywords are moved out of the way."""
    plain = F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_]", "_"), "_+$", "")
    led = F.when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).when(plain == "", F.lit("_")).otherwise(plain)
    return F.when(led.isin(*KEYWORDS), F.concat(led, F.lit("_var"))).otherwise(led)


def is_allowed(value: Column) -> Column:
    """Letters, digits, dot, underscore, colon and hyphen only; one line end at the very end is let through."""
    return value.rlike(r"^[a-zA-Z0-9._:-]+\n?\z")


def shell_quoted(value: Column) -> Column:
    """As it is where the shell takes it literally, else in single quotes; null where it isn't allowed."""
    plain = F.when(value.rlike(r"^[a-zA-Z0-9_@%+=:,./-]+\z"), value)
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(is_allowed(value), F.coalesce(plain, quoted))


def tagged(model: Column, tag: str = "latest") -> Column:
    """A model's name with a tag, the default one if it has none."""
    return F.when(F.contains(model, F.lit(":")), model).otherwise(F.concat(model, F.lit(f":{tag}")))


def path_safe(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def before_stops(text: Column, stops: tuple[str, ...]) -> Column:
    """What stands before the first of each stop string, stripped."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return strip(text)


def wrapped(text: Column, width: int = 80) -> Column:
    """Lines longer than ``width`` broken at single spaces, greedily. A word that is longer stays whole;
    before one that leads a line an empty line is made, as in the original."""

    def broken(line: Column) -> Column:
        nothing = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def step(s: Column, word: Column) -> Column:
            fits = F.length(s["open"]) + F.length(word) + 1 <= width
            longer = F.when(s["open"] == "", word).otherwise(F.concat(s["open"], F.lit(" "), word))
            return F.when(fits, F.struct(s["done"].alias("done"), longer.alias("open"))).otherwise(F.struct(F.array_append(s["done"], s["open"]).alias("done"), word.alias("open")))

        return F.aggregate(F.split(line, " "), nothing, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))

    lines = F.transform(F.split(text, "\n"), lambda line: F.when(F.length(line) <= width, F.array(line)).otherwise(broken(line)))
    return F.array_join(F.flatten(lines), "\n")


#: Code put in front of a generated program, and the guard that ends it after a time.
QUIET = "import warnings\nwarnings.filterwarnings('ignore')\n"
GUARD = (
    "import multiprocessing\n\nif __name__ == '__main__':\n    process = multiprocessing.Process(target={target})\n    process.start()\n    process.join({seconds})\n"
    "    if process.is_alive():\n        process.terminate()\n        process.join()\n        raise Exception('Generated code is running infinite loop')\n"
    "    if process.exitcode != 0:\n        raise Exception('This is a generic error message.')\n"
)


def program(code: Column, tests: Column, entry_point: Column, seconds: int = 10) -> Column:
    """A runnable program: the prelude, the code, its tests and the time guard, parted by blank lines."""
    check = F.concat(F.lit("def run_check():\n    check("), entry_point, F.lit(")"))
    return F.concat_ws("\n\n", F.lit(QUIET), code, tests, check, F.lit(GUARD.format(target="run_check", seconds=seconds)))


def requirements_file(requirements: Column) -> Column:
    """The text of a requirements file; null, so no file, only for the one entry that says none."""
    none = (F.size(requirements) == 1) & F.contains(F.lower(F.get(requirements, F.lit(0))), F.lit("none"))
    return F.when(~none, F.array_join(requirements, "\n"))
