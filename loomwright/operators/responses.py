"""Parts of a model's response, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

# The forms that responses and calls have.
REQUIREMENTS = r"(?s)### Requirements\s*(.*?)\s*###"
CODE = r"(?s)### Code\s*```(?:python)?(.*?)```"
TAGGED = r"(?s)\[PYTHON\](.*)\[\\PYTHON\]"
FENCE = r"```(?:python)?\s*([\s\S]*?)\s*```"
CAST_CALL = r"(?U)^[a-z]{0,5}\([a-z_]+\([\w,\s]+\)\)"
CAST_INNER = r"^[a-z]{0,5}\((.*)\)"
ASSERTED = r"(?<=assert\s)(.*?)(?===)"
RECORD = "<s>### Instruction:\n{q}\n### Response: {a}</s>"


def parsed(response: Column) -> Column:
    """``requirements`` and ``code`` of a response with headed sections; null for an empty response."""
    listed = strip(F.regexp_extract(response, REQUIREMENTS, 1))
    names = F.filter(F.transform(F.split(listed, ","), strip), lambda x: x != "")
    requirements = F.when(F.lower(listed) == "none", F.array().cast("array<string>")).otherwise(names)
    return F.when(response != "", F.struct(requirements.alias("requirements"), strip(F.regexp_extract(response, CODE, 1)).alias("code")))


def sectioned_code(response: Column) -> Column:
    """The code of a response in sections: the last code section's, or the first block of a section of another name."""

    def step(code: Column, section: Column) -> Column:
        cut = F.instr(section, "\n")
        name = F.lower(strip(F.substring(section, F.lit(1), cut - 1)))
        content = strip(F.substring(section, cut + 1, F.length(section)))
        own = F.when(content.rlike(FENCE), strip(F.regexp_extract(content, FENCE, 1))).otherwise(code)
        any_block = F.when(section.rlike(FENCE), strip(F.regexp_extract(section, FENCE, 1))).otherwise(code)
        known = F.when(name == "code", own).when(name.isin("requirements", "example"), code).otherwise(any_block)
        return F.when((strip(section) == "") | (cut == 0), code).otherwise(known)

    return F.aggregate(F.split(response, r"###\s*"), F.lit(""), step)


def tagged_code(response: Column) -> Column:
    """The code between its tags (the closing one with a backslash), else by sections."""
    return F.when(response.rlike(TAGGED), F.regexp_extract(response, TAGGED, 1)).otherwise(sectioned_code(response))


def without_brackets(call: Column) -> Column:
    """A call that begins with a bracket loses its first and its last character."""
    plain = strip(call)
    return F.when(call.startswith("("), F.substring(plain, F.lit(2), F.greatest(F.length(plain) - 2, F.lit(0)))).otherwise(call)


def uncast(call: Column) -> Column:
    """``int(foo(5))`` gives ``foo(5)``; other forms stay."""
    return F.when(call.rlike(CAST_CALL), F.regexp_extract(call, CAST_INNER, 1)).otherwise(call)


def asserted_call(line: Column) -> Column:
    """What stands between ``assert`` and the first ``==``; null if there is none."""
    return F.when(line.rlike(ASSERTED), F.regexp_extract(line, ASSERTED, 1))


def tuning_text(question: Column, answer: Column) -> Column:
    """A fine-tuning record; a null is spelled ``None``."""
    head, rest = RECORD.split("{q}")
    middle, tail = rest.split("{a}")
    return F.concat(F.lit(head), F.coalesce(question, F.lit("None")), F.lit(middle), F.coalesce(answer, F.lit("None")), F.lit(tail))


def log_pairs(log: Column, question: str, answer: str, drop_last: int = 5, most: int = 50) -> Column:
    """Questions and answers of a log by two patterns, paired by their places: the first ``most``, answers without their end."""
    asked, told = (F.regexp_extract_all(log, F.lit(p), F.lit(1)) for p in (question, answer))
    n = F.least(F.size(asked), F.size(told), F.lit(most))
    pairs = F.arrays_zip(F.slice(asked, F.lit(1), n).alias("question"), F.slice(told, F.lit(1), n).alias("answer"))
    return F.transform(pairs, lambda p: F.struct(p["question"].alias("question"), F.substring(p["answer"], F.lit(1), F.greatest(F.length(p["answer"]) - drop_last, F.lit(0))).alias("answer")))


#: Turns whose places are counted together, and blocks whose counts are.
BLOCK = 1000


def _numbered(turns: DataFrame, role: str) -> DataFrame:
    """``conv_id, k, text``: the turns of a role with their numbers in the conversation, counted by blocks of turns and blocks of these."""
    own = turns.where(F.col("role") == role).withColumn("block", F.floor(F.coalesce("turn", F.lit(-(1 << 40)).cast("long")) / BLOCK))
    counts = own.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("top", F.floor(F.col("block") / BLOCK))
    before = lambda *by: Window.partitionBy("conv_id", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    tops = counts.groupBy("conv_id", "top").agg(F.sum("n").alias("n"))
    tops = tops.select("conv_id", "top", F.coalesce(F.sum("n").over(before("top")), F.lit(0)).alias("above"))
    offsets = counts.withColumn("inner", F.coalesce(F.sum("n").over(before("top", "block")), F.lit(0))).join(tops, ["conv_id", "top"]).select("conv_id", "block", (F.col("above") + F.col("inner")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "text"))
    return own.withColumn("place", place).join(offsets, ["conv_id", "block"]).select("conv_id", (F.col("offset") + F.col("place") - 1).alias("k"), "text")


def paired_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, k, question, answer``: the k-th question of each conversation with its k-th answer, all of them.

    What ``log_pairs`` does for a log's text, for its turns: no conversation is gathered, and one of
    any length is spread over tasks by blocks of its turns. Turns that tie are ordered by their texts; one
    without a number comes first.
    """
    asked, told = (_numbered(turns, role).withColumnRenamed("text", name) for role, name in (("user", "question"), ("assistant", "answer")))
    return asked.join(told, ["conv_id", "k"])
