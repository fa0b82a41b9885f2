"""Bounded histories, messages and renderings of conversations.

Histories are windows of the last k pairs of a session, so a session of any length keeps
a bounded state; everything else is arithmetic on the resulting arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

# The texts around turns and questions.
KEPT_PAIRS = 3
HUMAN, ASSISTANT = "\n\nHuman: ", "\n\nAssistant: "
PROMPT_END = "\n\nAssistant:"
MESSAGES = "array<struct<role:string,content:string>>"


def qa_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, question, answer``: each assistant's turn with the user's turn right before it."""
    talk = turns.where(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = talk.withColumns({"question": F.lag("text").over(w), "asker": F.lag("role").over(w)})
    return before.where("role = 'assistant' AND asker = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


def with_history(pairs: DataFrame, k: int = KEPT_PAIRS, session: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Adds ``history`` (the k pairs before, oldest first), ``original`` (the session's first question) and ``last_question``."""
    if k < 1:
        raise ValueError("a history keeps at least one pair")
    w = Window.partitionBy(*session).orderBy("turn")
    return pairs.withColumns({
        "history": F.collect_list(F.struct("question", "answer")).over(w.rowsBetween(-k, -1)),
        "original": F.first("question").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "last_question": F.coalesce(F.lag("question").over(w), F.first("question").over(w.rowsBetween(Window.unboundedPreceding, 0))),
    })


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def context_block(items: Column) -> Column:
    """One line with a hyphen for each item."""
    return F.array_join(F.transform(items, lambda c: F.concat(F.lit("- "), c)), "\n")


def messages(history: Column, prompt: Column, context: Column | None = None, suppress: bool = False) -> Column:
    """Complete pairs of the history as turns, then the prompt with its context."""
    full = F.filter(history, lambda p: (strip(p["question"]) != "") & (strip(p["answer"]) != ""))
    past = F.flatten(F.transform(full, lambda p: F.array(message("user", p["question"]), message("assistant", p["answer"]))))
    if context is not None:
        listed = context_block(context)
        prompt = F.when(F.coalesce(listed, F.lit("")) != "", F.concat(F.lit("<context>\n"), listed, F.lit("\n</context>\n\n"), prompt)).otherwise(prompt)
    now = F.array(message("user", prompt))
    return now.cast(MESSAGES) if suppress else F.concat(past.cast(MESSAGES), now.cast(MESSAGES))


def system_prompt(system: Column, history: Column, original: Column, suppress: bool = False) -> Column:
    """The system prompt, with the session's first question once there is a history."""
    tag = F.concat(system, F.lit("\n\n<original_question>\n"), original, F.lit("\n</original_question>"))
    return system if suppress else F.when(F.size(history) > 0, tag).otherwise(system)


def flat_history(history: Column, original: Column) -> Column:
    """All of the history in one text; questions that equal the first one aren't repeated."""

    def turn(p: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        asked = F.concat(F.lit(">> Previous question "), n, F.lit(": "), p["question"], F.lit("\n"))
        return F.concat(F.when(p["question"] != original, asked).otherwise(F.lit("")), F.lit(">> Your previous response "), n, F.lit(": "), p["answer"], F.lit("\n\n"))

    return F.concat(F.lit(">> Original Question: "), original, F.lit("\n"), F.array_join(F.transform(history, turn), ""))


def templated(msgs: Column, start: str = "", add_prompt: bool = False) -> Column:
    """Messages with content in the default template; a role it doesn't have is an error."""
    filled = F.filter(msgs, lambda m: strip(m["content"]) != "")

    def turn(m: Column) -> Column:
        wrong = F.raise_error(F.concat(F.lit("Unsupported role: "), m["role"])).cast("string")
        return F.when(m["role"] == "system", m["content"]).when(m["role"] == "user", F.concat(F.lit(HUMAN), m["content"])).when(m["role"] == "assistant", F.concat(F.lit(ASSISTANT), m["content"])).otherwise(wrong)

    return F.concat(F.lit(start), F.array_join(F.transform(filled, turn), ""), F.lit(PROMPT_END if add_prompt else ""))


def dumped(system: Column, msgs: Column) -> Column:
    """Messages as a text for logs."""
    shown = F.transform(msgs, lambda m: F.concat(F.lit("["), m["role"], F.lit("]\n"), m["content"]))
    return F.concat(system, F.lit("\n\n"), F.array_join(shown, "\n\n"), F.lit("\n"))


def merged_system(system: Column, msgs: Column) -> Column:
    """For models without a system role: the system prompt goes in front of the first message."""
    first = F.get(msgs, F.lit(0))
    return F.when(F.size(msgs) > 0, F.concat(F.array(message(first["role"], F.concat(system, F.lit("\n\n"), first["content"]))).cast(MESSAGES), F.slice(msgs, F.lit(2), F.greatest(F.size(msgs) - 1, F.lit(0))))).otherwise(msgs)


def sessions(runs: DataFrame, every: int, task: str = "task", attempt: str = "attempt") -> DataFrame:
    """Adds ``fresh_start`` (the attempt's number is a multiple of ``every``, so 0 as well) and the number of the ``session``."""
    w = Window.partitionBy(task).orderBy(attempt).rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.pmod(F.col(attempt), F.lit(every)) == 0
    return runs.withColumn("fresh_start", fresh).withColumn("session", F.sum(fresh.cast("int")).over(w))


def chosen_prompt(is_fix: Column, generate: str, fix: str) -> Column:
    return F.when(is_fix, F.lit(fix.strip())).otherwise(F.lit(generate.strip()))


def conversation_messages(turns: DataFrame) -> DataFrame:
    """``conv_id, messages``: each conversation's turns in order."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(rows.alias("rows")).select("conv_id", F.transform("rows", lambda r: message(r["role"], r["text"])).cast(MESSAGES).alias("messages"))


#: Turns that make one piece of a rendered conversation.
PIECE = 1000


def rendered_pieces(turns: DataFrame, start: str = "", add_prompt: bool = False) -> DataFrame:
    """``conv_id, piece, text``: conversations in the default template, in pieces of up to ``PIECE`` numbers of turns.

    The pieces in their order, one after the other, are what ``templated`` gives for the whole
    conversation; no task holds more of it than one piece.
    """
    numbered = turns.withColumn("piece", F.floor(F.coalesce("turn", F.lit(0)) / PIECE).cast("long"))
    ends = numbered.groupBy("conv_id").agg(F.min("piece").alias("first"), F.max("piece").alias("last"))
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    held = numbered.groupBy("conv_id", "piece").agg(rows.alias("rows")).join(ends, "conv_id")
    body = templated(F.transform("rows", lambda r: message(r["role"], r["text"])).cast(MESSAGES))
    head = F.when(F.col("piece") == F.col("first"), start).otherwise("")
    tail = F.when(F.col("piece") == F.col("last"), PROMPT_END if add_prompt else "").otherwise("")
    return held.select("conv_id", "piece", F.concat(head, body, tail).alias("text"))
