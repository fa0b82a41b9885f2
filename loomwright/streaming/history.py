"""Conversation histories over a stream of turns, in bounded state.

A session's state is its first question, the last k pairs and the question that waits for
its answer. Turns of a session come in order: sorted inside a batch, and no batch has turns
before those of an earlier one. Each answer gives the row that ``chat.with_history`` gives
for the whole table, however the turns are split into batches. Two further roles act on the
state: ``clear`` drops the pairs and keeps the first question, ``reset`` drops all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.chat import KEPT_PAIRS

CLEAR, RESET = "clear", "reset"
_PAIRS = "array<struct<question:string,answer:string>>"
STATE = f"original string, begun boolean, last string, waiting string, asked boolean, pairs {_PAIRS}"
HISTORY = f"conv_id long, turn long, question string, answer string, history {_PAIRS}, original string, last_question string"
_EMPTY = (None, False, None, None, False, [])


class _Session(StatefulProcessor):
    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        original, begun, last, waiting, asked, pairs = self.state.get() if self.state.exists() else _EMPTY
        pairs = [(p[0], p[1]) for p in pairs]
        for r in sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0)):
            role, text = r["role"], r["text"]
            if role == "user":
                waiting, asked = text, True
            elif role == "assistant":
                if asked:
                    if not begun:
                        original, begun, last = waiting, True, waiting
                    yield Row(conv_id=key[0], turn=r["turn"], question=waiting, answer=text, history=[Row(question=q, answer=a) for q, a in pairs], original=original, last_question=last)
                    # Without pairs the last question is the first one.
                    pairs, last = [*pairs, (waiting, text)][-self.k :], original if waiting is None else waiting
                waiting, asked = None, False
            elif role == CLEAR:
                pairs, last = [], original
            elif role == RESET:
                original, begun, last, waiting, asked, pairs = _EMPTY
        self.state.update((original, begun, last, waiting, asked, pairs))

    def close(self) -> None:
        pass


def histories(turns: DataFrame, k: int = KEPT_PAIRS) -> DataFrame:
    """The rows of ``chat.with_history`` for a stream of ``conv_id, turn, role, text``; needs RocksDB as state store."""
    if k < 1:
        raise ValueError("a history keeps at least one pair")
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return own.groupBy("conv_id").transformWithState(_Session(k), HISTORY, "Append", "None")
