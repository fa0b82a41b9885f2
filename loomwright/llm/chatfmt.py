"""Chat formatting: a finite-state machine over roles checks the order of turns and a
declarative template turns them into text segments with a loss flag each.

Control strings inside texts are escaped reversibly: ``<|`` with n backslashes inside
gets one more, so no text holds a bare ``<|``, and ``read_back`` takes one away again.

A conversation is streamed in the order of its turns, so one of any length is formatted
in bounded memory; other conversations are dealt over the partitions by their id.

Cases: a null text counts as empty, a null role as an empty one. Rows without a
conversation id make a conversation of their own. Turns that tie are ordered by role and
text; repeated rows stay repeated turns. Empty tables give empty results. Only the four
columns named here are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the roles whose text is learned, and the turns that may follow each other."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: State to the roles that may come next; a turn's role is the state after it.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepts: tuple[str, ...] = ("assistant",)


SEGMENTS = "conv_id long, turn long, segment int, text string, loss boolean, turn_ok boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"

_BARE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _BARE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Three segments for each turn: its head, its text and its end. Rows of a conversation stay together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run
        state: str | None = ""
        for batch in batches:
            out: list[tuple] = []
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                role, text = role or "", text or ""
                if conv != current:
                    current, state = conv, ""
                ok = state is not None and role in template.follows.get(state, ())
                state = role if ok else None
                head = template.before_role + escape_role(role) + template.after_role
                out += [(conv, turn, 0, head, False, ok), (conv, turn, 1, escape(text), role in template.loss_roles, ok), (conv, turn, 2, template.after_text, False, ok)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [x.split()[0] for x in SEGMENTS.split(", ")])

    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


class _Reader:
    """Reads one conversation's formatted text as it comes and keeps only digests and the turn that isn't complete."""

    def __init__(self, conv: int | None, template: Template):
        self.conv, self.template = conv, template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.ok, self.last, self.pending = True, "", ""
        t = template
        self.turn = re.compile(f"{re.escape(t.before_role)}([^\n]*?){re.escape(t.after_role)}(.*?){re.escape(t.after_text)}", re.S)

    def add(self, text: str, loss: bool, ok: bool) -> None:
        self.chars += len(text)
        self.ok &= ok
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.pending += text
        if text == self.template.after_text:
            while m := self.turn.match(self.pending):
                self.last = unescape_role(m[1])
                self.turns.update(f"{self.last}\n{unescape(m[2])}\n".encode())
                self.n += 1
                self.pending = self.pending[m.end() :]

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.ok and not self.pending and self.last in self.template.accepts


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of each conversation by what ``segments`` wrote; ``formatted`` must come straight from it."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [x.split()[0] for x in DIGEST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        for batch in batches:
            done = []
            for conv, text, loss, ok in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "text", "loss", "turn_ok"))):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv, template)
                reader.add(text, loss, ok)
            if done:
                yield batch_of(done)
        if reader is not None:
            yield batch_of([reader.row()])

    return formatted.mapInArrow(run, DIGEST)
