"""Quality rules that judge lines first and documents by what is left of them.

Every line with a word is tried against three rules; lines that fail are removed, and
a document that loses more than ``max_lost_percent`` of its words is rejected.

* navigation: at least two separators, and separators for 30 % of its words or more;
* punctuation: as many exclamation marks as words, symbols for a third of its words or
  more, or fewer than four words without a closing mark;
* boilerplate: one of the stock phrases, in either case.

Cases: null, empty and blank texts have no words and fail the base rule. Repeated rows
give repeated results. Tables without rows give none. Only the id and the text column
are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .storage import small_batches

#: Stock phrases of boilerplate lines, in lower case.
PHRASES = ("licensed under", "all rights reserved", "privacy policy", "terms of use", "terms of service", "copyright", "accept cookies", "subscribe to our newsletter")
SEPARATORS = "|>"
SYMBOLS = "#*$%&|<>"
CLOSING = ".!?:;\"')]}"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50
WINDOW = 8

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_lines_kept long, n_words_kept long, cleaned string"


def _among(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SEPARATOR, _SYMBOL, _CLOSING = _among(SEPARATORS), _among(SYMBOLS), _among(CLOSING)


def _seen_before(numbers: np.ndarray) -> np.ndarray:
    """Of each number, whether it stands before."""
    order = np.argsort(numbers, kind="stable")
    earlier = np.zeros(len(numbers), bool)
    earlier[order[1:]] = numbers[order[1:]] == numbers[order[:-1]]
    return earlier


def _found_twice(words: np.ndarray, starts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of each window (``starts``: its first word), whether its text has the same ``WINDOW`` words once more."""
    keys = tb.windows(tb.mix(words.astype(np.uint64)), WINDOW)[starts] ^ tb.mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    one, two = order[1:], order[:-1]
    alike = np.flatnonzero(keys[one] == keys[two])
    one, two = one[alike], two[alike]
    good = text[one] == text[two]
    for k in range(WINDOW):
        good &= words[starts[one] + k] == words[starts[two] + k]
    if not good.all():
        # Equal hashes of different windows: all are numbered exactly, two halves at a time.
        ids, width = words, 1
        while width < WINDOW:
            ids = np.unique(ids[: len(ids) - width] * (int(ids.max()) + 1) + ids[width:], return_inverse=True)[1]
            width *= 2
        keys = np.unique(text * (int(ids.max()) + 1) + ids[starts], return_inverse=True)[1]
        return np.bincount(keys)[keys] > 1
    twin = np.zeros(len(keys), bool)
    twin[one] = twin[two] = True
    return twin


def measure(column: pa.Array, want_text: bool = True, max_lost_percent: int = MAX_LOST_PERCENT) -> dict[str, np.ndarray | list]:
    data, at = tb.buffers(column)
    n_texts = len(at) - 1
    word = tb.words(data, at)
    hasher = tb.Hasher(data)
    text_of_word = word.text_of()
    n_words = word.per_text()
    # Bytes that are no first byte of a code point in a word.
    other = np.flatnonzero(((data & 0xC0) == 0x80) | tb.SPACE[data])
    word_chars = np.diff(at) - tb.within(other, at[:-1], at[1:])
    del other
    symbol = np.flatnonzero(_SYMBOL[data])
    n_symbols = tb.within(symbol, at[:-1], at[1:])

    # Lines: each text is cut after every \n; one more cut ends it.
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    text_of_line = np.repeat(np.arange(n_texts), np.bincount(np.searchsorted(at, breaks, "right") - 1, minlength=n_texts) + 1)
    n_line = len(line_start)
    line_end = np.empty(n_line, np.int64)
    line_end[:-1] = line_start[1:] - (text_of_line[1:] == text_of_line[:-1])
    line_end[-1:] = at[-1:]
    first_word = np.searchsorted(word.start, line_start)
    last_word = np.searchsorted(word.start, line_end)
    line_words = last_word - first_word
    filled = line_words > 0
    dup = np.zeros(n_line, bool)
    dup[filled] = _seen_before(tb.numbered(hasher, line_start[filled], line_end[filled], text_of_line[filled]))
    n_dup_lines = np.bincount(text_of_line[dup], minlength=n_texts)

    # Words inside windows that the same text has twice.
    inside = np.flatnonzero(text_of_word[: max(len(text_of_word) - WINDOW + 1, 0)] == text_of_word[WINDOW - 1 :])
    starts = inside[_found_twice(tb.numbered(hasher, word.start, word.end), inside, text_of_word[inside])] if len(inside) else inside
    cover = np.bincount(starts, minlength=len(text_of_word) + 1) - np.bincount(starts + WINDOW, minlength=len(text_of_word) + 1)
    n_repeat = np.bincount(text_of_word[np.cumsum(cover[:-1]) > 0], minlength=n_texts)
    del inside, starts, cover

    # The rules.
    separators, symbols, shouts = (tb.within(x, line_start, line_end) for x in (np.flatnonzero(_SEPARATOR[data]), symbol, np.flatnonzero(data == 33)))
    closed = np.zeros(n_line, bool)
    closed[filled] = _CLOSING[data[word.end[last_word[filled] - 1] - 1]]
    bad = (separators >= 2) & (100 * separators >= 30 * line_words)
    bad |= (shouts >= line_words) | (3 * symbols >= line_words) | ((line_words < 4) & ~closed)
    lowered = tb.LOWER[data].tobytes()
    for phrase in PHRASES:
        needle, found = phrase.encode(), lowered.find(phrase.encode())
        while found >= 0:
            k = int(np.searchsorted(line_start, found, "right")) - 1
            if found + len(needle) <= line_end[k]:
                bad[k] = True
            found = lowered.find(needle, found + 1)
    bad &= filled
    stays = filled & ~bad
    n_lines = np.bincount(text_of_line[filled], minlength=n_texts)
    n_kept = np.bincount(text_of_line[stays], minlength=n_texts)
    words_kept = np.bincount(text_of_line, weights=line_words * stays, minlength=n_texts).astype(np.int64)
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    kept = ~base_failed & (100 * words_kept >= (100 - max_lost_percent) * n_words)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "base_failed": base_failed, "kept": kept, "n_lines": n_lines, "n_lines_kept": n_kept, "n_words_kept": words_kept}
    if want_text:
        raw, first = data.tobytes(), np.searchsorted(text_of_line, np.arange(n_texts + 1))
        out["cleaned"] = [b"\n".join(raw[line_start[k] : line_end[k]] for k in range(first[t], first[t + 1]) if stays[k]).decode() for t in range(n_texts)]
    return out


def clean_lines(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT, with_text: bool = True) -> DataFrame:
    """Verdict, counts and the text that is left of each document, one row for each row of ``docs``."""
    schema = SCHEMA if with_text else SCHEMA.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.parts(batches, "text"):
            got = measure(part.column("text"), with_text, max_lost_percent)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(got[x]) for x in names[1:])], names)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
