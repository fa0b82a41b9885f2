"""Periodic runs: stretches of words that repeat the same few words at least four times in a row.

A run with period p holds two neighbouring points of the grid 0, p, 2p, ..., and the words
there are the same. So for every p up to a quarter of a text all neighbouring points are
compared, which are n/p pairs and in all n log n; where the words are the same, the longest
common extension forwards (by a suffix array of the words) and backwards (by one of the
words reversed) gives the whole stretch. Extensions are range minima of the common prefixes
of neighbouring suffixes. A stretch that several periods give has the smallest of them.

All texts of a slice share one suffix array: a word of one text equals no word of another,
so suffixes never run on into the next text. Suffixes are sorted by doubling; only those that
aren't told apart yet are sorted again, which in plain prose are few. A text is one task's
work, in memory of about 200 bytes for each of its words.

Cases: a null, empty or blank text has no words and no runs; its collapsed text is empty.
Texts of any length are taken whole. Repeated rows give repeated results, empty tables none.
Runs are ordered by start, then period. A row without an id is looked at like any other.
Only the columns named are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let
from .storage import small_batches
from .textbytes import Hasher, buffers, numbered, parts, ragged, words

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Pairs of grid points, and kept words, that are looked at together.
_PAIRS, _JOINED = 1 << 19, 1 << 16
#: Runs that are remembered, so that multiples of their periods aren't looked at, have so many periods.
LONG_TIMES = 16
_UNKNOWN = np.iinfo(np.int32).max
#: Row of minima over 32 values; longer ranges go by blocks of as many.
_TOP = 5


class RangeMinima:
    """Minima of ranges of an array in constant time each.

    Ranges of up to 63 values are two overlapping powers of two; longer ones are their first and
    last 32 values and the aligned blocks of 32 between, which have a table of their own.
    """

    def __init__(self, values: np.ndarray):
        self.rows = np.empty((_TOP + 1, len(values)), np.int32)
        self.rows[0] = values
        for k in range(_TOP):
            _doubled(self.rows[k], self.rows[k + 1], 1 << k)
        level = self.rows[_TOP, :: 1 << _TOP].copy()
        self.blocks = np.empty((max(1, len(level).bit_length()), len(level)), np.int32)
        self.blocks[0] = level
        for k in range(len(self.blocks) - 1):
            _doubled(self.blocks[k], self.blocks[k + 1], 1 << k)

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value from each ``first`` up to before ``last``; no range is empty."""
        k = np.minimum(_log2(last - first), _TOP)
        out = np.minimum(self.rows[k, first], self.rows[k, last - (1 << k)])
        far = np.flatnonzero(last - first >= 2 << _TOP)
        if len(far):
            begin, end = -(-first[far] >> _TOP), last[far] >> _TOP
            k = _log2(end - begin)
            out[far] = np.minimum(out[far], np.minimum(self.blocks[k, begin], self.blocks[k, end - (1 << k)]))
        return out


def _doubled(values: np.ndarray, out: np.ndarray, step: int) -> None:
    """Minima over twice as many values; ranges that reach beyond the end are cut there."""
    out[:] = values
    if step < len(values):
        np.minimum(values[:-step], values[step:], out=out[:-step])


def _log2(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1] - 1


class Extensions:
    """Longest common extensions of any two places of a sequence by its suffix array.

    The sequence ends with a value that occurs once, so no suffix is the beginning of another.
    """

    def __init__(self, sequence: np.ndarray):
        n = len(sequence)
        order = np.argsort(sequence)
        ranked = sequence[order]
        head = np.ones(n, bool)
        head[1:] = ranked[1:] != ranked[:-1]
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        # What a suffix has in common with the one before it in the order; unknown inside groups.
        common = np.where(head, 0, _UNKNOWN).astype(np.int32)
        slots = np.flatnonzero(~(head & np.append(head[1:], True)))
        step = 1
        while len(slots):
            own = order[slots]
            key = self.rank[own] * n + self.rank[own + step]
            by = np.argsort(key)
            own, key = own[by], key[by]
            order[slots] = own
            head = np.ones(len(slots), bool)
            head[1:] = key[1:] != key[:-1]
            parted = np.flatnonzero(head & (common[slots] == _UNKNOWN))
            if len(parted):
                # Both begin with the same ``step`` values; what follows has been told apart before.
                left, right = self.rank[own[parted - 1] + step], self.rank[own[parted] + step]
                common[slots[parted]] = step + RangeMinima(common)(left + 1, right + 1)
            self.rank[own] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
            slots = slots[~(head & np.append(head[1:], True))]
            step *= 2
        self.minima = RangeMinima(common)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many values are the same from each a and b on; a and b differ."""
        a, b = self.rank[a], self.rank[b]
        return self.minima(np.minimum(a, b) + 1, np.maximum(a, b) + 1)


def _grid(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place, period) of all texts, some at a time: a place of the grid whose next one is in its text as well."""
    most = np.where(size >= LEAST_WORDS, size // LEAST_TIMES, 0)
    text = np.repeat(np.arange(len(size)), most)
    period = ragged(np.ones(len(size), np.int64), most)
    pairs = (size[text] - 1) // period
    ends = np.cumsum(pairs)
    begin = 0
    while begin < len(ends):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _PAIRS, "right")))
        of = slice(begin, stop)
        p = np.repeat(period[of], pairs[of])
        yield np.repeat(first[text[of]], pairs[of]) + ragged(np.zeros(stop - begin, np.int64), pairs[of]) * p, p
        begin = stop


def runs_of(sequence: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period; places are those of ``sequence``.

    ``sequence`` begins with a value that occurs once, and so does what follows each text.
    """
    found = [np.zeros((0, 3), np.int64)]
    forward = backward = None
    top = len(sequence) - 1
    # Of long runs that are known: the period and the end at each of their places.
    known, known_to = np.zeros(len(sequence), np.int32), np.zeros(len(sequence), np.int32)
    for x, p in _grid(first, size):
        same = np.flatnonzero(sequence[x] == sequence[x + p])
        x, p = x[same], p[same]
        # A multiple of a known period gives the known run again.
        again = (known_to[x] > x + p) & (p % np.maximum(known[x], 1) == 0)
        x, p = x[~again], p[~again]
        if not len(x):
            continue
        if forward is None:
            forward, backward = Extensions(sequence), Extensions(sequence[::-1].copy())
        for at in range(0, len(x), _PAIRS):
            u, q = x[at : at + _PAIRS], p[at : at + _PAIRS]
            # From the words before both; the reversed sequence counts from the other end.
            start = u - backward(top - (u - 1), top - (u + q - 1))
            # The first pair of a run on its grid stands for it: with one more period before, the pair there is the same run's.
            lead = np.flatnonzero(u - start < q)
            u, q, start = u[lead], q[lead], start[lead]
            end = u + q + forward(u, u + q)
            good = end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * q)
            these = np.stack([start[good], end[good], q[good]], 1)
            found.append(these)
            for s, e, r in these[these[:, 1] - these[:, 0] >= LONG_TIMES * these[:, 2]].tolist():
                known[s:e], known_to[s:e] = r, e
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    # Of periods with the same stretch the others are multiples of the smallest one.
    smallest = np.ones(len(every), bool)
    smallest[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[smallest]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words with one space between."""
    out = []
    for at in range(0, len(start), _JOINED):
        s, e = start[at : at + _JOINED], end[at : at + _JOINED]
        size = e - s + 1
        whole = raw[ragged(s, size)]
        whole[np.cumsum(size) - 1] = 32
        out.append(whole.tobytes())
    return b"".join(out)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _found(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = buffers(batch.column("text"))
    spans = words(data, offsets)
    size = spans.per_text()
    text = spans.text_of()
    hasher = Hasher(data)
    # Each text and what stands before the first one is followed by a value of its own.
    first = spans.at[:-1] + np.arange(len(size)) + 1
    sequence = np.full(len(text) + len(size) + 1, -1, np.int64)
    sequence[np.arange(len(text)) + text + 1] = numbered(hasher, spans.start, spans.end, text)
    marks = np.append(0, first + size)
    sequence[marks] = -1 - np.arange(len(marks))
    runs = runs_of(sequence, first, size)
    owner = np.searchsorted(first, runs[:, 0], "right") - 1
    change = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    keep = np.cumsum(change)[np.arange(len(text)) + text + 1] == 0
    start, end = spans.start[keep], spans.end[keep]
    whole = _joined(hasher.raw, start, end)
    # Where each text's kept words end, each with a space after it.
    bytes_to = np.append(0, np.cumsum(end - start + 1))[np.append(0, np.cumsum(np.bincount(text[keep], minlength=len(size))))]
    collapsed = [whole[a : max(a, b - 1)] for a, b in zip(bytes_to[:-1].tolist(), bytes_to[1:].tolist())]
    entries = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[owner]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(RUN))
    ends = pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=len(size)))).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(ends, entries), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
    )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each row: its runs, in words, and its text without their repeats.

    Of every run only the first ``period`` words stay in ``collapsed``, unless another run drops
    them; words are joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            yield _found(part)

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, SCHEMA)


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in a tenth of the texts, by a hash of the id, the words from some place on repeat the first few of them."""
    number = F.crc32(F.col("doc_id").cast("string"))
    by = F.floor(number / 10)

    def repeated(held: Column) -> Column:
        n = F.size(held)
        a = (by % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (by % 8 + 3))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(held, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    held = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = (number % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(some, let(held, repeated)).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs`` about its runs, after the repeats that its id plants."""
    found = periodic_runs(with_planted_repeats(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = found.withColumn("x", longest).withColumn("lines", F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""))
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("x.start")).alias("start"), F.col("x.length").alias("length"), (-F.col("x.period")).alias("period"),
        F.expr("(1000 * x.length) div -x.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
