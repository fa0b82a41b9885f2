"""Places of regular-expression matches as Spark expressions, in code points and in bytes.

Spark has no function that gives the places of all matches. The text between the matches
(``split``) and the matches themselves (``regexp_extract_all``) come from the same search,
so their lengths, added up in turn, give every start and end. Bytes are counted as well:
a part of a text is cut out by its bytes in time that doesn't depend on where it stands.

Expressions with many lambdas are written as SQL text and parsed at once: building them from
columns takes thousands of calls between Python and the JVM, which is seconds for one query.
"""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offsets in code points (start, end) and in bytes (from, to), the match and one of its groups.
SPAN = "array<struct<start:int,end:int,from:int,to:int,hit:string,part:string>>"
#: Elements that are folded together; an array that a fold makes grows by copying, so none gets longer.
BLOCK = 128

_numbers = itertools.count()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once and held, not once for each element that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lambda(body: Callable[..., str]) -> str:
    names = [f"v{next(_numbers)}" for _ in inspect.signature(body).parameters]
    return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {body(*names)}"


def quoted(text: str) -> str:
    """A literal in which nothing is escaped; patterns write a single quote as ``\\x27``."""
    if "'" in text:
        raise ValueError("a literal without single quotes is needed")
    return f"r'{text}'"


def each(values: str, body: Callable[..., str]) -> str:
    return f"transform({values}, {_lambda(body)})"


def only(values: str, body: Callable[..., str]) -> str:
    return f"filter({values}, {_lambda(body)})"


def paired(left: str, right: str, body: Callable[[str, str], str]) -> str:
    return f"zip_with({left}, {right}, {_lambda(body)})"


def fold(values: str, start: str, body: Callable[[str, str], str]) -> str:
    return f"aggregate({values}, {start}, {_lambda(body)})"


def held(value: str, body: Callable[[str], str]) -> str:
    """``let`` in SQL text."""
    return f"get({each(f'array({value})', body)}, 0)"


def running(values: str, zero: str, step: Callable[[str, str], str], merge: Callable[[str, str], str], kind: str) -> str:
    """Of each element, what ``step`` has made of all elements before it, in time in proportion to their number.

    Elements are folded block by block; ``merge`` joins a block's result to those of the blocks before.
    """
    start = f"named_struct('at', cast({zero} as {kind}), 'out', cast(array() as array<{kind}>))"

    def grown(s: str, to: str) -> str:
        return f"named_struct('at', cast({to} as {kind}), 'out', concat({s}.out, array({s}.at)))"

    def folded(block: str) -> str:
        return fold(block, start, lambda s, x: grown(s, step(f"{s}.at", x)))

    def whole(rows: str) -> str:
        numbers = f"sequence(0, cast(floor((size({rows}) - 1) / {BLOCK}) as int))"
        parts = each(numbers, lambda b: folded(f"slice({rows}, {b} * {BLOCK} + 1, {BLOCK})"))

        def joined(p: str) -> str:
            before = fold(p, start, lambda s, x: grown(s, merge(f"{s}.at", f"{x}.at")))
            return f"flatten({paired(p, f'{before}.out', lambda x, b: each(f'{x}.out', lambda y: f'cast({merge(b, y)} as {kind})'))})"

        return f"CASE WHEN size({rows}) <= {BLOCK} THEN {folded(rows)}.out ELSE {held(parts, joined)} END"

    return held(values, whole)


def places(text: str, pattern: str, group: int = 0) -> str:
    """All leftmost matches in order: start, end (exclusive), the match and one of its groups.

    Texts without a match cost one search. A null text has none.
    """
    search = quoted(pattern)
    hits, gaps = f"regexp_extract_all({text}, {search}, 0)", f"split({text}, {search}, -1)"

    def sized(gap: str, hit: str, part: str) -> str:
        return f"named_struct('c', length({gap}), 'b', octet_length({gap}), 'hit', {hit}, 'part', {part})"

    if group:
        pairs = paired(gaps, f"arrays_zip({hits}, regexp_extract_all({text}, {search}, {group}))", lambda g, x: sized(g, f"{x}.`0`", f"{x}.`1`"))
    else:
        pairs = paired(gaps, hits, lambda g, h: sized(g, h, h))
    # What stands after the last match is no pair.
    pairs = only(pairs, lambda x: f"{x}.hit IS NOT NULL")

    def added(a: str, c: str, b: str) -> str:
        return f"named_struct('c', {a}.c + {c}, 'b', {a}.b + {b})"

    def found(rows: str) -> str:
        before = running(rows, "named_struct('c', 0, 'b', 0)", lambda a, x: added(a, f"{x}.c + length({x}.hit)", f"{x}.b + octet_length({x}.hit)"), lambda a, x: added(a, f"{x}.c", f"{x}.b"), "struct<c:int,b:int>")

        def span(x: str, at: str) -> str:
            start, first = f"{at}.c + {x}.c", f"{at}.b + {x}.b"
            return f"named_struct('start', {start}, 'end', {start} + length({x}.hit), 'from', {first}, 'to', {first} + octet_length({x}.hit), 'hit', {x}.hit, 'part', {x}.part)"

        return paired(rows, before, span)

    return f"CASE WHEN {text} RLIKE {search} THEN {held(pairs, found)} ELSE cast(array() as {SPAN}) END"


def piece(raw: str, first: str, size: str) -> str:
    """The text of so many bytes from a byte on; ``raw`` is binary."""
    return f"cast(substring({raw}, {first} + 1, {size}) as string)"


def listed(spans: Column, kind: str) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
