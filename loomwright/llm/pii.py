"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust their scores.

DataFrame functions only. The four base kinds follow fixed patterns and rules; the base
spans that pass stay whatever their score. Two more kinds are added: ``iban``, confirmed by
its mod-97 checksum, and ``ssn``, which has no checksum and needs a word nearby that says so.

Patterns are written so that a search takes time in proportion to the text: runs are
possessive, and a search doesn't begin inside a run in which it has begun already. They
find what the plain patterns find. The groups of an ``iban`` can't be told from short upper-case
words or numbers after it, so its pattern only finds where one may begin and how far one may
reach; of the ends at a space or at the reach, the last one whose checksum holds is taken.
Spans, contexts and gaps are cut out by their bytes, so the rest takes time in proportion to
the number of matches.

Cases: a null text counts as empty and has no spans. Repeated rows give repeated results,
empty tables none. Offsets are code points, ends exclusive. Only the columns named are read,
so others may have any names; ``redact`` keeps all others as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, each, fold, held, listed, only, paired, piece, places, quoted, running


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    prior: float
    #: Words nearby that raise the score by ``CONTEXT``, and that lower it by as much.
    near: tuple[str, ...]
    against: tuple[str, ...] = ()
    base: bool = True
    #: The group of the pattern that the rule looks at.
    group: int = 0
    #: What every match has, to pass over most texts quickly.
    needs: str = ""


#: The base kinds in their order, then the added ones.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.7, ("mail", "contact", "write to"), ("noreply",), needs="@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", 0.5, ("ip", "host", "server", "address"), ("version", "section")),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", 0.4, ("card", "credit", "visa", "payment"), ("serial", "tracking")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.5, ("phone", "call", "tel", "mobile", "fax"), ("score", "total"), needs="+"),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9]))[A-Z]{2}[0-9]{2}", 0.4, ("iban", "bank", "account", "transfer"), base=False, group=1),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, ("ssn", "social security", "taxpayer"), base=False, needs="-"),
)
CONTEXT, CONFIRMED = 0.2, 0.3
#: An added span needs this score; a checksum that holds is enough, or a word nearby where there is none.
LEAST = 0.5
#: Code points before and after a span where words count.
BEFORE, AFTER = 48, 24


def _digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """Whether a string of ASCII digits has a valid Luhn check digit."""

    def value(d: str, i: str) -> str:
        return held(f"cast(substring({d}, -{i}, 1) as int)", lambda x: f"IF({i} % 2 = 1, {x}, {x} * 2 - IF({x} > 4, 9, 0))")

    return held(digits, lambda d: f"IF(length({d}) > 0, {fold(f'sequence(1, length({d}))', '0', lambda s, i: f'{s} + {value(d, i)}')} % 10 = 0, false)")


def mod97(iban: str) -> str:
    """Whether a number without spaces leaves 1 when the first four characters go last and letters are 10 to 35."""

    def step(rest: str, c: str) -> str:
        return held(f"IF({c} < 'A', ascii({c}) - 48, ascii({c}) - 55)", lambda v: f"({rest} * IF({v} > 9, 100, 10) + {v}) % 97")

    return held(iban, lambda n: f"{fold(f'split(concat(substring({n}, 5, 64), substring({n}, 1, 4)), {quoted("")})', '0', step)} = 1")


def _valid(kind: str, hit: str) -> str:
    if kind == "ip":
        # Without leading zeros a part of three digits at most, which compares as text once it is padded.
        bare = each(f"split({hit}, {quoted('[.]')})", lambda p: f"regexp_replace({p}, '^0+', '')")
        return f"size({only(bare, lambda p: f"length({p}) > 3 OR lpad({p}, 3, '0') > '255'")}) = 0"
    return luhn(_digits(hit)) if kind == "card" else f"length({_digits(hit)}) BETWEEN 8 AND 15"


#: Code points that an ``iban`` may reach, and places where others may begin within it: each begins with four.
_IBAN_REACH = 48


def _span(start: str, end: str, first: str, last: str, more: str = "") -> str:
    return f"named_struct('start', {start}, 'end', {end}, 'from', {first}, 'to', {last}{more})"


def _ibans(spans: str) -> str:
    """Of each reach (``part``) the longest number that the checksum confirms; none that lies inside an earlier one."""

    def longest(s: str, groups: str) -> str:
        def valid(k: str) -> str:
            return held(f"array_join(slice({groups}, 1, {k}), '')", lambda n: f"length({n}) >= 12 AND {mod97(n)}")

        k = f"try_element_at({only(f'sequence(size({groups}), 1, -1)', valid)}, 1)"
        return held(f"length(array_join(slice({groups}, 1, {k}), ' '))", lambda n: _span(f"{s}.start", f"{s}.start + {n}", f"{s}.`from`", f"{s}.`from` + {n}"))

    def outermost(found: str) -> str:
        before = _IBAN_REACH // 4
        inside = lambda s, i: only(f"slice({found}, greatest({i} + 1 - {before}, 1), least({i}, {before}))", lambda x: f"{x}.`end` >= {s}.`end`")
        return only(found, lambda s, i: f"size({inside(s, i)}) = 0")

    numbers = each(spans, lambda s: held(f"split({s}.part, ' ')", lambda g: longest(s, g)))
    return held(only(numbers, lambda s: f"{s}.`end` IS NOT NULL"), outermost)


def _score(raw: str, kind: Kind, span: str) -> str:
    # A code point has four bytes at most.
    def around(first: str) -> str:
        before, after = piece(raw, first, f"{span}.`from` - {first}"), piece(raw, f"{span}.`to`", str(4 * AFTER))
        return f"lower(concat(right({before}, {BEFORE}), ' ', left({after}, {AFTER})))"

    def any_of(words: tuple[str, ...], near: str) -> str:
        return f"{near} RLIKE {quoted('(?<![a-z0-9_])(?:' + '|'.join(words) + ')s?(?![a-z0-9_])')}" if words else "false"

    def told(near: str) -> str:
        prior = kind.prior + CONFIRMED * (kind.name not in ("email", "ssn"))
        return f"round({prior}D + IF({any_of(kind.near, near)}, {CONTEXT}D, 0D) - IF({any_of(kind.against, near)}, {CONTEXT}D, 0D), 3)"

    return held(f"greatest({span}.`from` - {4 * BEFORE}, 0)", lambda first: held(around(first), told))


def with_spans(docs: DataFrame, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """``docs`` with a column ``pii_<kind>`` for each kind: its spans in order, with scores."""
    body = f"coalesce(`{text}`, '')"
    found = docs.withColumns({prefix + k.name: F.expr(_possible(body, k)) for k in KINDS})
    return found.withColumns({prefix + k.name: F.expr(_checked(body, k, prefix + k.name)) for k in KINDS})


def _possible(body: str, kind: Kind) -> str:
    """Places of the kind's pattern; texts without a character that it needs aren't searched."""
    spans = places(body, kind.pattern, kind.group)
    return f"CASE WHEN contains({body}, {quoted(kind.needs)}) THEN {spans} ELSE cast(array() as {SPAN}) END" if kind.needs else spans


def _checked(body: str, kind: Kind, spans: str) -> str:
    """The spans that pass the kind's rule, with scores; added ones only with the score they need."""
    if kind.name == "iban":
        spans = _ibans(spans)
    elif kind.name not in ("email", "ssn"):
        spans = only(spans, lambda s: _valid(kind.name, f"{s}.hit"))

    def scored(good: str) -> str:
        def each_of(raw: str) -> str:
            return each(good, lambda s: _span(f"{s}.start", f"{s}.`end`", f"{s}.`from`", f"{s}.`to`", f", 'score', {_score(raw, kind, s)}"))

        return f"CASE WHEN size({good}) = 0 THEN cast(array() as array<struct<start:int,end:int,from:int,to:int,score:double>>) ELSE {held(f'cast({body} as binary)', each_of)} END"

    told = held(spans, scored)
    return told if kind.base else only(told, lambda s: f"{s}.score >= {LEAST}D")


def _marked(spans: str, mark: str) -> str:
    return each(spans, lambda s: f"named_struct('from', {s}.`from`, 'to', {s}.`to`, 'kind', '{mark}')")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and spans of each row of ``docs`` by its ``doc_id``."""
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.concat(*(listed(F.col("pii_" + k.name), k.name) for k in KINDS if k.base))
    every = F.concat(*(listed(F.col("pii_" + k.name), k.name) for k in KINDS))
    best = F.array_max(F.concat(F.array(F.lit(0.0)), *(F.transform("pii_" + k.name, lambda s: s["score"]) for k in KINDS)))
    counts = [F.size("pii_" + k.name).cast("long").alias("n_" + k.name) for k in KINDS if k.base]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"), best.alias("max_score"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span in its text replaced by its kind in brackets; overlapping spans become one.

    A null text stays null. All columns stay; ``n_chars``, where there is one, follows the text.
    """
    mark = "__pii_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = "_" + mark
    found = with_spans(docs, text, mark)
    spans = "array_sort(concat(" + ", ".join(_marked(mark + k.name, f"[{k.name.upper()}]") for k in KINDS) + "))"

    def joined(raw: str) -> str:
        def cut(s: str) -> str:
            # Where the spans before reach to; a span that begins before that is part of them.
            reached = running(s, "0", lambda at, x: f"greatest({at}, {x}.`to`)", lambda a, b: f"greatest({a}, {b})", "int")
            parts = paired(s, reached, lambda x, at: f"CASE WHEN {x}.`from` >= {at} THEN concat({piece(raw, at, f'{x}.`from` - {at}')}, {x}.kind) ELSE '' END")
            last = f"array_max({each(s, lambda x: f'{x}.`to`')})"
            return f"array_join(concat({parts}, array({held(last, lambda at: piece(raw, at, f'octet_length(`{text}`)'))})), '')"

        return held(spans, cut)

    none = F.lit(True)
    for k in KINDS:
        none = none & (F.size(mark + k.name) == 0)
    new = F.when(F.col(text).isNull() | none, F.col(text)).otherwise(F.expr(held(f"cast(`{text}` as binary)", joined)))
    out = found.withColumn(text, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
