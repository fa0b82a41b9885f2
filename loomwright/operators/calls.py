"""Calls and code blocks of Python source: what needs a parser runs in Arrow-batched functions.

Values in calls are found by folding constants (``fold``); nothing in the data is ever evaluated.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fold import NoValue, UnknownName, value_of

OPEN, CLOSE = "([{", ")]}"
# Fixed value: what a call looks like.
CALL = re.compile(r"(\w+)\s*\((.*)\)")


def split_call(text: str | None) -> tuple[str, list[str]] | None:
    """A call's name and its arguments, cut at commas outside of any brackets; None if it isn't a call."""
    m = CALL.match(text or "")
    if not m:
        return None
    parts, depth, begin, inner = [], 0, 0, m[2]
    for k, c in enumerate(inner):
        depth += (c in OPEN) - (c in CLOSE)
        if c == "," and depth == 0:
            parts.append(inner[begin:k].strip())
            begin = k + 1
    # What follows the last comma is an argument even if it is blank, but not if nothing follows.
    rest = inner[begin:]
    return m[1], parts + [rest.strip()] * bool(rest)


def type_of(argument: str) -> str:
    """The name of the type of an argument's value.

    An argument with a name that isn't known is an instance of what it calls, if it begins with a
    plain call, else of a type called like the whole argument. Any other failure is text.
    """
    try:
        return _named(value_of(argument))
    except UnknownName:
        m = CALL.match(argument)
        return m[1] if m else argument[0].upper() + argument[1:]
    except NoValue:
        return "str"


def _named(value: object) -> str:
    if isinstance(value, list):
        return f"List[{_named(value[0])}]" if value else "List"
    return type(value).__name__


def signature_of(text: str | None) -> str | None:
    """``foo(4, 5)`` gives ``foo(arg_int: int, arg_int_2: int)``; None if it isn't a call."""
    call = split_call(text)
    if call is None:
        return None
    seen: dict[str, int] = {}
    out = []
    for argument in call[1]:
        kind = type_of(argument)
        base = "arg_" + re.sub(r"[^a-zA-Z0-9_]", "_", kind).rstrip("_").lower()
        seen[base] = seen.get(base, 0) + 1
        out.append(f"{base}{f'_{seen[base]}' if seen[base] > 1 else ''}: {kind}")
    return f"{call[0]}({', '.join(out)})"


def name_of_call(text: str | None) -> str | None:
    """The name of a plain call by the parser; None for anything else."""
    try:
        body = ast.parse(text or "").body
    except (SyntaxError, ValueError, RecursionError):
        return None
    value = getattr(body[0], "value", None) if body else None
    func = value.func if isinstance(value, ast.Call) else None
    return func.id if isinstance(func, ast.Name) else None


def _parsed(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return None


def kept_blocks(source: str | None, kinds: tuple[str, ...] = ("Import", "ImportFrom", "FunctionDef")) -> str | None:
    """The top-level statements of these kinds as source; text that doesn't parse stays as it is."""
    tree = _parsed(source)
    if tree is None or source is None:
        return source
    return "\n".join(ast.unparse(x) for x in tree.body if type(x).__name__ in kinds)


def function_names(source: str | None) -> list[str]:
    """Functions defined at the top level, then names imported from modules there."""
    tree = _parsed(source)
    body = tree.body if tree else []
    return [x.name for x in body if isinstance(x, ast.FunctionDef)] + [a.asname or a.name for x in body if isinstance(x, ast.ImportFrom) for a in x.names]


def has_example_call(source: str | None, name: str | None) -> bool:
    """Whether the function is known at the top level and an expression or assignment there calls it."""
    tree = _parsed(source)
    if tree is None or name not in function_names(source):
        return False
    values = (x.value for x in tree.body if isinstance(x, (ast.Expr, ast.Assign)))
    return any(isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id == name for v in values)


@F.pandas_udf(T.StringType())
def signature(calls: pd.Series) -> pd.Series:
    return calls.map(signature_of)


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("args", T.ArrayType(T.StringType()))]))
def parsed_call(calls: pd.Series) -> pd.DataFrame:
    got = [split_call(x) or (None, None) for x in calls]
    return pd.DataFrame({"name": pd.Series([x[0] for x in got], dtype=object), "args": pd.Series([x[1] for x in got], dtype=object)})


@F.pandas_udf(T.StringType())
def call_name(calls: pd.Series) -> pd.Series:
    return calls.map(name_of_call)


@F.pandas_udf(T.StringType())
def code_blocks(sources: pd.Series) -> pd.Series:
    return sources.map(kept_blocks)


@F.pandas_udf(T.ArrayType(T.StringType()))
def defined_names(sources: pd.Series) -> pd.Series:
    return sources.map(function_names)


@F.pandas_udf(T.BooleanType())
def calls_example(sources: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([has_example_call(s, n) for s, n in zip(sources, names)], dtype=bool)
