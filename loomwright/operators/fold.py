"""Values of constant expressions in Python source, by folding their syntax tree.

Nothing is evaluated by Python itself: each kind of node has its rule here, names stand for a
few harmless builtins, and whatever would grow beyond a bound ends the folding. The outcome
is a value, or the reason why there is none: a name that isn't known, which is what decides
how an argument is called, or any other error.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable
from typing import Any

#: Bits of whole numbers, elements of sequences, and nodes of a tree, at most.
BITS, ELEMENTS, NODES = 4096, 10_000, 2_000


class UnknownName(Exception):
    """The value needs a name that isn't there."""


class NoValue(Exception):
    """The expression fails, or isn't folded."""


# Builtins whose results depend on nothing but their arguments, and types and functions that may be named.
PURE: dict[str, Callable] = {f.__name__: f for f in (abs, all, any, ascii, bin, bool, chr, complex, dict, divmod, float, frozenset, hash, hex, int, len, list, max, min, oct, ord, range, repr, reversed, round, set, sorted, str, sum, tuple, zip, enumerate)}
NAMED: dict[str, Any] = PURE | {f.__name__: f for f in (bytes, type, object, print, isinstance, input, open, map, filter, id, iter, next, pow, format, slice, callable, getattr, setattr, hasattr, vars, dir, eval, exec, compile)}
METHODS = {
    str: ("capitalize", "count", "endswith", "find", "index", "isalpha", "isdigit", "islower", "isupper", "lower", "lstrip", "replace", "rstrip", "split", "startswith", "strip", "swapcase", "title", "upper", "join"),
    list: ("count", "index", "copy"), tuple: ("count", "index"), dict: ("get", "keys", "values", "items", "copy"), set: ("union", "intersection", "difference", "copy"), int: ("bit_length",), float: ("is_integer",),
}
BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow,
    ast.LShift: operator.lshift, ast.RShift: operator.rshift, ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.BitXor: operator.xor,
}
UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg, ast.Not: operator.not_, ast.Invert: operator.invert}
COMPARE = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Is: operator.is_, ast.IsNot: operator.is_not,
    ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b,
}


def _bounded(value: Any) -> Any:
    if isinstance(value, int) and value.bit_length() > BITS or not isinstance(value, type) and hasattr(value, "__len__") and len(value) > ELEMENTS:
        raise NoValue("too large")
    return value


def _binary(op: ast.operator, a: Any, b: Any) -> Any:
    """The operation, unless its result would be too large to begin with."""
    sized = [x for x in (a, b) if isinstance(x, (str, bytes, list, tuple))]
    if isinstance(op, ast.Mult) and sized:
        times = b if sized[0] is a else a
        if isinstance(times, int) and times * len(sized[0]) > ELEMENTS:
            raise NoValue("too large")
    elif isinstance(op, ast.Mod) and isinstance(a, (str, bytes)):
        # Widths in a format can be of any size.
        raise NoValue("not folded")
    elif isinstance(a, int) and isinstance(b, int):
        bits = a.bit_length() * b if isinstance(op, ast.Pow) else a.bit_length() + b if isinstance(op, ast.LShift) else 0
        if bits > BITS:
            raise NoValue("too large")
    return BINARY[type(op)](a, b)


class _Fold:
    def __init__(self) -> None:
        self.nodes = 0

    def of(self, node: ast.expr) -> Any:
        self.nodes += 1
        if self.nodes > NODES:
            raise NoValue("too many nodes")
        rule = getattr(self, f"_{type(node).__name__.lower()}", None)
        if rule is None:
            raise NoValue(f"not folded: {type(node).__name__}")
        return _bounded(rule(node))

    def each(self, nodes: list[ast.expr]) -> list:
        out = []
        for x in nodes:
            if isinstance(x, ast.Starred):
                out += list(self.of(x.value))
            else:
                out.append(self.of(x))
        return _bounded(out)

    def _constant(self, node: ast.Constant) -> Any:
        return node.value

    def _name(self, node: ast.Name) -> Any:
        if node.id not in NAMED:
            raise UnknownName(node.id)
        return NAMED[node.id]

    def _list(self, node: ast.List) -> list:
        return self.each(node.elts)

    def _tuple(self, node: ast.Tuple) -> tuple:
        return tuple(self.each(node.elts))

    def _set(self, node: ast.Set) -> set:
        return set(self.each(node.elts))

    def _dict(self, node: ast.Dict) -> dict:
        out: dict = {}
        for key, value in zip(node.keys, node.values):
            if key is None:
                out |= dict(self.of(value))
            else:
                name = self.of(key)
                out[name] = self.of(value)
        return out

    def _unaryop(self, node: ast.UnaryOp) -> Any:
        return UNARY[type(node.op)](self.of(node.operand))

    def _binop(self, node: ast.BinOp) -> Any:
        a = self.of(node.left)
        return _binary(node.op, a, self.of(node.right))

    def _boolop(self, node: ast.BoolOp) -> Any:
        stop = isinstance(node.op, ast.Or)
        for x in node.values:
            value = self.of(x)
            if bool(value) == stop:
                break
        return value

    def _compare(self, node: ast.Compare) -> Any:
        left, found = self.of(node.left), True
        for op, x in zip(node.ops, node.comparators):
            right = self.of(x)
            found = COMPARE[type(op)](left, right)
            if not found:
                break
            left = right
        return found

    def _ifexp(self, node: ast.IfExp) -> Any:
        return self.of(node.body if self.of(node.test) else node.orelse)

    def _subscript(self, node: ast.Subscript) -> Any:
        held = self.of(node.value)
        return held[self.of(node.slice)]

    def _slice(self, node: ast.Slice) -> slice:
        return slice(*(None if x is None else self.of(x) for x in (node.lower, node.upper, node.step)))

    def _lambda(self, node: ast.Lambda) -> Any:
        # Its body isn't looked at until it is called, which nothing here does.
        return lambda: None

    def _joinedstr(self, node: ast.JoinedStr) -> str:
        for x in node.values:
            if isinstance(x, ast.FormattedValue):
                self.of(x.value)
                if x.format_spec is not None:
                    raise NoValue("not folded: a format")
        return "".join(x.value if isinstance(x, ast.Constant) else str(self.of(x.value)) for x in node.values)

    def _attribute(self, node: ast.Attribute) -> Any:
        held = self.of(node.value)
        if type(held) in METHODS and node.attr in METHODS[type(held)]:
            return getattr(held, node.attr)
        raise NoValue(f"not folded: {node.attr}")

    def _call(self, node: ast.Call) -> Any:
        function = self.of(node.func)
        args, named = self.each(node.args), {k.arg: self.of(k.value) for k in node.keywords}
        method = getattr(function, "__self__", None)
        known = PURE.get(getattr(function, "__name__", "")) is function or type(method) in METHODS
        if not known or None in named:
            raise NoValue("not folded: a call")
        text = isinstance(method, str) and function.__name__ in ("replace", "join")
        if text and len(method) * max([1, *(len(x) for x in args if hasattr(x, "__len__"))]) * 2 > ELEMENTS:
            raise NoValue("too large")
        if any(isinstance(x, range) and len(x) > ELEMENTS for x in args):
            raise NoValue("too large")
        return function(*args, **named)


def value_of(source: str) -> Any:
    """The value of an expression; ``UnknownName`` or ``NoValue`` if there is none."""
    try:
        tree = ast.parse(source.strip(), mode="eval")
        return _Fold().of(tree.body)
    except (UnknownName, NoValue):
        raise
    except Exception as e:  # noqa: BLE001  whatever the operations raise is a failure of the expression
        raise NoValue(str(e)) from e
