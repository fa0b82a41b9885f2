"""Comparing rows of Spark and DuckDB."""

from __future__ import annotations


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def assert_same(frame, duck, sql: str) -> None:
    got = duck.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    expected = sorted((tuple(plain(row[names.index(c)]) for c in order) for row in got.fetchall()), key=repr)
    actual = sorted((tuple(plain(row[c]) for c in order) for row in (r.asDict(True) for r in frame.collect())), key=repr)
    assert len(actual) == len(expected)
    assert actual == expected
